"""Token-id files of patched frame-of-reference blocks.

A file set is a folder of Parquet carriers, so any store that Spark writes to can
hold it; each row is one frame of a shard.  Shards hold ascending ranges of the
key, frames whole documents in ascending order.  A frame's payload:

    magic ``PFB1``, number of ids (u64), number of blocks (u64)
    block starts (u64 each, bytes from the first block)
    blocks of 256 ids: least id (u32), width (u8), exceptions (u16),
        256 offsets from the least id packed at ``width`` bits,
        positions (u8) and full offsets (u32) of the exceptions

The width of a block holds the offset at ``PERCENTILE``; larger offsets are
exceptions.  The block starts let a reader open any range of ids by itself.

Null and empty texts hold the end id alone.  Null keys come first; rows of one key
are ordered by text, and a key of very many rows is spread over many shards by the beginnings of its texts.
Repeated rows are kept.  Texts of any length are encoded whole; a frame holds at least one.
An empty table gives an empty file set.  Extra columns are not read; a key column named as a result is an error.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridleaf.llm import pretoken
from gridleaf.llm.shared import Memo, chunks, no_clash

BLOCK = 256
PERCENTILE = 0.9
HEAD = struct.Struct("<4sQQ")
BLOCK_HEAD = 7
#: Ids after which a frame is closed, at the end of a document.
FRAME_IDS = 262_144
#: Characters of a text that take part in the bounds between shards.
BOUND_CHARS = 128


def pack_lanes(values: np.ndarray, width: int) -> np.ndarray:
    """(k, 256) offsets at ``width`` bits each: (k, 32 * width) bytes."""
    k = len(values)
    lanes = np.ascontiguousarray(values.reshape(k * 4, 64).T)
    words = np.zeros((width + 1, k * 4), dtype=np.uint64)
    for lane in range(64):
        at, shift = divmod(lane * width, 64)
        words[at] |= lanes[lane] << np.uint64(shift)
        if shift + width > 64:
            words[at + 1] |= lanes[lane] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words[:width].T).astype("<u8").view(np.uint8).reshape(k, 32 * width)


def unpack_lanes(packed: np.ndarray, width: int) -> np.ndarray:
    k = len(packed)
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").reshape(k * 4, width).T)
    lanes = np.empty((64, k * 4), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for lane in range(64):
        at, shift = divmod(lane * width, 64)
        value = words[at] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (words[at + 1] << np.uint64(64 - shift))
        lanes[lane] = value & mask
    return np.ascontiguousarray(lanes.T).reshape(k, BLOCK)


def bit_length(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1]


def encode_frame(ids: np.ndarray) -> bytes:
    """The payload of a frame of unsigned 32-bit ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return HEAD.pack(b"PFB1", 0, 0)
    values = np.empty(blocks * BLOCK, dtype=np.uint64)
    values[:n] = ids
    values[n:] = ids[-1]
    values = values.reshape(blocks, BLOCK)
    least = values.min(axis=1)
    values -= least[:, None]
    cut = int(PERCENTILE * BLOCK) - 1
    width = bit_length(np.partition(values, cut, axis=1)[:, cut])
    over = values >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    extra = over.sum(axis=1)
    size = BLOCK_HEAD + 32 * width + 5 * extra
    starts = np.r_[0, np.cumsum(size)]
    body = np.zeros(starts[-1], dtype=np.uint8)
    starts = starts[:-1]
    head = np.empty((blocks, BLOCK_HEAD), dtype=np.uint8)
    head[:, :4] = least.astype("<u4")[:, None].view(np.uint8)
    head[:, 4] = width
    head[:, 5:] = extra.astype("<u2")[:, None].view(np.uint8)
    body[starts[:, None] + np.arange(BLOCK_HEAD)] = head
    for w in np.unique(width):
        if w:
            group = np.flatnonzero(width == w)
            mask = np.uint64((1 << int(w)) - 1)
            body[(starts[group] + BLOCK_HEAD)[:, None] + np.arange(32 * w)] = pack_lanes(values[group] & mask, int(w))
    block, position = np.nonzero(over)
    if len(block):
        nth = np.arange(len(block)) - np.r_[0, np.cumsum(extra)][block]
        base = starts[block] + BLOCK_HEAD + 32 * width[block]
        body[base + nth] = position
        at = base + extra[block] + 4 * nth
        body[at[:, None] + np.arange(4)] = values[block, position].astype("<u4")[:, None].view(np.uint8).reshape(-1, 4)
    return HEAD.pack(b"PFB1", n, blocks) + starts.astype("<u8").tobytes() + body.tobytes()


def decode_blocks(body: np.ndarray, starts: np.ndarray) -> np.ndarray:
    head = body[starts[:, None] + np.arange(BLOCK_HEAD)]
    least = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0].astype(np.uint64)
    width = head[:, 4].astype(np.int64)
    extra = np.ascontiguousarray(head[:, 5:]).view("<u2")[:, 0].astype(np.int64)
    values = np.zeros((len(starts), BLOCK), dtype=np.uint64)
    for w in np.unique(width):
        if w:
            group = np.flatnonzero(width == w)
            values[group] = unpack_lanes(body[(starts[group] + BLOCK_HEAD)[:, None] + np.arange(32 * w)], int(w))
    if extra.any():
        block = np.repeat(np.arange(len(starts)), extra)
        nth = np.arange(len(block)) - np.r_[0, np.cumsum(extra)][block]
        base = starts[block] + BLOCK_HEAD + 32 * width[block]
        at = base + extra[block] + 4 * nth
        values[block, body[base + nth]] = np.ascontiguousarray(body[at[:, None] + np.arange(4)]).view("<u4")[:, 0]
    return (values + least[:, None]).astype(np.uint32).ravel()


def decode_frame(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids of a frame, or those from ``start`` to ``stop``; opens only the blocks it needs."""
    magic, n, blocks = HEAD.unpack_from(payload)
    if magic != b"PFB1":
        raise ValueError("not a frame of token ids")
    stop = n if stop is None else min(stop, n)
    start = min(start, stop)
    first, last = start // BLOCK, -(-stop // BLOCK)
    if first >= last:
        return np.zeros(0, dtype=np.uint32)
    starts = np.frombuffer(payload, dtype="<u8", count=blocks, offset=HEAD.size).astype(np.int64)[first:last]
    body = np.frombuffer(payload, dtype=np.uint8, offset=HEAD.size + 8 * blocks)
    return decode_blocks(body, starts)[start - first * BLOCK : stop - first * BLOCK]


class IdEncoder:
    """Ids of texts by the tokenizers library, which sees each piece of text that is new once.

    New pieces go to the library as lines of one text, texts that stand alone go there whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t["content"] for t in pretoken.load_json(path)[2]]
        self.line_break = self.library("\n")
        self.pieces = Memo(self.encode_pieces, pretoken.KNOWN)

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        if len(self.line_break) != 4:
            return [self.library(p if p[0] == "\n" else p[1:] if p[0] == pretoken.MARK else " " + p) for p in pieces]
        out: list[bytes] = []
        leads = "\n" + pretoken.MARK
        (mark,) = struct.unpack("<I", self.line_break)
        for at in range(0, len(pieces), 2000):
            lines = [p[1:] if p[0] in leads else " " + p for p in pieces[at : at + 2000]]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = 4 * np.flatnonzero(ids == mark)
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)], strict=True)]
        return [self.line_break + ids if p[0] == "\n" else ids for p, ids in zip(pieces, out, strict=True)]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text of an Arrow column without nulls."""
        cut = pretoken.Pieces.of(texts, self.specials)
        rest = cut.joined(self.pieces(cut.distinct), len(self.line_break) // 4)
        return [np.frombuffer(self.library(texts[i].as_py()), dtype="<u4") if own else next(rest) for i, own in enumerate(cut.alone)]


@functools.lru_cache(maxsize=2)
def id_encoder(path: str) -> IdEncoder:
    return IdEncoder(path)


FRAMES = "shard int, frame int, first long, lengths array<long>, payload binary"


def frames(df: DataFrame, path: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The frames of all texts: shards are ascending ranges of the key."""
    kind = df.schema[key].dataType
    schema = T.StructType([*T._parse_datatype_string(FRAMES).fields, T.StructField("keys", T.ArrayType(kind))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    end = np.array([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, frame, first = TaskContext.get().partitionId(), 0, 0
        keys, lengths, parts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            payload = encode_frame(np.concatenate(parts))
            columns = [[shard], [frame], [first], [lengths], [payload], [keys]]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for part in chunks(batch, 1, *pretoken.AT_ONCE):
                for k, ids in zip(part.column(0).to_pylist(), id_encoder(path)(pc.fill_null(part.column(1), "")), strict=True):
                    keys.append(k)
                    lengths.append(len(ids) + 1)
                    parts += (ids, end)
                    held += lengths[-1]
                    if held >= FRAME_IDS:
                        yield close()
                        frame, first = frame + 1, first + held
                        keys, lengths, parts, held = [], [], [], 0
        if keys:
            yield close()

    rows = df.select(df[key].alias("__key"), df[text].alias("__text"))
    # The beginning of a text orders as the text does, and keeps the sampled bounds small.
    ranged = rows.repartitionByRange("__key", F.substring("__text", 1, BOUND_CHARS)).sortWithinPartitions("__key", "__text")
    return ranged.mapInArrow(run, schema)


def write(df: DataFrame, folder: str, path: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all texts, each with ``end_id`` after it, in ascending order of the key."""
    frames(df, path, end_id, key, text).write.parquet(folder)


def read(spark: SparkSession, folder: str, key: str = "doc_id", digest_only: bool = False) -> DataFrame:
    """From the files: key, start (ids of all documents before it), n_tokens, ids_crc32 and, unless ``digest_only``, ids."""
    no_clash([key], ["start", "n_tokens", "ids_crc32", "ids"])
    stored = spark.read.parquet(folder)
    kind = stored.schema["keys"].dataType.elementType
    fields = "shard int, local long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<long>")
    schema = T.StructType([T.StructField("__key", kind), *T._parse_datatype_string(fields).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, first, lengths, payload, keys = (batch.column(c)[i].as_py() for c in range(5))
                ids = decode_frame(payload)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [keys, [shard] * len(keys), first + starts, lengths, crc]
                if not digest_only:
                    columns.append([ids[a:b] for a, b in zip(starts, ends, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    documents = stored.select("shard", "first", "lengths", "payload", "keys").mapInArrow(run, schema)
    # One row per shard: their number is that of the files, whatever the number of documents.
    totals = stored.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    joined = documents.join(F.broadcast(before), "shard")
    columns = [F.col("__key").alias(key), (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"]
    return joined.select(*columns, *([] if digest_only else ["ids"]))
