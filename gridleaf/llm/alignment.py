"""Alignment of the tokens of two tokenizers by a dictionary of token groups.

A is a byte-level BPE of the tokenizers library, B a sentencepiece model.  Both encode the same bytes: a blank and the
text.  Byte offsets where a token of A and one of B both end cut the two sequences into groups; an A and a
B token that end together are linked.

* Texts are encoded in chunks.  A chunk interns its groups: its documents are lists of codes, and
  each distinct group, spelled ``a1,a2|b1`` (ids), stands once in its dictionary, with how often and in how many documents it is
  found.  A chunk is one row of a table, written once.
* The dictionaries of all chunks meet by group; every distinct group of the corpus is expanded into its links
  once, and its links are multiplied by its frequency (or by its documents).  Sums by pair of ids give
  the count of a pair; its best pairs are those of the highest count of a B id.
* What a group's links add up to is joined back by group, then brought to the chunks, where each document adds up the values of
  its codes.

So no token or link of a document is ever a row: rows are distinct groups of chunks, of the
corpus, and pairs of ids.  A common group is one row a chunk, whatever its share of the corpus.

Most texts are cut before both libraries at single blanks and line breaks, and each piece of text that is new to a worker is
encoded once (where the vocabularies allow it, see ``Aligner.cuts``); other texts go there whole.

A text without tokens (null, empty, or not given back byte by byte by A or B) has zeros and an
empty digest.  Special strings are plain text.  Null keys and repeated rows stay, each a row of its own; ties: all pairs of
the highest count are best.  Texts of any length are encoded whole; a very long one is a chunk by itself.  An empty table gives an empty
one.  Extra columns are not read; a key column named as a result is an error.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridleaf.llm import pretoken
from gridleaf.llm.shared import Memo, chunks, no_clash, release, written

#: Rows and characters of a chunk.
CHUNK = (4096, 2_000_000)
#: Pieces of which a worker keeps the groups, in each of two generations.
KNOWN = 150_000
#: Distinct groups after which a worker forgets those it knows.
GROUPS = 1_000_000
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
BLANK = "▁"


class Aligner:
    """Groups of the tokens that two tokenizers make of the same text."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = {c: byte for byte, c in pretoken.byte_letters().items()}
        vocab, _, added = pretoken.load_json(path_a)
        every = vocab | {t["content"]: t["id"] for t in added}
        self.bytes_a = [b""] * (max(every.values()) + 1)
        for token, i in every.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if set(token) <= set(letters) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.known_a = pa.array(self.bytes_a, type=pa.binary())
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.known_b = pa.array(self.bytes_b, type=pa.binary())
        self.size_a, self.size_b = (np.array(list(map(len, known)), dtype=np.int64) for known in (self.bytes_a, self.bytes_b))
        self.cuts = self._cuts(path_a, pieces)
        #: Groups that this worker has met, by their ids, and how they are spelled.
        self.known: dict[tuple[bytes, bytes], int] = {}
        self.spellings: list[str] = []
        self.pieces = Memo(self.align_pieces, KNOWN)

    def _cuts(self, path_a: str, pieces: list[str]) -> bool:
        """Whether no token of either crosses into a single blank or line break between other characters."""
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or not before.get("use_regex", True) or spec.get("normalizer"):
            return False
        lone = [self.bytes_b[i] for i in self.b.encode("\n")]
        return not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces) and lone == [b" ", b"\n"]

    def given_back(self, texts: list[str]) -> tuple | None:
        """Flat ids of A and of B for texts that begin with a blank or a line break, their ends in bytes, and the tokens of each text.

        Many texts go to the libraries as one, since no token crosses from one piece into the next.  None if a text is not given back byte by byte.
        """
        lines = ["".join(texts[i : i + 256]) for i in range(0, len(texts), 256)]
        raw, stops = "".join(lines).encode(), np.cumsum([len(t.encode()) for t in texts])
        encoded = [e.ids for e in self.a.encode_batch_fast(lines, add_special_tokens=False)]
        # Sentencepiece puts a blank before each text: it stands for that of the text, or is one too many before a line break.
        other = [e if t[0] == " " else e[1:] for t, e in zip(lines, self.b.encode([t.removeprefix(" ") for t in lines], num_threads=1), strict=True)]
        out = []
        for ids, known, size in ((encoded, self.known_a, self.size_a), (other, self.known_b, self.size_b)):
            flat = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int32)
            joined = known.take(pa.array(flat)).cast(pa.large_binary()).buffers()[2]
            ends = np.cumsum(size[flat])
            last = np.searchsorted(ends, stops, "right")
            if (joined.to_pybytes() if joined else b"") != raw or (ends[last - 1] != stops).any():
                return None
            out += [flat, ends, np.diff(np.r_[0, last])]
        return tuple(out)

    def align(self, texts: list[str]) -> list[tuple]:
        """For each text (beginning with a blank or a line break) the codes of its groups as bytes and the tokens of A and B; () for one that is not given back."""
        found = self.given_back(texts) if texts else ()
        if found is None:
            if len(texts) == 1:
                return [()]
            half = len(texts) // 2
            return self.align(texts[:half]) + self.align(texts[half:])
        if not texts:
            return []
        a, ends_a, n_a, b, ends_b, n_b = found
        cuts_a = np.flatnonzero(np.isin(ends_a, ends_b, assume_unique=True)) + 1
        cuts_b = np.flatnonzero(np.isin(ends_b, ends_a, assume_unique=True)) + 1
        raw_a, raw_b, known = a.tobytes(), b.tobytes(), self.known
        at_a, at_b = (4 * np.r_[0, cuts] for cuts in (cuts_a, cuts_b))
        codes = np.fromiter(
            (known.setdefault((raw_a[i:j], raw_b[k:m]), len(known)) for (i, j), (k, m) in zip(itertools.pairwise(at_a.tolist()), itertools.pairwise(at_b.tolist()), strict=True)), dtype=np.int32, count=len(cuts_a)
        ).tobytes()
        ends = 4 * np.searchsorted(cuts_a, np.cumsum(n_a), "right")
        return [(codes[i:j], x, y) for (i, j), x, y in zip(itertools.pairwise([0, *ends.tolist()]), n_a.tolist(), n_b.tolist(), strict=True)]

    def align_pieces(self, pieces: list[str]) -> list[tuple]:
        """Pieces that stand after a blank or begin with a line break."""
        out = []
        for at in range(0, len(pieces), 20_000):
            part = [p if p[0] == "\n" else " " + p for p in pieces[at : at + 20_000]]
            # What holds the mark that stands for a blank in B's pieces is never given back.
            lost = [BLANK in p for p in part]
            rest = iter(self.align([p for p, no in zip(part, lost, strict=True) if not no]))
            out += [() if no else next(rest) for no in lost]
        return out

    def spelled(self, codes: np.ndarray) -> list[str]:
        """Groups of this worker as ``a1,a2|b1``."""
        fresh = list(itertools.islice(self.known, len(self.spellings), None))
        self.spellings += ["|".join(",".join(map(str, np.frombuffer(ids, dtype=np.int32).tolist())) for ids in group) for group in fresh]
        return [self.spellings[c] for c in codes.tolist()]

    def __call__(self, texts: pa.Array, documents: bool = False) -> Chunk:
        """All texts of an Arrow column without nulls; ``documents`` counts those that hold each group."""
        if len(self.known) > GROUPS:
            self.known, self.spellings = {}, []
            self.pieces.now, self.pieces.old = {}, {}
        alone = pc.match_substring_regex(texts, pretoken.OTHER_BLANKS) if self.cuts else pa.array([True] * len(texts), pa.bool_())
        listed = pc.split_pattern(pc.replace_substring(texts.filter(pc.invert(alone)), "\n", " \n"), " ")
        coded = listed.flatten().dictionary_encode()
        found = self.pieces(coded.dictionary.to_pylist())
        alone = alone.to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(alone).tolist():
            text = texts[i].as_py()
            found += self.align([" " + text]) if text else [()]
        # A text is a list of places in one list: the distinct pieces, then the texts that stand alone.
        size = np.ones(len(texts), dtype=np.int64)
        size[~alone] = pc.list_value_length(listed).to_numpy()
        places = np.empty(size.sum(), dtype=np.int64)
        starts = np.r_[0, np.cumsum(size)]
        places[np.repeat(~alone, size)] = coded.indices.to_numpy()
        places[starts[:-1][alone]] = len(found) - alone.sum() + np.arange(alone.sum())
        return Chunk(self, found, places, starts, documents)


class Chunk:
    """Texts as lists of codes of the distinct groups they hold."""

    def __init__(self, own: Aligner, found: list[tuple], places: np.ndarray, starts: np.ndarray, documents: bool):
        lost = np.fromiter((not f for f in found), dtype=bool, count=len(found))
        good = ~np.maximum.reduceat(lost[places], starts[:-1]) if len(starts) > 1 else np.zeros(0, dtype=bool)
        # Texts that are not given back hold nothing.
        places = places[np.repeat(good, np.diff(starts))]
        starts = np.r_[0, np.cumsum(np.where(good, np.diff(starts), 0))]
        size = np.fromiter((len(f[0]) // 4 if f else 0 for f in found), dtype=np.int64, count=len(found))
        flat = np.frombuffer(b"".join([f[0] for f in found if f]), dtype=np.int32)
        taken = pa.ListArray.from_arrays(np.r_[0, np.cumsum(size)].astype(np.int32), flat).take(pa.array(places))
        codes = taken.flatten().to_numpy()
        ends = np.r_[0, np.cumsum(size[places])][starts]
        self.n_groups = np.diff(ends)
        self.n_a, self.n_b = (np.diff(np.r_[0, np.cumsum(np.array([f[k] if f else 0 for f in found], dtype=np.int64)[places])][starts]) for k in (1, 2))
        # The chunk's own codes: those of the worker that are there, in their order.
        count = np.bincount(codes, minlength=1)
        there = np.flatnonzero(count)
        self.groups, self.counts = own.spelled(there), count[there]
        self.codes = (np.cumsum(count > 0) - 1)[codes].astype(np.uint16 if len(there) <= 1 << 16 else np.uint32)
        spelled = pa.array(self.groups, type=pa.large_string()).take(pa.array(self.codes))
        joined = pc.binary_join(pa.ListArray.from_arrays(ends.astype(np.int32), spelled), pa.scalar(";", pa.large_string()))
        self.digests = [hashlib.sha256(s.as_buffer()).hexdigest() if ok else "" for s, ok in zip(joined, good.tolist(), strict=True)]
        self.documents = None
        if documents:
            owner = np.repeat(np.arange(len(self.n_groups)), self.n_groups)
            self.documents = np.bincount(np.unique(owner * max(1, len(there)) + self.codes) % max(1, len(there)), minlength=len(there))


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


FIELDS = "chunk long, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, codes binary, groups array<string>, counts array<long>, documents array<long>"


def encode(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", documents: bool = False) -> DataFrame:
    """One row a chunk of documents (``FIELDS`` and keys): the encoded documents and the dictionary of their groups.

    Codes are unsigned numbers of 16 or 32 bits, as the dictionary needs; ``documents`` are null unless asked for.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*T._parse_datatype_string(FIELDS).fields, T.StructField("keys", T.ArrayType(df.schema[key].dataType))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in chunks(batch, 1, *CHUNK):
                c = aligner(path_a, path_b)(pc.fill_null(part.column(1), ""), documents)
                columns = [number, c.n_a, c.n_b, c.n_groups, c.digests, c.codes.tobytes(), c.groups, c.counts, c.documents, part.column(0).to_pylist()]
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(columns, arrow, strict=True)], schema=arrow)
        release()

    return df.select(df[key].alias("__key"), df[text].alias("__text")).mapInArrow(run, schema)


def dictionary(encoded: DataFrame) -> DataFrame:
    """group, n (how often) and documents (how many hold it), a row for each distinct group of the corpus."""
    none = F.transform("groups", lambda g: F.lit(None).cast("long"))
    own = encoded.select("groups", "counts", F.coalesce("documents", none).alias("documents"))
    own = own.select(F.explode(F.arrays_zip("groups", "counts", "documents")).alias("g")).select("g.*")
    return own.groupBy(F.col("groups").alias("group")).agg(F.sum("counts").alias("n"), F.sum("documents").alias("documents"))


def links(groups: DataFrame, path_a: str, path_b: str, weight: str = "n") -> DataFrame:
    """group, a, b and n: the links of each distinct group, n times its ``weight`` (``n`` or ``documents``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in batches:
            out = []
            for group, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (list(map(int, ids.split(","))) for ids in group.split("|"))
                ends_a, ends_b = (np.cumsum([len(known[i]) for i in ids]).tolist() for ids, known in ((a, own.bytes_a), (b, own.bytes_b)))
                at_b: dict[int, list[int]] = {}
                for i, end in zip(b, ends_b, strict=True):
                    at_b.setdefault(end, []).append(i)
                out += [(group, i, j, n) for i, end in zip(a, ends_a, strict=True) for j in at_b.get(end, ())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["group", "a", "b", "n"])

    return groups.select("group", weight).mapInArrow(run, "group string, a int, b int, n long")


def pairs(linked: DataFrame) -> DataFrame:
    """a, b, count and best (no A id has a higher count with this B id); a B id has as many rows as A ids at most."""
    counted = linked.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counted.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def align(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", weight: str = "n") -> DataFrame:
    """key and ``RESULTS`` of every text; a pair's count is of its links (``n``) or of the ``documents`` of its groups."""
    from pyspark.sql.pandas.types import to_arrow_schema

    no_clash([key], RESULTS)
    encoded = written(encode(df, path_a, path_b, key, text, weight == "documents"), "encoded")
    linked = written(links(dictionary(encoded), path_a, path_b, weight), "linked")
    counted = written(pairs(linked), "pairs")
    values = linked.join(counted, ["a", "b"]).groupBy("group").agg(F.count("*").alias("n_links"), F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
    own = encoded.select(F.col("chunk").alias("of"), F.posexplode("groups").alias("code", "group"))
    valued = own.join(values, "group").select("of", "code", "n_links", "n_best", "count_sum")
    schema = T.StructType([df.schema[key], *T._parse_datatype_string(", ".join(f"{c} {'string' if c == RESULTS[-1] else 'long'}" for c in RESULTS)).fields])
    arrow = to_arrow_schema(schema)

    def add_up(documents: pa.Table, found: pa.Table) -> pa.Table:
        if not documents.num_rows:
            return arrow.empty_table()
        keys, n_a, n_b, n_groups, digests = (documents.column(c)[0].values for c in ("keys", "n_a", "n_b", "n_groups", "digests"))
        raw, starts, sums = documents.column("codes")[0].as_py(), np.r_[0, np.cumsum(n_groups.to_numpy())], []
        codes = np.frombuffer(raw, dtype=np.uint16 if len(raw) == 2 * starts[-1] else np.uint32)
        for name in ("n_links", "n_best", "count_sum"):
            value = np.zeros(found.num_rows, dtype=np.int64)
            value[found.column("code").to_numpy()] = found.column(name).to_numpy()
            sums.append(pa.array(np.diff(np.r_[0, np.cumsum(value[codes])][starts])))
        return pa.table([c.cast(f.type) for c, f in zip((keys, n_a, n_b, n_groups, *sums, digests), arrow, strict=True)], schema=arrow)

    held = encoded.select("chunk", "keys", "n_a", "n_b", "n_groups", "digests", "codes")
    return held.groupBy("chunk").cogroup(valued.groupBy("of")).applyInArrow(add_up, schema)
