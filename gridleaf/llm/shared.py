"""What the operators share: shared scratch folders, Arrow maps over texts, regex words."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession

#: Rows and characters that one step of a Python map holds as Python objects.
CHUNK_ROWS = 1024
CHUNK_CHARS = 2_000_000

#: A word is a run of anything but the ASCII blanks; ``bytes.split()`` splits the same way.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent (tests, one machine) a local one is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        else:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="gridleaf-")
            context.setCheckpointDir(root)
            root = context._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind ``written`` tables that nothing will read again; others that ``df`` reads stay."""
    spark = df.sparkSession
    root = urlparse(scratch(spark, "").rpartition("/")[0]).path.rstrip("/")
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if root and unquote(urlparse(folder).path).startswith(f"{root}/"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def no_clash(keys: Iterable[str], results: Iterable[str]) -> None:
    """An error if a column that is kept has the name of a result (Spark does not tell upper from lower case)."""
    clash = {k.lower() for k in keys} & {r.lower() for r in results}
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be there twice")


def chunks(batch: pa.RecordBatch, text: int | None = None, most_rows: int = CHUNK_ROWS, most_chars: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, bounded in rows and in characters of column ``text``."""
    start, total = 0, batch.num_rows
    if text is None:
        for start in range(0, total, most_rows):
            yield batch.slice(start, most_rows)
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
    held = 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= most_rows or held + n > most_chars):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < total:
        yield batch.slice(start)


def rolled(hashes: np.ndarray, owner: np.ndarray, size: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of so many words, text after text, and how many each text has.

    ``hashes`` are those of the words, none of them 0, ``owner`` the text of each, ``size`` the words of
    each text.  A text of fewer words has one shingle, its whole sequence; one without words has none.
    """
    factor = np.uint64(0x9E3779B97F4A7C15)
    total = np.zeros(len(hashes), dtype=np.uint64)
    place = np.arange(len(hashes)) - np.r_[0, np.cumsum(size)[:-1]][owner]
    for k in range(words):
        reach = np.zeros(len(hashes), dtype=np.uint64)
        reach[: max(0, len(hashes) - k)] = hashes[k:]
        reach[place + k >= size[owner]] = 0
        total = total * factor + reach
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(29)
    count = np.where(size > 0, np.maximum(size - words + 1, 1), 0)
    return total[place < count[owner]], count


def release() -> None:
    """Give freed memory back: a Python worker lives on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps what it freed


def map_column(df: DataFrame, keys: list[str], text: str, schema: str, step: Callable[[pa.Array], list], size: tuple[int, int] = (CHUNK_ROWS, CHUNK_CHARS)) -> DataFrame:
    """Append what ``step`` gives for each chunk of texts to the key columns.

    ``step`` takes an Arrow column of texts (null: empty) and returns one list or array
    per column of ``schema``.  Only the key and text columns reach Python (a text column
    that is also a key only once).  Key columns keep their names and types; a key of the
    same name as a new column is an error.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    new = T._parse_datatype_string(schema)
    no_clash(keys, new.names)
    out = T.StructType([df.schema[k] for k in keys] + list(new.fields))
    arrow = to_arrow_schema(out)
    n = len(keys)
    at = keys.index(text) if text in keys else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, at, *size):
                found = step(pa.compute.fill_null(part.column(at), ""))
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(n)]
                columns += [c.cast(arrow.field(n + i).type) if isinstance(c, pa.Array) else pa.array(c, type=arrow.field(n + i).type) for i, c in enumerate(found)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        release()

    return df.select(*keys, *([] if text in keys else [df[text].alias("__text")])).mapInArrow(run, out)


def map_texts(df: DataFrame, keys: list[str], text: str, schema: str, step: Callable[[list[str]], list]) -> DataFrame:
    """``map_column`` with a step that takes a list of texts."""
    return map_column(df, keys, text, schema, lambda texts: step(texts.to_pylist()))


class Memo:
    """Values of strings, worked out in batches and kept in two generations of bounded size.

    A worker keeps one such table: the one in use empties the one used before it.
    """

    in_use: Memo | None = None

    def __init__(self, work_out: Callable[[list[str]], list], limit: int = 300_000):
        self.work_out, self.limit = work_out, limit
        self.now, self.old = {}, {}

    def __call__(self, words: list[str]) -> list:
        if Memo.in_use is not self:
            if Memo.in_use is not None:
                Memo.in_use.now, Memo.in_use.old = {}, {}
            Memo.in_use = self
        found = list(map(self.now.get, words))
        missing = [i for i, v in enumerate(found) if v is None]
        if missing:
            if len(self.now) + len(missing) > self.limit:
                self.now, self.old = {}, self.now
            old = self.old.get
            again = dict.fromkeys([words[i] for i in missing])
            if self.old:
                for w in again:
                    again[w] = old(w)
            new = [w for w, v in again.items() if v is None]
            again.update(zip(new, self.work_out(new), strict=True))
            self.now.update(again)
            for i in missing:
                found[i] = again[words[i]]
        return found
