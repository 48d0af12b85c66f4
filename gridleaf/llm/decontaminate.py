"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is found in a document if at least ``SHARE`` of the item's distinct word
shingles (five words) are among the document's.  Plain MinHash cannot see a short item in a
long document, whose signature the item hardly touches, so both sides are partitioned
by size.  Items fall in classes of up to 1, 2, 4, 8, ... shingles.  For each class M that
has items, every document is covered by windows of 2 M shingles, M apart: an item of
the class that stands in the document stands whole in some window and is at least a
fifth of it.  Window and item are candidates if any of ``HASHES`` minima agree; at
Jaccard 0.19 (0.8 of the smallest item of a class) all 64 differ with probability
1.4e-6, and for a whole item 1e-8.  Every candidate document is then verified by exact
containment of shingles, as strings, over its whole text.

Minima of one hash function over blocks of the smallest class are computed once and
combined for larger windows and classes.

The items are a table of queries.  They reach the executors as texts in blocks of a
bounded number and size; each block is a job of its own over the documents, whose
hits (no texts) are appended to one folder before the next one, so that neither the driver nor a worker ever holds
more than a block, however large the benchmark is; a benchmark of k blocks reads the documents k times and ``mark`` writes
them once at most.  An item longer than a block is a block by itself.

Words are split at blanks (ASCII white space, U+00A0), in lower case, without marks at either end.  A text of
1 to 4 words is one shingle, its whole sequence; null texts and texts without words
have none, find nothing and are not found.  Repeated items count once, items of one id and different
texts each; rows of documents are searched each on its own.  Item ids keep their type.  Ties: all items
that a text holds are given.  Very long texts are searched whole, a chunk at a time.  An empty table on either side
gives no hits.  Other columns of either table are not read; a key column named as a result is an error.
"""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridleaf.llm.shared import map_column, no_clash, rolled, scratch, written

WORDS = 5
SHARE = 0.8
HASHES = 64
#: Items, and characters of items, of one block.
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 5_000_000
#: Rows and characters that are searched at once.
CHUNK = (4096, 3_000_000)

_EDGES = r"^[^\pL\pN]+|[^\pL\pN]+$"


def split_words(texts: pa.Array) -> pa.Array:
    """Lists of words, not normal yet."""
    return pc.ascii_split_whitespace(pc.replace_substring(texts, "\xa0", " "))


def normal(words: pa.Array) -> list[str]:
    """Words in lower case without marks at either end; nothing may be left."""
    return pc.replace_substring_regex(pc.utf8_lower(words), _EDGES, "").to_pylist()


def shingles(words: list[str]) -> set[str]:
    """Distinct shingles of normal words."""
    n = len(words)
    if not n:
        return set()
    return {" ".join(words[i : i + WORDS]) for i in range(max(1, n - WORDS + 1))}


def normal_words(text: str) -> list[str]:
    return [w for w in normal(split_words(pa.array([text])).flatten()) if w]


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, text after text, and how many each text has."""
    split = split_words(texts)
    coded = split.flatten().dictionary_encode()
    digest = xxhash.xxh64_intdigest
    distinct = [digest(w, 7) | 1 if w else 0 for w in normal(coded.dictionary)]
    hashes = np.array(distinct, dtype=np.uint64)[coded.indices.to_numpy()]
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    there = hashes != 0
    hashes, owner = hashes[there], owner[there]
    size = np.bincount(owner, minlength=len(texts))
    return rolled(hashes, owner, size, WORDS)


def hash_functions() -> np.ndarray:
    """Odd factors: each orders the (well mixed) shingle hashes in its own way."""
    return np.random.default_rng(2016).integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Items:
    """A block of items, partitioned by size, with their minima."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        self.shingles = [shingles(normal_words(t)) for t in texts]
        self.factors = hash_functions()
        by_class: dict[int, list[int]] = defaultdict(list)
        for i, own in enumerate(self.shingles):
            if own:
                by_class[1 << (len(own) - 1).bit_length()].append(i)
        self.classes = sorted(by_class)
        hashes, count = shingle_hashes(pa.array(texts, type=pa.string()))
        starts = np.r_[0, np.cumsum(count)]
        #: For each class and hash function: sorted minima, their items, a filter of high bits.
        self.minima: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for size, members in by_class.items():
            self.minima[size] = []
            own = np.concatenate([hashes[starts[i] : starts[i + 1]] for i in members])
            at = np.r_[0, np.cumsum(count[members])[:-1]]
            for factor in self.factors:
                low = np.minimum.reduceat(own * factor, at)
                order = np.argsort(low)
                seen = np.zeros(1 << 16, dtype=bool)
                seen[(low >> np.uint64(48)).astype(np.int64)] = True
                self.minima[size].append((low[order], np.array(members)[order], seen))

    def candidates(self, texts: pa.Array) -> dict[int, set[int]]:
        """For texts with any: the items that share a minimum with one of their windows."""
        out: dict[int, set[int]] = defaultdict(set)
        hashes, count = shingle_hashes(texts)
        if not len(hashes) or not self.classes:
            return out
        # Blocks of the smallest class, then of each double size; the last block of a text may be short.
        layers = []
        size = self.classes[0]
        blocks = -(-count // size)
        starts = np.r_[0, np.cumsum(count)[:-1]]
        begins = np.repeat(starts, blocks) + size * (np.arange(blocks.sum()) - np.repeat(np.r_[0, np.cumsum(blocks)[:-1]], blocks))
        while True:
            owner = np.repeat(np.arange(len(texts)), blocks)
            layers.append((size, owner))
            if size >= self.classes[-1]:
                break
            size, blocks = size * 2, -(-blocks // 2)
        halves, product = [], np.empty_like(hashes)
        for (_, now), (_, then) in zip(layers, layers[1:], strict=False):
            first = np.flatnonzero(np.r_[True, now[1:] != now[:-1]])
            place = np.arange(len(now)) - np.repeat(first, np.diff(np.r_[first, len(now)]))
            halves.append(np.flatnonzero(place % 2 == 0))
            assert len(halves[-1]) == len(then)
        for f, factor in enumerate(self.factors):
            low = np.minimum.reduceat(np.multiply(hashes, factor, out=product), begins)
            for layer, (size, owner) in enumerate(layers):
                if layer:
                    low = np.minimum.reduceat(low, halves[layer - 1])
                if size not in self.minima:
                    continue
                window = low.copy()
                window[:-1] = np.where(owner[1:] == owner[:-1], np.minimum(low[1:], low[:-1]), low[:-1])
                values, items, seen = self.minima[size][f]
                at = np.flatnonzero(seen[(window >> np.uint64(48)).astype(np.int64)])
                if not len(at):
                    continue
                left, right = np.searchsorted(values, window[at], "left"), np.searchsorted(values, window[at], "right")
                for i, a, b in zip(at[right > left], left[right > left], right[right > left], strict=True):
                    out[int(owner[i])].update(items[a:b].tolist())
        return out

    def found(self, texts: pa.Array) -> list[list[dict]]:
        """For each text the items it contains, verified: place in the block, shared and all shingles."""
        out: list[list[dict]] = [[] for _ in texts]
        for i, items in self.candidates(texts).items():
            own = shingles(normal_words(texts[i].as_py()))
            for item in sorted(items):
                shared = len(self.shingles[item] & own)
                if shared >= SHARE * len(self.shingles[item]):
                    out[i].append({"item": self.ids[item], "shared": shared, "size": len(self.shingles[item])})
        return out


@functools.lru_cache(maxsize=1)
def _block(ids: tuple, texts: tuple[str, ...]) -> Items:
    """A worker makes the tables of a block once."""
    return Items(list(ids), list(texts))


def _passes(items: DataFrame, item: str, item_text: str) -> Iterator[Pass]:
    """For each block of items the step that finds them, and the type of what it gives."""
    known = items.select(F.col(item).alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    hits = f"array<struct<item: {known.schema['i'].dataType.simpleString()}, shared: bigint, size: bigint>>"
    n, chars = known.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for b in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").collect()
        ids, texts = tuple(r["i"] for r in rows), tuple(r["t"] for r in rows)
        yield lambda found, ids=ids, texts=texts: [_block(ids, texts).found(found)], hits


Pass = tuple[Callable[[pa.Array], list], str]


def _earlier(rows: DataFrame, key: str, text: str, passes: Iterable[Pass]) -> tuple[DataFrame | None, Pass]:
    """The hits of all passes but the last, and the last pass, which is left to do.

    Hits are key and h (an array, never empty), a row for each pass that finds items in a row.  A pass is over, and its hits
    are appended to one folder, before the next one begins; ``rows`` are only read.
    """
    folder, schema, last = None, None, None
    for one in passes:
        if last is not None:
            found = map_column(rows, [key], text, f"h {last[1]}", last[0], CHUNK).where(F.size("h") > 0)
            folder, schema = folder or scratch(rows.sparkSession, "hits"), found.schema
            found.write.mode("append").parquet(folder)
        last = one
    return rows.sparkSession.read.schema(schema).parquet(folder) if folder else None, last


def mark(df: DataFrame, items: DataFrame, keys: list[str], text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """keys and hits: the items found in every text (item, shared and all distinct shingles of the item), by item.

    A benchmark of one block needs one pass beside the rows.  With more the rows are numbered and written once, and the hits of
    earlier blocks, few and without texts, are joined to them by number.
    """
    no_clash(keys, ["hits"])
    passes = _passes(items, item, item_text)
    first, second = next(passes), next(passes, None)
    if second is None:
        return map_column(df, keys, text, f"hits {first[1]}", first[0], CHUNK)
    rows = written(df.select(F.struct(*keys).alias("__keys"), F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__row")), "numbered")
    found, (step, hits) = _earlier(rows, "__row", "__text", itertools.chain((first, second), passes))
    found = written(found.groupBy("__row").agg(F.flatten(F.collect_list("h")).alias("__held")), "found")
    joined = map_column(rows, ["__keys", "__row"], "__text", f"__new {hits}", step, CHUNK).join(found, "__row", "left")
    none = F.array().cast(hits)
    return joined.select("__keys.*", F.array_sort(F.concat(F.coalesce("__held", none), "__new")).alias("hits"))


def search(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item found in it: key, item, shared, size, containment."""
    no_clash([key], [item, "shared", "size", "containment"])
    docs = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    found, (step, hits) = _earlier(docs, "__key", "__text", _passes(items, item, item_text))
    out = map_column(docs, ["__key"], "__text", f"h {hits}", step, CHUNK)
    out = (out if found is None else found.unionByName(out)).select("__key", F.explode("h").alias("h"))
    shared, size = F.col("h.shared"), F.col("h.size")
    return out.select(F.col("__key").alias(key), F.col("h.item").alias(item), shared.alias("shared"), size.alias("size"), (shared / size).alias("containment"))
