"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least ``SHARE``.

Texts are first brought together in families, whose members are then compared by their whole shingle sets.

* Each text has two 64-bit fingerprints: of its set of words, which a changed word hardly
  moves, and of its set of shingles.  The Golay keys are made of the first
  (``simhash.near_keys``); twelve more keys are made of two least shingles each, by 24 hash functions: at 0.8 all of them differ for 5 pairs in a million.
  Texts that share a key are kin if they differ in at most ``LIMITS`` bits in the two, and a family is what kin of kin reach.  The search gives as many edges as
  join a family, not all pairs of kin.
* Each distinct text of a family has its shingle set sent to its family once.  A family is compared by one task at a time if its
  sets weigh no more than ``BLOCK``; a heavier one is dealt into blocks, and each pair of blocks is compared for itself.
* Within a block every pair of different classes is decided exactly: a set is held against those that share one of its
  rarest shingles (two sets at 0.8 share one of the rarest fifth of either) or, where those are many, against the rarest three tenths of all sets of
  fitting size, which must not miss too many; what is left, by whole sets.  Members that a class has reached are asked no
  further, so a block gives fewer links than members.

So each pair in a family at ``SHARE`` or above is in one class, however dense the family is, and however it is dealt into runs and
blocks.  A pair is missed only if no chain of kin joins it; the README has the measured recall.  No other texts are linked.

Similarity is that of whole sets of 64-bit shingle hashes.  Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in
lower case; a text of 1 to 4 words is one shingle, its whole sequence.  Null and empty texts and texts
without words are alike.  Equal texts and repeated rows are compared once and are of one class; a class is named by its least row, so
there are no ties.  Very long texts are taken whole, a set heavier than a block is a block by itself.  An empty table gives an empty one;
extra columns are not read; a row column named component_id is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridleaf.llm.components import components
from gridleaf.llm.shared import discard, map_column, no_clash, release, rolled, written
from gridleaf.llm.simhash import LONG, near_keys, search

WORDS = 5
SHARE = 0.8
#: Most differing bits of the fingerprints of words and of shingles.
LIMITS = (16, 18)
#: Keys of least shingles a text has, and the hash functions of each.
BANDS = (12, 2)
#: Shingles (64 a set at least) of one block of a family that a task holds.
BLOCK = 2_000_000


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (not 0) of all words, text after text, the text of each, and the words of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    digest = xxhash.xxh64_intdigest
    distinct = np.array([digest(w) | 1 if w else 0 for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    hashes = distinct[coded.indices.to_numpy()] if len(distinct) else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    there = hashes != 0
    hashes, owner = hashes[there], owner[there]
    return hashes, owner, np.bincount(owner, minlength=len(texts))


def _sets(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, ascending, and the text of each."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], owner[fresh]


def _majority(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the distinct hashes of n texts: a bit is set if it is in over half of them."""
    hashes, owner = _sets(hashes, owner)
    count = np.zeros((n, 64), dtype=np.int32)
    for at in range(0, len(hashes), 200_000):
        bits = np.unpackbits(hashes[at : at + 200_000].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[at : at + 200_000]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        count[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    size = np.bincount(owner, minlength=n)
    return np.packbits(2 * count > size[:, None], axis=1, bitorder="little").view("<u8")[:, 0].view(np.int64)


def shingle_sets(texts: pa.Array) -> pa.Array:
    """For each text its distinct shingle hashes, ascending as unsigned numbers; one 0 for a text without words."""
    hashes, owner, size = _words(texts)
    shingles, count = rolled(hashes, owner, size, WORDS)
    held, owner = _sets(np.r_[shingles, np.zeros((size == 0).sum(), dtype=np.uint64)], np.r_[np.repeat(np.arange(len(texts)), count), np.flatnonzero(size == 0)])
    return pa.ListArray.from_arrays(np.r_[0, np.cumsum(np.bincount(owner, minlength=len(texts)))].astype(np.int32), held.view(np.int64))


def counted_sets(texts: pa.Array) -> list:
    """How many, and ``shingle_sets``."""
    sets = shingle_sets(texts)
    return [pc.list_value_length(sets), sets]


def _bands(shingles: np.ndarray, count: np.ndarray) -> pa.Array:
    """For each text the keys of ``BANDS``, above those of Golay codes; none for a text without shingles."""
    bands, rows = BANDS
    there = np.flatnonzero(count)
    at = (np.cumsum(count) - count)[there]
    out = np.zeros((len(there), bands), dtype=np.uint64)
    if len(there):
        factors = np.random.default_rng(8).integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for i, factor in enumerate(factors):
            low = np.minimum.reduceat(shingles * factor, at)
            out[:, i // rows] = (out[:, i // rows] ^ low) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i // rows)
    found = (out >> np.uint64(2)) | np.uint64(1 << 62)
    return pa.ListArray.from_arrays(np.r_[0, np.cumsum(np.where(count > 0, bands, 0))].astype(np.int32), found.ravel().view(np.int64))


def signatures(texts: pa.Array) -> list:
    """Fingerprints of the words and of the shingles, keys of least shingles, and a digest of each text."""
    hashes, owner, size = _words(texts)
    shingles, count = rolled(hashes, owner, size, WORDS)
    n = len(texts)
    digests = [xxhash.xxh3_128_digest(t) for t in texts.to_pylist()]
    return [_majority(hashes, owner, n), _majority(shingles, np.repeat(np.arange(n), count), n), _bands(shingles, count), digests]


def set_links(codes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """Links (positions) that join what all pairs of sets with a Jaccard similarity of ``SHARE`` join; sets are ranges of ascending distinct codes."""
    n, size = len(starts) - 1, np.diff(starts)
    if n == 2:
        shared = len(np.intersect1d(codes[: starts[1]], codes[starts[1] :], assume_unique=True))
        return [(0, 1)] if shared / (len(codes) - shared) >= SHARE else []
    # Sets in order of their size, shingles in order of how few sets hold them.
    by_size = np.argsort(size, kind="stable")
    distinct, codes, count = np.unique(codes, return_inverse=True, return_counts=True)
    rank = np.empty(len(distinct), dtype=np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(distinct))
    place = np.empty(n, dtype=np.int64)
    place[by_size] = np.arange(n)
    codes, owner = rank[codes], np.repeat(place, size)
    codes = codes[np.lexsort((codes, owner))]
    size = size[by_size]
    starts = np.r_[0, np.cumsum(size)]
    head = size - np.ceil(SHARE * size - 1e-9).astype(np.int64) + 1
    within = np.arange(len(codes)) - np.repeat(starts[:-1], size)
    in_head = within < np.repeat(head, size)
    holders = np.repeat(np.arange(n), head)[np.argsort(codes[in_head], kind="stable")]
    lists = np.r_[0, np.cumsum(np.bincount(codes[in_head], minlength=len(distinct)))]
    wide = np.minimum(size, (3 * size + 9) // 10)
    wide_codes, wide_starts = codes[within < np.repeat(wide, size)], np.r_[0, np.cumsum(wide)]
    own = np.zeros(len(distinct), dtype=bool)
    waiting = np.ones(n, dtype=bool)

    def close_to(x: int) -> np.ndarray:
        """The waiting sets similar to set x."""
        mine = codes[starts[x] : starts[x + 1]]
        low, high = np.searchsorted(size, SHARE * size[x] - 1e-9, "left"), np.searchsorted(size, size[x] / SHARE + 1e-9, "right")
        own[mine] = True
        spans = [(lists[c], lists[c + 1]) for c in mine[: head[x]]]
        if sum(b - a for a, b in spans) < high - low:
            others = np.unique(np.concatenate([holders[a:b] for a, b in spans]))
            others = others[waiting[others] & (others >= low) & (others < high)]
        else:
            missed = np.add.reduceat(~own[wide_codes[wide_starts[low] : wide_starts[high]]], wide_starts[low:high] - wide_starts[low], dtype=np.int64)
            # Of a similar set at most so many shingles are not in x.
            most = size[low:high] - np.ceil(SHARE / (1 + SHARE) * (size[x] + size[low:high]) - 1e-9)
            others = low + np.flatnonzero((missed <= most) & waiting[low:high])
        if len(others):
            reach = size[others]
            at = np.repeat(starts[others], reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
            shared = np.add.reduceat(own[codes[at]], np.cumsum(reach) - reach, dtype=np.int64)
            others = others[shared / (size[x] + reach - shared) >= SHARE]
        own[mine] = False
        return others

    out = []
    for root in range(n):
        if not waiting[root]:
            continue
        waiting[root] = False
        queue = [root]
        while queue:
            x = queue.pop()
            reached = close_to(x)
            waiting[reached] = False
            out += [(int(by_size[x]), int(by_size[y])) for y in reached]
            queue += reached.tolist()
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (cell, row, s) in the order of cells."""
    cell, rows, sets = None, [], []

    def links() -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            found = set_links(np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([rows[pair[side]] for pair in found], pa.int64()) for side in (0, 1)], names=["a", "b"])

    for batch in batches:
        values, ends = batch.column(2).flatten().to_numpy(), batch.column(2).offsets.to_numpy()
        ends = ends - ends[0]
        for i, (c, row) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if c != cell:
                yield from links()
                cell, rows, sets = c, [], []
            rows.append(row)
            sets.append(values[ends[i] : ends[i + 1]].copy())
    yield from links()
    release()


def similar_links(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """``sets`` (family, row, n, s): links (a, b) that join what all similar pairs of a family join.

    A set weighs its ``n`` shingles, 64 at least; families heavier than ``block`` are dealt into blocks of half of it.
    """
    weight = F.greatest("n", F.lit(64))
    heavy = written(sets.groupBy("family").agg(F.ceil(2 * F.sum(weight) / block).alias("blocks")).where("blocks > 2"), "heavy")
    dealt = sets.join(heavy, "family", "left").withColumn("i", F.pmod(F.xxhash64("row"), "blocks"))
    # A member of a heavy family goes to every pair of blocks that its own is one of.
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    cells = dealt.select("family", "row", "s", "i", F.explode(others).alias("j"))
    cells = cells.select(F.xxhash64("family", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), "row", "s")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare, "a long, b long")


def classes(df: DataFrame, row: str = "row", text: str = "text", longest: int = LONG, block: int = BLOCK) -> DataFrame:
    """``row`` and ``component_id``, the least row of its class, of every row of ``df``.

    ``row`` numbers the rows (long, without nulls or repeats) and must be the same whenever ``df`` is read.
    """
    no_clash([row], ["component_id"])
    docs = df.select(F.col(row).alias("row"), F.col(text).alias("text"))
    marked = written(map_column(docs, ["row"], "text", "f0 long, f1 long, bands array<long>, digest binary", signatures), "signatures")
    texts = written(marked.groupBy("digest").agg(F.min("row").alias("row"), F.min("f0").alias("f0"), F.min("f1").alias("f1"), F.min("bands").alias("bands")), "texts")
    prints = written(texts.groupBy("f0", "f1").agg(F.min("row").alias("row"), F.count("*").alias("n"), F.min("bands").alias("bands")), "prints")
    found = search(prints.select("f0", "f1", "bands"), near_keys, LIMITS, star=True, longest=longest)
    ends = [prints.select(F.col("f0").alias(f"{s}0"), F.col("f1").alias(f"{s}1"), F.col("row").alias(s)) for s in "ab"]
    kin = components(found.distinct().join(ends[0], ["a0", "a1"]).join(ends[1], ["b0", "b1"]).select("a", "b"))
    # Families of fingerprints, and fingerprints of several texts.
    family = prints.join(kin.withColumnRenamed("node", "row"), "row", "left").where("root is not null or n > 1")
    members = texts.join(family.select("f0", "f1", F.coalesce("root", "row").alias("family")), ["f0", "f1"]).select("row", "family")
    members = written(members, "members")
    for done in (found, kin, prints):
        discard(done)
    # Members grow with the corpus, so texts are dealt out by row at every size; only those of families go on.
    joined = docs.join(members.hint("merge"), "row")
    sets = written(map_column(joined, ["family", "row"], "text", "n long, s array<long>", counted_sets), "sets")
    linked = written(similar_links(sets, block), "similar")
    discard(sets)
    discard(members)
    rooted = components(linked)
    discard(linked)
    final = texts.join(rooted.withColumnRenamed("node", "row"), "row", "left").select("digest", F.coalesce("root", "row").alias("class"))
    return marked.join(final, "digest").select(F.col("row").alias(row), F.col("class").alias("component_id"))
