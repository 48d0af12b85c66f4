"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprint: 64 bits; a bit is set if it is set in over half of the XXH64 hashes
(seed 42) of the document's word shingles.  Two fingerprints link at ``BITS`` or
fewer differing bits.

Search: a fingerprint is cut into three segments (22, 21 and 21 bits), each seen as
a word of the perfect binary Golay code [23, 12, 7].  ``near(x)``, the codewords
that the words within one bit of x decode to, has 1 or 6 members, and

* segments that differ in at most two bits have a codeword in common;
* if they differ in at most one bit, the codeword of one is near the other.

Of four differing bits, some two segments have at most two between them
(pigeonhole): either one of the two is equal and the other has two at most, or both
have one at most.  So the keys of a fingerprint are, for each ordered pair of
segments, the one segment itself with each codeword near the other ("even" keys),
and for each pair the two codewords, once as its own and once with all near ones
("odd" keys, where one of two must stand as its own).  Fingerprints that share a key
are compared, on one path for every size of input.

``wide_keys`` are, for each pair of segments, all near codewords of both: sure to meet
up to five bits, where two segments have two each at most, and mostly up to eight.  ``near_keys`` are those
of them that hold an own codeword, a third as many, sure up to four bits.

Only distinct fingerprints are compared, so exact copies cost nothing.  The members
of a key are streamed in key order; short runs are compared by sliding the run over
itself, others by a table of distances or, where most of a run is close, by a search
from member to member that compares each with those not reached yet and emits a
spanning forest: components stay whole, and never all pairs of a group.  A run of over
``LONG`` members is not held by its task: its key is noted, and in a second pass its
members are dealt into blocks and each pair of blocks is compared by a task of its own.

Null and empty texts have fingerprint 0, linked like any other.  Null keys keep their
row; the component id is the least non-null key of the component.  Repeated rows are
exact copies, each with a row of its own.  Ties: of equal counts a bit is not set.  Very
long texts are hashed whole, shingle hashes summed in parts.  An empty table gives an
empty one.  Extra columns, whatever their names, are not read; a key column named as a result is an error.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridleaf.llm.components import components
from gridleaf.llm.shared import map_texts, no_clash, written

WORDS = 4
SEED = 42
BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Runs of a key up to this length are compared by sliding.
SHORT = 24
#: Members of a key that one task compares; longer runs are split into pairs of blocks.
LONG = 32_768
#: The first tag of odd keys.
ODD = 6

_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    tokens = text.encode().translate(_LOWER).split()
    n = len(tokens)
    if not n:
        return 0
    joined = b" ".join(tokens)
    if n <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=n) + 1)
    starts = np.r_[0, ends[:-1]].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=False)], dtype="<u8")
    count = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp, the fingerprint as a signed long."""

    def step(texts: list[str]) -> list:
        return [np.array([fingerprint(t) for t in texts], dtype=np.uint64).astype(np.int64)]

    return map_texts(df, [key], text, "fp long", step)


@functools.lru_cache(maxsize=1)
def golay() -> np.ndarray:
    """The index of the codeword that each 23-bit word decodes to."""
    polynomial = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code

    def syndrome(words: np.ndarray) -> np.ndarray:
        rest = words.copy()
        for bit in range(22, 10, -1):
            rest = np.where((rest >> bit) & 1, rest ^ (polynomial << (bit - 11)), rest)
        return rest

    units = 1 << np.arange(23)
    errors = np.array([0, *units, *(a | b for i, a in enumerate(units) for b in units[:i]), *(a | b | c for i, a in enumerate(units) for j, b in enumerate(units[:i]) for c in units[:j])], dtype=np.int64)
    leader = np.full(2048, -1, dtype=np.int64)
    leader[syndrome(errors)] = errors
    assert (leader >= 0).all(), "not the perfect code"
    index = np.empty(1 << 23, dtype=np.int16)
    for at in range(0, 1 << 23, 1 << 19):  # in parts, for the sake of memory
        words = np.arange(at, at + (1 << 19), dtype=np.int64)
        index[words] = (words ^ leader[syndrome(words)]) >> 11
    return index


def near(words: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices near each word; repeats of the first where there is one only."""
    index = golay()
    out = np.empty((24, len(words)), dtype=np.int16)
    out[0] = index[words]
    for bit in range(23):
        out[bit + 1] = index[words ^ (1 << bit)]
    out.sort(axis=0)
    fresh = np.r_[np.ones((1, len(words)), dtype=bool), out[1:] != out[:-1]]
    rank = np.cumsum(fresh, axis=0) - 1
    found = np.repeat(out[:1], 6, axis=0)
    at, column = np.nonzero(fresh)
    found[rank[at, column], column] = out[at, column]
    return found.T.astype(np.int64)


def _parts(fps: np.ndarray) -> list[np.ndarray]:
    return [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def _distinct(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each row without repeats, and the row of each."""
    flat = np.concatenate(found, axis=1)
    flat.sort(axis=1)
    fresh = np.c_[np.ones((len(flat), 1), dtype=bool), flat[:, 1:] != flat[:, :-1]]
    return flat[fresh], np.repeat(np.arange(len(flat)), fresh.sum(axis=1))


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of unsigned fingerprints and the index of the fingerprint of each."""
    parts, n = _parts(fps), len(fps)
    around = [near(p) for p in parts]
    found = []
    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))):
        found.append((tag << 40) | (parts[i][:, None] << 12) | around[j])
    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 2)), ODD):  # a codeword of its own is among the near ones
        found.append((tag << 40) | ((around[i][:, :, None] << 12) | around[j][:, None, :]).reshape(n, 36))
    return _distinct(found)


def own_of(key: int, fps: np.ndarray) -> np.ndarray | None:
    """Which fingerprints have the codewords of an odd key as their own; None for an even key."""
    tag = key >> 40
    if tag < ODD:
        return None
    i, j = ((0, 1), (0, 2), (1, 2))[tag - ODD]
    parts, index = _parts(fps), golay()
    return ((index[parts[i]].astype(np.int64) << 12) | index[parts[j]]) == key & ((1 << 24) - 1)


def wide_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of segments all near codewords of both."""
    around, n = [near(p) for p in _parts(fps)], len(fps)
    return _distinct([(tag << 40) | ((around[i][:, :, None] << 12) | around[j][:, None, :]).reshape(n, 36) for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 2)))])


def near_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of segments the own codeword of either with all near ones of the other: sure to meet up to four bits, as ``keys`` do."""
    around, index, n = [near(p) for p in _parts(fps)], golay(), len(fps)
    own, found = [index[p].astype(np.int64)[:, None] for p in _parts(fps)], []
    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        found += [(tag << 40) | (np.broadcast_to(own[i], (n, 6)) << 12) | around[j], (tag << 40) | (around[i] << 12) | own[j]]
    return _distinct(found)


Columns = tuple[np.ndarray, ...]
Limits = tuple[int, ...]


def _close(columns: Columns, limits: Limits, some: np.ndarray | int, others: np.ndarray | slice) -> np.ndarray:
    """Whether fingerprints (positions) differ in at most so many bits in every column."""
    near_by = [np.bitwise_count(c[some] ^ c[others]) <= most for c, most in zip(columns, limits, strict=True)]
    return functools.reduce(np.logical_and, near_by)


def forest(columns: Columns, limits: Limits) -> np.ndarray:
    """A spanning forest of the links among fingerprints: rows of root, parent and member (positions); a root is the first of its tree."""
    links: list[np.ndarray] = []
    rest = np.arange(len(columns[0]))
    while len(rest) > 1:
        root = int(rest[0])
        queue, rest = [root], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            close = _close(columns, limits, at, rest)
            if close.any():
                reached = rest[close]
                links.append(np.stack([np.full(len(reached), root), np.full(len(reached), at), reached], axis=1))
                queue += reached.tolist()
                rest = rest[~close]
    return np.concatenate(links) if links else np.zeros((0, 3), dtype=np.int64)


def close_pairs(columns: Columns, limits: Limits, rows: np.ndarray, most: int) -> np.ndarray | None:
    """All pairs of ``rows`` (positions) with any other fingerprint that are close; None if there are over ``most``."""
    out, found, n = [np.zeros((0, 2), dtype=np.int64)], 0, len(columns[0])
    step = max(1, (1 << 21) // n)
    for i in range(0, len(rows), step):
        part = rows[i : i + step]
        a, b = np.nonzero(_close(columns, limits, part[:, None], np.arange(n)))
        a = part[a]
        pairs = np.stack([a, b], axis=1)[a != b]
        found += len(pairs)
        if found > most:
            return None
        out.append(pairs)
    return np.concatenate(out)


def hub_edges(columns: Columns, tree: np.ndarray) -> np.ndarray:
    """For each tree of a forest the edges of its hub, the member nearest to the majority of all their bits."""
    out = [np.zeros((0, 2), dtype=np.int64)]
    order = np.argsort(tree[:, 0], kind="stable")
    for part in np.split(tree[order], np.flatnonzero(np.diff(tree[order, 0])) + 1):
        if len(part):
            members = np.r_[part[:1, 0], part[:, 2]]
            apart = np.zeros(len(members), dtype=np.int64)
            for c in columns:
                bits = np.unpackbits(c[members].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
                apart += (bits != (2 * bits.sum(axis=0, dtype=np.int64) > len(members))).sum(axis=1)
            hub = members[apart.argmin()]
            out.append(np.stack([np.full(len(members) - 1, hub), members[members != hub]], axis=1))
    return np.concatenate(out)


def run_links(key: np.ndarray, columns: Columns, limits: Limits, star: bool = False, owned: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) among whole runs of equal sorted keys, the lesser fingerprint first, without repeats.

    With ``star`` a run of as many close pairs as members, or more, gives the edges of its hubs in their place, which need not be close: fewer than members;
    with ``owned`` only pairs of odd keys count of which one has the codewords as its own.
    """
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    left, right = [starts[:0]], [starts[:0]]
    short = np.flatnonzero(np.repeat((sizes <= SHORT) & (sizes > 1), sizes))
    for lag in range(1, SHORT):
        a, b = short[:-lag], short[lag:]
        same = key[a] == key[b]
        if not same.any():
            break
        a, b = a[same], b[same]
        close = _close(columns, limits, a, b)
        left.append(a[close])
        right.append(b[close])
    apart = sizes > SHORT
    if star:
        a, b = np.concatenate(left), np.concatenate(right)
        run = np.searchsorted(starts, a, "right") - 1
        dense = np.bincount(run, minlength=len(sizes)) >= sizes
        left, right = [a[~dense[run]]], [b[~dense[run]]]
        apart |= dense
    for s, n in zip(starts[apart].tolist(), sizes[apart].tolist(), strict=True):
        own = [c[s : s + n] for c in columns]
        order = np.lexsort(own[::-1])
        own = tuple(c[order] for c in own)
        asked = own_of(int(key[s]), own[0]) if owned else None
        pairs = close_pairs(own, limits, np.arange(n) if asked is None else np.flatnonzero(asked), n - 1 if star else 8 * n)
        if pairs is None:
            tree = forest(own, limits)
            pairs = hub_edges(own, tree) if star else tree[:, [1, 2]]
        left.append(s + order[pairs[:, 0]])
        right.append(s + order[pairs[:, 1]])
    a, b = np.concatenate(left), np.concatenate(right)
    # Of a pair the lesser one first; a pair that several keys or copies of a row give counts once.
    less, same = np.zeros(len(a), dtype=bool), np.ones(len(a), dtype=bool)
    for c in columns:
        less |= same & (c[a] < c[b])
        same &= c[a] == c[b]
    a, b = np.where(less, a, b)[~same], np.where(less, b, a)[~same]
    values = [*(c[a] for c in columns), *(c[b] for c in columns)]
    order = np.lexsort(values[::-1])
    fresh = np.zeros(len(order), dtype=bool)
    for v in values:
        fresh[1:] |= v[order][1:] != v[order][:-1]
    fresh[:1] = True
    return a[order][fresh], b[order][fresh]


def _compare(batches: Iterator[pa.RecordBatch], limits: Limits, star: bool, owned: bool, longest: int | None) -> Iterator[pa.RecordBatch]:
    """Links of rows (key, fingerprint columns) in key order: the columns of the one and of the other.

    For each run of over ``longest`` members, which is not held, (key, nulls).
    """
    names = [f"{side}{i}" for side in "ab" for i in range(len(limits))]
    waiting: list[list[np.ndarray]] = []
    fresh, over = 0, None

    def out(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k = rows[0]
        if longest is not None and len(k) > longest:
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            sizes = np.diff(np.r_[starts, len(k)])
            yield from noted(k[starts[sizes > longest]])
            held = np.repeat(sizes <= longest, sizes)
            rows = [r[held] for r in rows]
        if len(rows[0]):
            columns = tuple(rows[1:])
            a, b = run_links(rows[0], columns, limits, star, owned)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(c[at].view(np.int64)) for at in (a, b) for c in columns], names=names)

    def noted(k: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k), *[pa.nulls(len(k), pa.int64())] * (len(names) - 1)], names=names)

    def joined() -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*waiting, strict=True)]

    for batch in batches:
        rows = [batch.column(0).to_numpy(zero_copy_only=False), *(c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns[1:])]
        if over is not None:
            cut = int(np.searchsorted(rows[0], over, "right"))
            rows = [r[cut:] for r in rows]
        if not len(rows[0]):
            continue
        over = None
        waiting.append(rows)
        fresh += len(rows[0])
        if fresh < 200_000:
            continue
        rows = joined()
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        yield from out([r[:cut] for r in rows])
        rows = [r[cut:] for r in rows]
        waiting, fresh = [rows], 0
        if longest is not None and len(rows[0]) > longest:
            yield from noted(rows[0][:1])
            over, waiting = int(rows[0][0]), []
    if waiting:
        yield from out(joined())


def search(distinct: DataFrame, keys_of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], limits: Limits, star: bool = False, owned: bool = False, longest: int = LONG) -> DataFrame:
    """Links of ``run_links`` over all runs of equal keys.

    ``distinct`` holds fingerprints without repeats, one long column for each of ``limits``; the
    keys are made of the first, further ones may stand in a last column of lists.  A link has the columns a0, a1, ... of the one and b0, b1, ... of the other.
    """
    kinds = len(limits)
    names = [f"f{i}" for i in range(kinds)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:kinds]]
            for i in range(0, batch.num_rows, 2048):
                key, at = keys_of(columns[0][i : i + 2048].view(np.uint64))
                if len(batch.columns) > kinds:
                    more = batch.column(kinds).slice(i, 2048)
                    size = more.value_lengths().to_numpy()
                    key, at = np.r_[key, more.flatten().to_numpy()], np.r_[at, np.repeat(np.arange(len(size)), size)]
                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(c[i : i + 2048][at]) for c in columns)], names=["key", *names])

    def compared(rows: DataFrame, own: bool, most: int | None) -> DataFrame:
        schema = ", ".join(f"{side}{i} long" for side in "ab" for i in range(kinds))
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: _compare(batches, limits, star, own, most), schema)

    dealt = distinct.mapInArrow(deal, ", ".join(f"{n} long" for n in ("key", *names)))
    found = written(compared(dealt, owned, longest), "links")
    hot = found.where("b0 is null").select(F.col("a0").alias("key")).distinct()
    found = found.where("b0 is not null")
    if hot.isEmpty():
        return found
    # Members of a long run go into blocks of half its size at most; every pair of blocks is a run of its own.
    members = written(dealt.join(hot, "key"), "long")
    blocks = members.groupBy("key").agg(F.ceil(2 * F.count("*") / longest).alias("n"))
    placed = members.join(blocks, "key").withColumn("i", F.pmod(F.xxhash64(*names), "n"))
    cells = placed.select("key", *names, "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    cells = cells.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), *names)
    return found.unionByName(compared(cells, False, None))


def links(distinct: DataFrame) -> DataFrame:
    """``distinct`` (fp): links (a, b) that join the same fingerprints as all links of BITS or fewer bits do."""
    return search(distinct.select("fp"), keys, (BITS,), owned=True).toDF("a", "b")


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hexadecimal digits) and component_id (least key reachable over links) of every row."""
    no_clash([key], ["fingerprint", "component_id"])
    marked = written(fingerprints(df.select(key, text), key, text), "fingerprints")
    least = marked.groupBy("fp").agg(F.min(key).alias("__least"))
    distinct = written(least, "distinct")
    found = components(links(distinct))
    # Both sides of the join by root are tables: a root of very many fingerprints can be split.
    rooted = written(distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    lead = written(rooted.groupBy("root").agg(F.min("__least").alias("component_id")), "lead")
    placed = rooted.join(lead, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(placed, "fp").select(key, digits, "component_id")
