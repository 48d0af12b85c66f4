"""Byte-level BPE encoding and decoding with segment trees of pair ranks.

The leaves of a tree are the byte positions of a pre-token; a leaf holds the rank
of the pair that starts there (joined with the position, so that the minimum is
the leftmost one) and every inner node the least of its two children.  A merge
reads the root, joins two live neighbours and updates three leaves on their way to
the root.  Trees of pre-tokens of similar length stand in one array and merge
side by side; a long pre-token has a tree of its own, n log n in its bytes.

Null and empty texts encode to no ids and decode to no bytes.  Ties of equal pairs
merge from the left.  Special strings are ordinary text.  Texts of any length are encoded whole.
Repeated rows are encoded each on its own; an empty table gives an empty one.  Extra columns are not
read; a key column named as a result is an error.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridleaf.llm import pretoken
from gridleaf.llm.shared import Memo, map_column

#: Pieces of which a worker keeps the ids, in each of two generations.
KNOWN = 200_000
#: Rows and characters that are encoded at once.
CHUNK = (4096, 3_000_000)
#: Widest tree that shares an array, and the cells of one such array.
WIDE = 128
CELLS = 1_000_000
FREE = np.int64(1 << 56)


class TreeEncoder:
    """Encodes and decodes by the ranks of a tiktoken file."""

    def __init__(self, path: str):
        self.ranks = pretoken.load_ranks(path)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pairs: dict[tuple[int, int], int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left, right] = rank
        keys = np.array([(a << 20) | b for a, b in self.pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array(list(self.pairs.values()), dtype=np.int64)[order]
        self.pieces = Memo(self.encode_pieces, KNOWN)

    def leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        want = (left << 20) | right
        i = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[i] == want, (self.made[i] << 32) | at, FREE)

    def encode_alike(self, words: list[bytes], width: int) -> list[bytes]:
        """Pre-tokens of at most ``width`` bytes (a power of two), side by side: their little-endian 32-bit ids."""
        n = len(words)
        size = np.fromiter(map(len, words), dtype=np.int64, count=n)
        column = np.arange(width)
        raw = np.zeros((n, width + 1), dtype=np.int64)
        inside = column < size[:, None]
        raw[:, :width][inside] = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        after = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        tree = np.full((n, 2 * width), FREE)
        paired = column + 1 < size[:, None]
        leaves = np.full((n, width), FREE)
        row, at = np.nonzero(paired)
        leaves[row, at] = self.leaf(raw[row, at], raw[row, at + 1], at)
        tree[:, width:] = leaves
        level = width
        while level > 1:
            half = tree[:, level : 2 * level]
            tree[:, level // 2 : level] = np.minimum(half[:, ::2], half[:, 1::2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] < FREE)
        while len(live):
            root = tree[live, 1]
            at = root & 0xFFFFFFFF
            made = root >> 32
            raw[live, at] = made
            dead = after[live, at]
            follow = after[live, dead]
            inside[live, dead] = False
            after[live, at] = follow
            has_next = follow < size[live]
            before[live[has_next], follow[has_next]] = at[has_next]
            tree[live, width + dead] = FREE
            fresh = np.full(len(live), FREE)
            fresh[has_next] = self.leaf(made[has_next], raw[live[has_next], follow[has_next]], at[has_next])
            tree[live, width + at] = fresh
            left = before[live, at]
            has_left = left >= 0
            rows, spot = live[has_left], left[has_left]
            tree[rows, width + spot] = self.leaf(raw[rows, spot], made[has_left], spot)
            spots = [width + dead, width + at, np.where(has_left, width + left, width + at)]
            for _ in range(width.bit_length() - 1):
                spots = [s >> 1 for s in spots]
                for s in spots:
                    tree[live, s] = np.minimum(tree[live, 2 * s], tree[live, 2 * s + 1])
            live = live[tree[live, 1] < FREE]
        flat = raw[:, :width][inside].astype("<u4").tobytes()
        ends = np.cumsum(4 * inside.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_long(self, word: bytes) -> list[int]:
        """One pre-token of any length."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        ids = self.first[np.frombuffer(word, dtype=np.uint8)]
        leaves = np.full(width, FREE)
        leaves[: n - 1] = self.leaf(ids[:-1], ids[1:], np.arange(n - 1))
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        free, pairs = int(FREE), self.pairs
        tree = [free, *np.concatenate(levels[::-1]).tolist()]
        ids = ids.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(at: int, value: int) -> None:
            at += width
            tree[at] = value
            while at > 1:
                at >>= 1
                low, high = tree[2 * at], tree[2 * at + 1]
                if low > high:
                    low = high
                if tree[at] == low:
                    return
                tree[at] = low

        def pair(left: int, right: int) -> int:
            rank = pairs.get((ids[left], ids[right]))
            return free if rank is None else (rank << 32) | left

        while (root := tree[1]) < free:
            at, made = root & 0xFFFFFFFF, root >> 32
            dead = after[at]
            follow = after[dead]
            ids[at], after[at] = made, follow
            put(dead, free)
            if follow < n:
                before[follow] = at
                put(at, pair(at, follow))
            else:
                put(at, free)
            if before[at] >= 0:
                put(before[at], pair(before[at], at))
        out, at = [], 0
        while at < n:
            out.append(ids[at])
            at = after[at]
        return out

    def encode_tokens(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of pre-tokens."""
        out = [b""] * len(words)
        by_width: dict[int, list[tuple[int, bytes]]] = {}
        for i, word in enumerate(words):
            raw = word.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")  # a whole pre-token of the vocabulary is not merged
            elif len(raw) > WIDE:
                out[i] = np.array(self.encode_long(raw), dtype="<u4").tobytes()
            else:
                by_width.setdefault(1 << max(1, (len(raw) - 1).bit_length()), []).append((i, raw))
        for width, found in by_width.items():
            step = max(1, CELLS // width)
            for j in range(0, len(found), step):
                part = found[j : j + step]
                for (i, _), ids in zip(part, self.encode_alike([raw for _, raw in part], width), strict=True):
                    out[i] = ids
        return out

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        cut = list(map(pretoken.cut_piece, pieces))
        tokens = list(set().union(*cut))
        ids = dict(zip(tokens, self.encode_tokens(tokens), strict=True)).__getitem__
        return [ids(c[0]) if len(c) == 1 else b"".join(map(ids, c)) for c in cut]

    def encode_text(self, text: str) -> np.ndarray:
        words = pretoken.split(text)
        tokens = list(set(words))
        ids = dict(zip(tokens, self.encode_tokens(tokens), strict=True)).__getitem__
        return np.frombuffer(b"".join(map(ids, words)), dtype="<u4")

    def encode_batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of an Arrow column without nulls."""
        cut = pretoken.Pieces.of(texts)
        # The line break put before a text is one pre-token of one byte.
        rest = cut.joined(self.pieces(cut.distinct), 1)
        return [self.encode_text(texts[i].as_py()) if own else next(rest) for i, own in enumerate(cut.alone)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> TreeEncoder:
    return TreeEncoder(path)


@functools.lru_cache(maxsize=4)
def decimals(path: str) -> list[str]:
    return [str(i) for i in range(len(encoder(path).bytes_of))]


def encode(df: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text", into: str = "ids") -> DataFrame:
    """keys and the array of ids of every text."""
    return map_column(df, list(keys), text, f"{into} array<int>", lambda texts: [[x.astype(np.int32) for x in encoder(path).encode_batch(texts)]], CHUNK)


def decode(df: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), ids: str = "ids", into: str = "decoded") -> DataFrame:
    """keys and the decoded bytes (binary) of an array of ids; null: no bytes."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField(into, T.BinaryType())])
    arrow, n = to_arrow_schema(schema), len(keys)

    def run(batches):
        for batch in batches:
            texts = [encoder(path).decode(x or []) for x in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(arrow.field(i).type) for i in range(n)), pa.array(texts, type=arrow.field(n).type)], schema=arrow)

    return df.select(*keys, ids).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 of every text."""

    def step(texts: pa.Array) -> list:
        own, names = encoder(path), decimals(path).__getitem__
        counts, ids_sha, text_sha = [], [], []
        for ids in map(np.ndarray.tolist, own.encode_batch(texts)):
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(names, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return [counts, ids_sha, text_sha]

    return map_column(df, list(keys), text, "n_tokens long, ids_sha256 string, decoded_sha256 string", step, CHUNK)
