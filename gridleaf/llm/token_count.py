"""Token counts by rank-synchronous array merging.

Pre-tokens that are not yet known are held together as one ragged numpy array.
In each round every sequence applies its own lowest-rank pair, all sequences at
once; sequences without a pair left are finished and their surviving symbols are
counted.  Counts of pieces of text are kept in a bounded table of each Python worker,
so a pre-token is merged when it is new there, not once per occurrence.

Null and empty texts have 0 tokens.  Special strings (``<|endoftext|>``) inside a
text count as one token, as the library does by default.  Texts of any length are
counted whole; memory is bounded by a chunk of texts and the table of counts.  Ties: equal pairs
of a sequence merge from the left.  Repeated rows are counted each on its own; an empty table gives an empty
one.  Extra columns are not read; a key column named as a result is an error.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from gridleaf.llm import pretoken
from gridleaf.llm.shared import Memo, map_column

#: Pieces of which a worker keeps the count, in each of two generations.
KNOWN = 400_000
#: Bytes of new pre-tokens that are merged at once.
AT_ONCE = 4_000_000
NONE = np.int64(1 << 40)


class RaggedMerger:
    """Merges many byte sequences at once by the merge ranks of a vocabulary."""

    def __init__(self, path: str):
        vocab, merges, added = pretoken.load_json(path)
        letters = pretoken.byte_letters()
        self.first = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        key = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made
        self.specials = [t["content"] for t in added]
        # Equal pairs of a sequence may merge in one round only if no merge that uses
        # a symbol ranks before the merge that makes it.
        born = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        np.maximum.at(born, made, np.arange(len(made)))
        parts = np.array([(vocab[a], vocab[b]) for a, b in merges])
        self.all_equal = bool((born[parts].max(axis=1) <= np.arange(len(made))).all())

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NONE)

    def counts(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols that survive in each non-empty sequence."""
        size = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
        out = size.copy()
        ids = self.first[np.frombuffer(b"".join(sequences), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), size)
        rank = np.full(len(ids), NONE)
        same = np.flatnonzero(owner[:-1] == owner[1:])
        rank[same] = self.rank(ids[same], ids[same + 1])
        while len(ids):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(ids)])
            lowest = np.minimum.reduceat(rank, starts)
            alive = lowest < NONE
            if not alive.all():
                out[owner[starts[~alive]]] = lengths[~alive]
                keep = np.repeat(alive, lengths)
                ids, owner, rank = ids[keep], owner[keep], rank[keep]
                if not len(ids):
                    break
                lengths, lowest = lengths[alive], lowest[alive]
                starts = np.r_[0, np.cumsum(lengths)[:-1]]
            hit = rank == np.repeat(lowest, lengths)
            at = np.flatnonzero(hit)
            if self.all_equal:
                # In a run of overlapping hits (the same symbol repeated) every second one merges.
                begins = np.r_[True, np.diff(at) != 1]
                run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            else:
                at = at[np.r_[True, owner[at[1:]] != owner[at[:-1]]]]
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            for spot in (moved, moved[moved > 0] - 1):
                inside = spot < len(ids) - 1
                rank[spot[~inside]] = NONE
                spot = spot[inside]
                rank[spot] = np.where(owner[spot] == owner[spot + 1], self.rank(ids[spot], ids[spot + 1]), NONE)
        return out


class Counter:
    """Token counts of texts."""

    def __init__(self, path: str):
        self.merger = RaggedMerger(path)
        self.special = regex.compile("|".join(map(regex.escape, self.merger.specials))) if self.merger.specials else None
        self.pieces = Memo(self.count_pieces, KNOWN)

    def count_tokens(self, tokens: list[str]) -> list[int]:
        """Symbols of pre-tokens."""
        out: list[int] = []
        part: list[bytes] = []
        size = 0
        for token in tokens:
            part.append(token.encode())
            size += len(part[-1])
            if size > AT_ONCE:
                out += self.merger.counts(part).tolist()
                part, size = [], 0
        return out + self.merger.counts(part).tolist() if part else out

    def count_pieces(self, pieces: list[str]) -> list[int]:
        cut = list(map(pretoken.cut_piece, pieces))
        tokens = list(set().union(*cut))
        count = dict(zip(tokens, self.count_tokens(tokens), strict=True)).__getitem__
        return [count(c[0]) if len(c) == 1 else sum(map(count, c)) for c in cut]

    def count_text(self, text: str) -> int:
        parts = self.special.split(text) if self.special is not None else [text]
        tokens = [t for p in parts for t in pretoken.split(p)]
        distinct = list(set(tokens))
        count = dict(zip(distinct, self.count_tokens(distinct), strict=True)).__getitem__
        return len(parts) - 1 + sum(map(count, tokens))

    def __call__(self, texts: pa.Array) -> list[int]:
        """Tokens of each text of an Arrow column without nulls."""
        cut = pretoken.Pieces.of(texts, self.merger.specials)
        counts = np.array(self.pieces(cut.distinct), dtype=np.int64)
        ends = np.r_[0, np.cumsum(counts[cut.codes])] if len(counts) else np.zeros(1, dtype=np.int64)
        # The line break put before a text is one token of its own.
        rest = iter((np.diff(ends[cut.bounds]) - 1).tolist())
        return [self.count_text(texts[i].as_py()) if own else next(rest) for i, own in enumerate(cut.alone)]


@functools.lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, path: str, limit: int = 512, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every text."""

    def step(texts: pa.Array) -> list:
        tokens = counter(path)(texts)
        return [pc.binary_length(texts), tokens, [n > limit for n in tokens]]

    return map_column(df, list(keys), text, "n_bytes long, n_tokens long, over_limit boolean", step, pretoken.AT_ONCE)
