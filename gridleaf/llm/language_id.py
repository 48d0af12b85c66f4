"""Language identification by rank-order profiles (Cavnar and Trenkle 1994).

A profile is the ranked list of the most frequent letter n-grams (1 to 3 letters,
words padded with a blank on either side).  A document's profile is compared with
each language's by the out-of-place distance: the sum over the document's n-grams of
how far their ranks differ, or the greatest distance for n-grams that the language's
profile lacks.  The nearest language wins.

Score: one minus the nearest distance over the greatest one, weighed against the
second nearest: 0 to 1.  A text without a letter (category L; marks alone are none), empty or
null, gives ``und`` with score 0.  Equal counts rank by the n-gram's code, equal distances by language
name.  Whole texts of any length are profiled; only texts and the language column
of training rows are used to learn.  Profiles are learned from a bounded number of
documents per language (``per_language``), chosen by a hash of the key.  Without a trainable row every
document is ``und``.  Repeated rows are learned from and identified each on its own; an empty table
gives an empty one.  Extra columns are not read; a key column named ``lang_pred`` or ``score`` is an error.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridleaf.llm.shared import chunks, map_texts

#: N-grams of a profile.
PROFILE = 400
#: Training documents per language, about.
PER_LANGUAGE = 3000
UND = "und"


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a blank."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for code in range(0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
        elif unicodedata.category(c) in ("Mn", "Mc"):
            table[code] = code  # marks belong to the letters they follow
    return table


@functools.lru_cache(maxsize=1)
def is_letter() -> np.ndarray:
    return np.array([chr(code).isalpha() for code in range(0x110000)])


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a text, ascending, and how often each occurs."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = letters()[raw]
    if not is_letter()[raw].any():
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    codes = np.r_[np.uint32(32), codes, np.uint32(32)]
    codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]].astype(np.uint64)
    blank = codes == 32
    two = (codes[:-1] << np.uint64(21)) | codes[1:]
    three = (two[:-1] << np.uint64(21)) | codes[2:]
    return _counted(np.concatenate([codes[~blank], two, three[~blank[1:-1]]]))


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes.sort()
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[starts], np.diff(np.r_[starts, len(codes)])


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in rank order; equal counts rank by code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:size]


@dataclass(frozen=True)
class Profiles:
    """Of each language, in name order, its n-grams in rank order."""

    languages: tuple[str, ...]
    profiles: tuple[tuple[int, ...], ...]
    size: int = PROFILE

    @functools.cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams of any profile, ascending, and their rank in each language (``size``: not there)."""
        known = np.unique(np.concatenate([np.array(p, dtype=np.uint64) for p in self.profiles]))
        ranks = np.full((len(self.languages), len(known) + 1), self.size, dtype=np.int64)
        for i, p in enumerate(self.profiles):
            ranks[i, np.searchsorted(known, np.array(p, dtype=np.uint64))] = np.arange(len(p))
        return known, ranks

    def distances(self, text: str) -> np.ndarray | None:
        """Out-of-place distance to each language over the greatest one; None for a text without letters."""
        own = ranked(*grams(text), self.size)
        if not len(own) or not self.languages:
            return None
        known, ranks = self.table
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        at = np.where(known[at] == own, at, len(known))
        there = ranks[:, at]
        apart = np.where(there == self.size, self.size, np.abs(there - np.arange(len(own))))
        return apart.sum(axis=1) / (self.size * len(own))

    def predict(self, text: str) -> tuple[str, float]:
        apart = self.distances(text)
        if apart is None:
            return UND, 0.0
        best = int(apart.argmin())
        if len(apart) == 1:
            return self.languages[best], float(1 - apart[best])
        second = float(np.partition(apart, 1)[1])
        lead = (second - apart[best]) / second if second else 0.0
        return self.languages[best], float(min(1.0, max(0.0, (1 - apart[best]) ** 0.5 * (0.5 + 0.5 * lead))))


def learn(df: DataFrame, trainable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, size: int = PROFILE) -> Profiles:
    """Profiles of all languages from about ``per_language`` trainable documents each."""
    rows = df.where(trainable & F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Profiles((), (), size)
    part = F.lit(0.0)
    for name, n in counts.items():
        part = F.when(F.col("l") == name, min(1.0, per_language / n)).otherwise(part)
    chosen = rows.where(F.pmod(F.xxhash64("k", F.lit(11)), F.lit(1_000_003)) < part * 1_000_003)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for piece in chunks(batch, 1):
                for name, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    codes, n = grams(t or "")
                    if name in held:
                        codes, n = np.r_[held[name][0], codes], np.r_[held[name][1], n]
                        order = np.argsort(codes, kind="stable")
                        codes, n = codes[order], n[order]
                        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, dtype=int)
                        codes, n = codes[starts], np.add.reduceat(n, starts) if len(starts) else n
                    held[name] = codes, n
        for name, (codes, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), type=pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], names=["l", "g", "n"])

    summed = chosen.select("l", "t").mapInArrow(gather, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("l").orderBy(F.desc("n"), "g")
    top = summed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size).orderBy("l", "r").collect()
    found: dict[str, list[int]] = {name: [] for name in sorted(counts)}
    for row in top:
        found[row["l"]].append(row["g"])
    found = {name: p for name, p in found.items() if p}
    return Profiles(tuple(found), tuple(map(tuple, found.values())), size)


def identify(df: DataFrame, profiles: Profiles, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, lang_pred and score of every text."""

    def step(texts: list[str]) -> list:
        return list(zip(*map(profiles.predict, texts), strict=True))

    return map_texts(df, list(keys), text, "lang_pred string, score double", step)


def held_out(key: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether the crc32 of the key as text leaves ``part``; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == part, F.lit(False))
