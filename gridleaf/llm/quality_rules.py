"""Quality rules with risk-controlled thresholds.

Each rule is a measure of a text and a grid of cutoffs; a document above the cutoff
of its stratum is rejected.  Cutoffs are learned, then tested, on documents that are
labelled clean (quality 1), split by a hash of their key:

* on a fifth of them a ladder of settings is made, from the most lenient: each rule takes the
  strictest cutoff that rejects at most a fraction of the clean documents of the stratum, on the
  first rungs one some steps looser;
* on the others the settings are tested from the most lenient on: the upper
  Clopper-Pearson bound of the rate at which a setting, all rules together, rejects
  clean documents must not exceed ``alpha``.  The first failure ends the ladder (a
  fixed sequence, which needs no further correction), the strata share ``delta``
  (Bonferroni).  Of the settings that passed, all of which the bound covers, the one is
  used that rejects the most other documents less clean ones, by share, the most lenient
  of equals; if none passed, the stratum has no rules but the base ones.

So, with probability ``1 - delta`` over the holdout, the rules reject at most a
fraction ``alpha`` of the clean documents of every stratum.

Strata are length bands in words, known for any text.  Counts for the bounds cover
all labelled documents and are aggregated by stratum, rule and cutoff, a number that
does not grow with the data.

Words are ``[^\\x20\\x09-\\x0D]+``; null and empty texts have none and fail the base
rule.  A document with conflicting labels counts as not clean; null labels are
ignored; of repeated keys one row (the least by its features) counts for the bounds, each is judged on its
own.  Ties in a setting's gain go to the more lenient one.  Texts of any length are measured whole.  An empty
table gives an empty one.  Extra columns are not read; a key column named as a feature or a result is an error.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridleaf.llm.shared import map_texts, no_clash, written

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: Largest number of words of each length band but the last.
BANDS = (299, 999)
#: Of each rung, most lenient first: the fraction of clean documents that one rule may reject, and the steps by which its cutoff is looser than the strictest such.
LADDER = ((0.0, 2), (0.0, 1), (0.0, 0), (0.0005, 0), (0.001, 0), (0.002, 0), (0.005, 0), (0.01, 0))
#: One of so many labelled documents makes the ladder; the others test it.
TUNE_PART = 5


@dataclass(frozen=True)
class Rule:
    """A measure (a SQL expression over the features) and its cutoffs, strictest first."""

    name: str
    measure: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols / n_words", (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8)),
    Rule("upper", "n_upper / greatest(n_letters, 1)", (0.1, 0.2, 0.3, 0.5, 0.7, 0.9)),
    Rule("repeats", "n_repeat_words / n_words", (0.05, 0.1, 0.2, 0.3, 0.4)),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", (0.05, 0.1, 0.2, 0.3, 0.5)),
    Rule("word_length", "abs(word_chars / n_words - 5.5)", (1.5, 2.0, 3.0, 5.0, 10.0)),
    Rule("digits", "n_digits / greatest(word_chars, 1)", (0.05, 0.1, 0.2, 0.4)),
    Rule("same_word", "n_same_word / n_words", (0.02, 0.05, 0.1, 0.2, 0.4)),
    Rule("long_words", "longest_word", (60, 100, 200, 1000)),
)

FEATURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_upper long, n_letters long, n_digits long, n_same_word long, longest_word long"
)

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(SYMBOLS.encode())] = 1
_ASCII = re.compile(r"[\x00-\x7F]+")
_NOT_FIRST = np.array([0x80 <= b < 0xC0 for b in range(256)])


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    seen = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    pair = seen[:-1] * len(ids) + seen[1:]
    if len(ids) > 1_500_000:  # three ids would no longer fit in 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
        window = pair[:-1] * len(ids) + seen[2:]
    else:
        window = pair[:-1] * len(ids) + seen[2:]
    order = np.argsort(window, kind="stable")
    same = np.diff(window[order]) == 0
    twice = np.zeros(len(window), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def features(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    n = len(words)
    histogram = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    blanks = int(histogram[[32, 9, 10, 11, 12, 13]].sum())
    chars = int(histogram[~_NOT_FIRST].sum()) - blanks
    seen: set[str] = set()
    n_lines = n_dup = 0
    for line in text.split("\n"):
        if line and line.strip(" \t\x0b\x0c\r"):
            n_lines += 1
            if line in seen:
                n_dup += 1
            else:
                seen.add(line)
    plain = histogram[65:91].sum()
    upper, letters = plain, plain + histogram[97:123].sum()
    if len(raw) != len(text):
        other = _ASCII.sub("", text)
        upper += sum(map(str.isupper, other))
        letters += sum(map(str.isalpha, other))
    same = sum(map(bytes.__eq__, words, words[1:]))
    return (n, chars, int((histogram * _SYMBOL).sum()), n_dup, repeat_words(words), n_lines, int(upper), int(letters), int(histogram[48:58].sum()), same, max(map(len, words), default=0))


def feature_columns(texts: list[str]) -> list:
    return list(zip(*map(features, texts), strict=True))


def measure(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the features of every text."""
    return map_texts(df, [key], text, FEATURES, feature_columns)


def base_failed(min_words: int = MIN_WORDS, percent: int = REPEAT_PERCENT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > percent * F.col("n_words"))


def stratum(bands: Sequence[int] = BANDS) -> Column:
    return sum(((F.col("n_words") > b).cast("int") for b in bands), F.lit(0))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial, summed in logarithms from the largest term down."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return float(k >= n)
    total = 0.0
    for i in range(k, -1, -1):
        term = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
        total += term
        if i < n * p and term < total * 1e-17:
            break
    return min(total, 1.0)


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a rate of which k of n were seen."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        if binomial_tail(k, n, middle) > delta:
            low = middle
        else:
            high = middle
    return high


@dataclass(frozen=True)
class Fitted:
    """Cutoffs by (stratum, rule), where a rule without one is off, and the proven bound by stratum."""

    cutoffs: dict[tuple[int, str], float]
    bounds: dict[int, float]
    rules: tuple[Rule, ...]
    bands: tuple[int, ...]

    def rejected(self) -> Column:
        return _rejected(self.cutoffs, self.rules, self.bands)


def _rejected(cutoffs: dict[tuple[int, str], float], rules: Sequence[Rule], bands: Sequence[int]) -> Column:
    out = F.lit(False)
    for (band, name), cutoff in cutoffs.items():
        measure_of = next(r.measure for r in rules if r.name == name)
        out = out | ((stratum(bands) == band) & (F.expr(measure_of) > cutoff))
    return out


def fit(measured: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, key: str = "doc_id", rules: Sequence[Rule] = RULES, bands: Sequence[int] = BANDS) -> Fitted:
    """Cutoffs for ``measured`` (features) from ``labels`` (key, quality); counts alone reach the driver."""
    known = labels.where("quality is not null").groupBy(key).agg(F.min("quality").alias("quality"))
    names = [c.split()[0] for c in FEATURES.split(", ")]
    once = measured.join(known, key).groupBy(key, "quality").agg(F.min(F.struct(*names)).alias("f"))  # exact bounds count each document once
    rated = once.select(key, "quality", "f.*").where(~base_failed())
    rated = rated.withColumn("band", stratum(bands)).withColumn("tune", F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % TUNE_PART == 0)
    rated = written(rated, "rated")  # read twice
    counted = [F.count_if(F.expr(r.measure) > c).alias(f"{r.name}:{i}") for r in rules for i, c in enumerate(r.cutoffs)]
    tuned = {row["band"]: row for row in rated.where("tune and quality = 1").groupBy("band").agg(F.count("*").alias("n"), *counted).collect()}
    ladder: list[dict[tuple[int, str], float]] = []
    for share, looser in LADDER:
        setting = {}
        for band, row in tuned.items():
            for rule in rules:
                passing = [c for i, c in enumerate(rule.cutoffs) if row[f"{rule.name}:{i}"] <= share * row["n"]]
                if passing:
                    setting[band, rule.name] = passing[min(looser, len(passing) - 1)]
        ladder.append(setting)
    good = F.col("quality") == 1
    tests = [F.count_if(_rejected(setting, rules, bands) & side).alias(f"{name}:{i}") for i, setting in enumerate(ladder) for name, side in (("clean", good), ("other", ~good))]
    sizes = [F.count_if(good).alias("clean"), F.count_if(~good).alias("other")]
    cutoffs, bounds = {}, {}
    for row in rated.where("not tune").groupBy("band").agg(*sizes, *tests).collect():
        band, passed = row["band"], []
        for level in range(len(ladder)):
            bound = upper_bound(row[f"clean:{level}"], row["clean"], delta / (len(bands) + 1))
            if bound > alpha:
                break
            gain = row[f"other:{level}"] / max(row["other"], 1) - row[f"clean:{level}"] / row["clean"]
            passed.append((gain, -level, bound))
        if passed:
            _, level, bounds[band] = max(passed)
            cutoffs.update({k: c for k, c in ladder[-level].items() if k[0] == band})
    return Fitted(cutoffs, bounds, tuple(rules), tuple(bands))


def judge(measured: DataFrame, fitted: Fitted) -> DataFrame:
    """``measured`` with base_failed and kept."""
    no_clash(measured.columns, ["base_failed", "kept"])
    failed = measured.withColumn("base_failed", base_failed())
    return failed.withColumn("kept", ~F.col("base_failed") & ~fitted.rejected())


def apply_rules(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """key, the features, base_failed and kept of every document, with cutoffs fitted on ``labels``."""
    measured = written(measure(df, key, text), "features")
    return judge(measured, fit(measured, labels, alpha, delta, key))
