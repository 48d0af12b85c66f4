"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is a position of the chain, good (1) or bad (0).  A position
sees measures of its own line and of the lines before and after; transitions tie
neighbouring lines.  Forward-backward gives each line's marginal of being good, and
a document's score is the mean of the marginals weighted by line length.

The field is trained by gradient ascent on documents with a label, each line taking
its document's label, from a bounded sample of labelled rows: about ``sample`` of them (by
default ``SAMPLE``), chosen by a hash of the key, whatever their length.  Lines are measured where
the texts lie; the driver gets ``OWN`` numbers a line of the sample, never a text.

Null and empty texts count as one line without a character and get the score of such
a line.  Rows with a null label are not learned from; of conflicting labels the least
counts, of several texts of one key the least.  Repeated rows are scored each on its own.  Without any
label, or with an empty table, the score is 0.5.  Ties cannot arise: a score is a number.  Scores are of whole
texts of any length.  Extra columns are not read; a key column named ``score`` is an error.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridleaf.llm.shared import map_texts

SAMPLE = 4000
STEPS = 160
RATE = 0.08
L2 = 1e-3
CLASSES = 6  # upper, lower, digit, symbol, other mark, blank
OWN = 15


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000, 4, dtype=np.uint8)
    for code in range(0x110000):
        c = chr(code)
        if c.isupper():
            table[code] = 0
        elif c.isalpha():
            table[code] = 1
        elif c.isdigit():
            table[code] = 2
    table[[ord(c) for c in "#*$%&|<>"]] = 3
    table[[32, 9, 10, 11, 12, 13, 0x85, 0xA0]] = 5
    return table


def line_measures(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of all lines, their weights, and where each document's lines begin."""
    lines: list[str] = []
    begins = []
    words_of: list[list[float]] = []
    for text in texts:
        begins.append(len(lines))
        seen: set[str] = set()
        for line in text.split("\n"):
            words = line.split()
            n = len(words)
            if not n:
                continue
            distinct = len(set(words))
            same = sum(map(str.__eq__, words, words[1:]))
            words_of.append([n, distinct / n, same / n, line in seen, len(words[0]) if n == 1 else 0])
            seen.add(line)
            lines.append(line)
        if len(lines) == begins[-1]:
            lines.append("")
            words_of.append([0, 1, 0, 0, 0])
    codes = classes()[np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    share = np.stack([np.add.reduceat((codes == k).astype(np.int32), starts) for k in range(CLASSES)], axis=1)
    total = np.maximum(sizes, 1)[:, None]
    share[:, 5] -= 1  # the line break
    share = share / total
    words = np.array(words_of, dtype=np.float64).reshape(len(lines), 5)
    letters = np.maximum(share[:, 0] + share[:, 1], 1e-9)
    measures = np.column_stack([
        share[:, :5],
        share[:, 0] / letters * (letters > 1e-6),
        share[:, 0] > 0.3,
        share[:, 3] > 0.01,
        share[:, 4] > 0.1,
        words[:, 1],
        words[:, 2],
        words[:, 2] > 0.2,
        words[:, 3],
        np.log1p(words[:, 0]),
        np.abs(sizes / np.maximum(words[:, 0], 1) - 6.0).clip(0, 20),
    ])
    return measures, np.maximum(sizes, 1).astype(np.float64), np.array(begins, dtype=np.int64)


def positions(measures: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Own measures, those of the lines before and after, and a constant."""
    n = len(measures)
    first = np.zeros(n, dtype=bool)
    first[begins] = True
    last = np.r_[first[1:], True]
    before = np.where(first[:, None], 0.0, np.roll(measures, 1, axis=0))
    after = np.where(last[:, None], 0.0, np.roll(measures, -1, axis=0))
    return np.column_stack([measures, before, after, first, last, np.ones(n)])


def forward_backward(unary: np.ndarray, transitions: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of being good, expected transitions (2, 2) and log-likelihood's normaliser.

    ``unary`` is the score of good over bad; chains run side by side, longest first.
    """
    n = len(unary)
    sizes = np.diff(np.r_[begins, n])
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = begins[order], sizes[order]
    score = np.column_stack([np.zeros(n), unary])
    alpha, beta = score.copy(), np.zeros((n, 2))
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest + 1), side="left")  # chains longer than t
    for t in range(1, longest):
        at = starts[: live[t]] + t
        prior = alpha[at - 1]
        alpha[at, 0] += np.logaddexp(prior[:, 0] + transitions[0, 0], prior[:, 1] + transitions[1, 0])
        alpha[at, 1] += np.logaddexp(prior[:, 0] + transitions[0, 1], prior[:, 1] + transitions[1, 1])
    for t in range(longest - 1, 0, -1):
        at = starts[: live[t]] + t
        ahead = beta[at] + score[at]
        beta[at - 1, 0] = np.logaddexp(ahead[:, 0] + transitions[0, 0], ahead[:, 1] + transitions[0, 1])
        beta[at - 1, 1] = np.logaddexp(ahead[:, 0] + transitions[1, 0], ahead[:, 1] + transitions[1, 1])
    both = alpha + beta
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    inner = np.ones(n, dtype=bool)
    inner[begins] = False
    at = np.flatnonzero(inner)
    pair = alpha[at - 1][:, :, None] + transitions + (score[at] + beta[at])[:, None, :] - total[at][:, None, None]
    return good, np.exp(pair).sum(axis=0), float(total[begins].sum())


@dataclass(frozen=True)
class LineField:
    """A trained field."""

    weights: np.ndarray
    transitions: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    trained: bool = field(default=True)

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each line: the marginal of being good, its weight; and where each document's lines begin."""
        measures, weight, begins = line_measures(texts)
        x = (positions(measures, begins) - self.centre) / self.scale
        return forward_backward(x @ self.weights, self.transitions, begins)[0], weight, begins

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts or not self.trained:
            return np.full(len(texts), 0.5)
        good, weight, begins = self.marginals(texts)
        return np.clip(np.add.reduceat(good * weight, begins) / np.add.reduceat(weight, begins), 0.0, 1.0)


def train(measured: list[np.ndarray], labels: list[int], steps: int = STEPS) -> LineField:
    """Fit a field to the line measures of documents; the lines of a document take its label."""
    width = 3 * OWN + 3
    if not measured:
        return LineField(np.zeros(width), np.zeros((2, 2)), np.zeros(width), np.ones(width), False)
    measures = np.concatenate([m.reshape(-1, OWN) for m in measured])
    begins = np.r_[0, np.cumsum([m.size // OWN for m in measured])[:-1]]
    x = positions(measures, begins)
    sizes = np.diff(np.r_[begins, len(x)])
    gold = np.repeat(np.array(labels, dtype=np.float64), sizes)
    # Every document counts alike, however many lines it has.
    part = np.repeat(1.0 / sizes, sizes)
    centre = np.average(x, axis=0, weights=part)
    scale = np.sqrt(np.average((x - centre) ** 2, axis=0, weights=part))
    scale[scale < 1e-6] = 1.0
    centre[-1], scale[-1] = 0.0, 1.0
    x = (x - centre) / scale
    inner = np.ones(len(x), dtype=bool)
    inner[begins] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[at - 1].astype(int), gold[at].astype(int)), 1.0)
    theta = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        weights, transitions = theta[:-4], theta[-4:].reshape(2, 2)
        good, expected, _ = forward_backward(x @ weights, transitions, begins)
        slope = np.r_[x.T @ ((gold - good) * part), (seen - expected).ravel() / max(sizes.mean(), 1)] / len(begins) - L2 * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta = theta + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return LineField(theta[:-4], theta[-4:].reshape(2, 2), centre, scale)


def held_out(key: str = "doc_id", parts: int = 5) -> Column:
    """Whether the crc32 of the key as text is divisible by ``parts``; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == 0, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, trainable: Column, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> LineField:
    """A field from about ``sample`` labelled documents for whose keys ``trainable`` holds."""
    known = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull() & trainable).groupBy(key).agg(F.min("quality").alias("quality"))
    n = known.count()
    if not n:
        return train([], [])
    part = min(1.0, sample / n)
    chosen = known.where(F.pmod(F.xxhash64(key, F.lit(3)), F.lit(1_000_003)) < part * 1_000_003)
    # ``chosen`` has about ``sample`` rows, whatever the size of the labels.
    texts = df.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    texts = texts.join(F.broadcast(chosen.withColumnRenamed(key, "__key")), "__key").groupBy("__key", "quality").agg(F.min("__text").alias("__text"))
    lines = map_texts(texts, ["__key", "quality"], "__text", "lines array<double>", lambda own: [[line_measures([t])[0].ravel() for t in own]])
    rows = lines.orderBy("__key").collect()
    return train([np.array(r["lines"]) for r in rows], [r["quality"] for r in rows])


def score(df: DataFrame, fitted: LineField, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys and score of every text."""
    return map_texts(df, list(keys), text, "score double", lambda texts: [fitted.scores(texts)])
