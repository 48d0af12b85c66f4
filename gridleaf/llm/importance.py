"""Resampling of documents by their importance for a target distribution.

Features are runs of 1 to ``RUNS`` consecutive words, joined by one space, repeats counted; a feature
falls in the bucket of its CRC-32.  A bucket's gain is the logarithm, in thousandths and
rounded down, of how much likelier the target is to fill it than the corpus is, each with one more feature in every bucket.  The weight of a
document is the sum of the gains of its features; with Gumbel noise on top, the highest scores are a
draw without replacement in proportion to the exponential of the weight.

Scoring explodes nothing: higher-order functions make each document's array of buckets, which is written once,
and the weight is an aggregate over ``element_at`` of the gains, one literal array of
10,000 numbers.  Of texts and features only totals by bucket are shuffled, pre-aggregated in every task.  Ranks are
places in a range partitioning of the scores of documents that may be drawn (numbers only).  All of it is built-in functions.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z (no other letters) in lower case.  Null and
empty texts and texts without words have no features and weight 0; they are never drawn while ``least_words`` is over 0.  A null key
has the noise of an empty one and comes first among equal scores.  Repeated rows count and are ranked each on its own; ties of score go to the smaller key,
then to any.  Texts of any length are taken whole.  An empty table gives an empty one, an empty target gives
gains all the same.  Extra columns are not read; a key column named as a result is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridleaf.llm.shared import no_clash, written
from gridleaf.llm.sharding import numbered

BUCKETS = 10_000
RUNS = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: What does not belong to a word, before A-Z become a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RESULTS = ("n_features", "weight", "score", "rank")

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The words of a text; none for null."""

    def lower(word: Column) -> Column:  # a word of ASCII alone, as most are, the short way
        return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _UPPER.lower()))

    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN), lambda w: w != ""), lower)


def bucket_array(word: Column, runs: int = RUNS, buckets: int = BUCKETS) -> Column:
    """The bucket of every run of 1 to ``runs`` words of an array column; an array column by name, not an expression, is worked out once."""

    def bucket(feature: Column) -> Column:
        return (F.crc32(feature.cast("binary")) % buckets).cast("int")

    def of_runs(n: int) -> Column:
        starts = F.sequence(F.lit(0), F.size(word) - n)
        found = F.transform(starts, lambda i: bucket(F.concat(F.get(word, i), *(c for k in range(1, n) for c in (F.lit(" "), F.get(word, i + k))))))
        return F.when(F.size(word) >= n, found).otherwise(F.array().cast("array<int>"))

    return F.concat(F.transform(word, bucket), *map(of_runs, range(2, runs + 1)))


def bucketed(df: DataFrame, columns: list[Column], text: str, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """``columns``, __words (how many) and __buckets of every text, written once."""
    cut = df.select(*columns, words(F.col(text)).alias("__cut"))
    return written(cut.select(*[c for c in cut.columns if c != "__cut"], F.size("__cut").alias("__words"), bucket_array(F.col("__cut"), runs, buckets).alias("__buckets")), "buckets")


def totals(found: DataFrame) -> DataFrame:
    """Features in each bucket (bucket, n): one row a bucket at most leaves a task."""
    return found.select(F.explode("__buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, from the totals of corpus and target."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    joined = every.join(corpus.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0, ["s", "t"])
    all_s, all_t = (F.lit(f.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + buckets).cast("double") for f in (corpus, target))
    t, s = ((F.col(c) + 1).cast("double") for c in "ts")
    gain = F.floor(1000 * F.log((t * all_s) / (s * all_t))).cast("long")
    return [r["gain"] for r in joined.select("bucket", gain.alias("gain")).orderBy("bucket").collect()]


def literal(values: list[int]) -> Column:
    """One constant array of any length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, that depends on seed and key alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def score(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", seed: int = SEED) -> DataFrame:
    """key, n_words, n_features, weight and score of every text, by its importance for the texts of ``target``."""
    no_clash([key], ("n_words", *RESULTS))
    found = bucketed(df, [F.col(key)], text)
    gain = literal(gains(totals(found), totals(bucketed(target, [], target_text))))
    weight = F.aggregate("__buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(gain, b + 1))
    weighed = found.select(key, F.col("__words").cast("long").alias("n_words"), F.size("__buckets").cast("long").alias("n_features"), weight.alias("weight"))
    return weighed.select("*", (F.col("weight") + noise(F.col(key), seed)).alias("score"))


def resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """key, ``RESULTS`` of every text; rank is 1, 2, 3 ... for the ``percent`` of texts of ``least_words`` words or more that are drawn, else null."""
    scored = written(score(df, target, key, text, target_text, seed), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    placed = numbered(able, [F.col("score").desc(), F.col(key).asc()], "ranked", "rank")
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1)
    ranked = placed.withColumn("rank", rank).unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return ranked.select(key, *RESULTS)


def draw(df: DataFrame, target: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The whole rows that ``resample`` draws (keys without repeats or nulls)."""
    chosen = resample(df, target, key, **how).where("rank is not null").select(key)
    return df.join(written(chosen, "drawn"), key, "left_semi")
