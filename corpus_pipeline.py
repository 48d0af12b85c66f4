"""The corpus pipeline: quality rules, quality classifier, near duplicates, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what a stage returns is
written as Parquet and read again as the next stage's documents.  All stages but the
last return the columns of documents.

Nulls in any column pass through; a null or empty text has no words and goes in the first stage, as
does any text the base rules reject.  Null ids are ids of their own: such rows are judged like others and never
looked up in labels.  Repeated rows are near copies of each other, of which the near-duplicate stage
keeps one; ties there go to the lesser id, then the lesser row number.  Texts of any length are taken whole.
Empty tables give empty results; without labels no rule and no score rejects.  Extra columns of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridleaf.llm import decontaminate, near_copies, quality_crf, quality_rules, tree_bpe
from gridleaf.llm.pretoken import default_path
from gridleaf.llm.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the fitted cutoffs reject.

    Features are measured twice, once to fit the cutoffs and once beside the rows they
    judge: that is cheaper than to shuffle the texts to their features.
    """
    fitted = quality_rules.fit(written(quality_rules.measure(docs), "features"), _table(spark, sf_dir, "labels"))
    features = quality_rules.map_texts(docs.select(*COLUMNS), list(COLUMNS), "text", quality_rules.FEATURES, quality_rules.feature_columns)
    return quality_rules.judge(features, fitted).where("kept").select(*COLUMNS)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score below 0.3."""
    fitted = quality_crf.fit(docs, _table(spark, sf_dir, "labels"), ~quality_crf.held_out())
    return quality_crf.score(docs.select(*COLUMNS), fitted, COLUMNS).where(F.col("score") >= 0.3).select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near copies: the least by doc_id (null ids last) and row number.

    Near copies share 0.8 or more of their five-word shingles (Jaccard).  Rows are numbered and written
    once: ids may be null or repeated, and a number must not change when rows are read again.
    """
    rows = written(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    classed = written(near_copies.classes(rows), "classes")
    # Only classes of several rows have losers: few rows, written so that a small table is broadcast and no text shuffled.
    several = classed.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    doubtful = classed.join(several, "component_id", "left_semi").join(rows.select("row", "doc_id"), "row")
    first = doubtful.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    losers = written(doubtful.join(first, "component_id").where("row <> first.row").select("row"), "losers")
    return rows.join(losers, "row", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item."""
    marked = decontaminate.mark(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"), list(COLUMNS))
    return marked.where(F.size("hits") == 0).select(*COLUMNS)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes of what is left."""
    return tree_bpe.round_trip(docs, default_path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("near duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("byte-level BPE", byte_bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express none of classifier, fingerprints, MinHash search and BPE.
ORACLE_SQL = None
