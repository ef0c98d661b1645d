"""The corpus pipeline: each stage reads what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Stages take nulls in any column, empty and very long texts, repeated rows and empty tables as their operators do. Extra
columns go through all stages unchanged, whatever their names; only ``copies`` and ``taken`` give way to those of the
mix. A changed text carries its own n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import decontamination, line_dedup, mixing, near_dedup, toxicity
from quillmark.llm.scratch import written

#: Documents that must share a line before all but its first are dropped.
LINE_DOCS = 10
#: Similarity of near duplicates.
SIMILARITY = 0.8


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go."""
    return toxicity.without_toxic(docs, toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in LINE_DOCS documents go but for their first occurrence; a document stays, even if no line does."""
    # all other columns stand aside, so that none of them meets the operator's own
    rows = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("_doc"))
    kept = line_dedup.without_lines(rows, line_dedup.keep_bitmaps(rows, least_docs=LINE_DOCS, keep_first=True))
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc.n_chars"))
    return kept.select(*[new[c].alias(c) if c in new else F.col("_doc").getField(c).alias(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the one of the smallest id, nulls last; of rows that share it, one of them.

    Rows are told apart by a number of their own, whatever their ids.
    """
    # written, so that every later read finds the same numbers
    rows = written(docs.select(F.struct(*docs.columns).alias("doc")).withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = near_dedup.near_groups(rows.select(F.col("row").alias("doc_id"), "doc.text"), similarity=SIMILARITY).select(F.col("doc_id").alias("row"), "component_id")
    ids = rows.select("row", F.col("doc.doc_id").cast("bigint").alias("id"))
    first = groups.join(ids, "row").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    kept = first.select("first.row")
    # both grow with the documents: one way of joining at every size
    return rows.join(kept.hint("merge"), "row", "left_semi").select("doc.*")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_hits(docs, decontamination.fitted_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the documents taken, with copies (how often) and taken (their words in the mix).

    Rows that repeat an id and a text within a source are one unit of the mix.
    """
    size = mixing.n_words(F.col("text"))
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in ("copies", "taken")]).alias("doc"), F.xxhash64("doc_id", "text").alias("unit"), F.col("source").alias("of"), size.alias("size"))
    units = rows.groupBy("unit", "of").agg(F.sum("size").alias("size")).select(F.col("unit").alias("doc_id"), F.col("of").alias("source"), "size")
    taken = written(mixing.mixed(units).where("copies > 0").select(F.col("doc_id").alias("taken_unit"), F.col("source").alias("taken_of"), "copies"), "taken")
    j = rows.join(taken.hint("merge"), (F.col("unit") == F.col("taken_unit")) & F.col("of").eqNullSafe(F.col("taken_of")))
    return j.select("doc.*", "copies", (F.col("copies") * F.col("size")).alias("taken"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources", mixing_stage),
]

#: Boosted trees, latent search and balanced draws aren't SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
