"""A corpus pipeline of training-data operators; each stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.queries import TOKENIZER, tokenizer_path, tokenizer_pattern
from arbora.llm.shared import fresh, released, small_batches, written


#: Least similarity of near-duplicates on word shingles in the near-dedup stage; the query op5_minhash has its own of 85.
PERCENT = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, whole.  The model is fitted on all documents of this stage and on labels."""
    from arbora.llm.toxicity import fit, without_toxic

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    with small_batches(spark):
        model = fit(docs, labels)
    return without_toxic(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one nearly; those that lose all their text go."""
    from arbora.llm.line_dedup import without_duplicate_lines

    return _counted(without_duplicate_lines(docs))


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents of similarity 0.8 or more: that with the smallest doc_id; repeated rows become one, with and
    without id.  Rows without words are linked with nothing, and one of each id stays."""
    from arbora.llm.minhash import near_duplicates

    row = fresh(docs, "_row")[0]
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    near = near_duplicates(rows, ident=row, percent=PERCENT).select(F.col("id").alias("_row"), "n_shingles", F.col("component_id").alias("_group"))
    near = near.join(rows.select(F.col(row).alias("_row"), "doc_id").hint("merge"), "_row")
    group = [F.when(F.col("n_shingles") > 0, F.col("_group")).alias("_group"), F.when(F.col("n_shingles") == 0, F.col("doc_id")).alias("_blank")]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_row"))["_row"]
    stay = written(near.select("_row", "doc_id", *group).groupBy("_group", "_blank").agg(first.alias("_row")).select("_row"), "near")
    released(spark)
    return rows.join(stay.withColumnRenamed("_row", row).hint("merge"), row, "left_semi").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that repeated windows of 35 words cover; those that lose all their words go."""
    from arbora.llm.substring_dedup import cut_repeats

    return _counted(cut_repeats(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    from arbora.llm.packing import pack

    return pack(docs, tokenizer_path(TOKENIZER), tokenizer_pattern()).withColumnRenamed("id", "doc_id")


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("minhash", minhash), ("substring_dedup", substring_dedup), ("packing", packing)]

#: SQL expresses neither the scores nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
