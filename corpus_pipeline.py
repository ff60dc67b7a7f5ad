"""The corpus pipeline: quality rules, near-dedup, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet in the shared folder and
read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.llm import op01_templates, op03_bagminhash, op05_mixing, op06_quality, op09_shards
from rillflow.llm.common import free_names, fresh_path, materialize, table, text_key, tuned


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that pass the base rules and the threshold table."""
    return op06_quality.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates: one of those with the least doc_id (null before all others). Rows without a word
    are in no class and stay."""
    i, k, w = free_names(docs.columns, "id", "key", "words")
    found = op03_bagminhash.near_duplicates(docs).where("class_key is not null")
    # a null id sorts first
    first = materialize(found.groupBy("class_key").agg(F.min(F.struct("doc_id", "text_key")).alias("s")).select(F.col("s.doc_id").alias("a"), F.col("s.text_key").alias("b")), "survivors")
    first = first.select(F.coalesce("a", F.lit(-(2**63))).alias(i), F.col("b").alias(k))
    words = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    held = docs.withColumn(i, F.coalesce("doc_id", F.lit(-(2**63)))).withColumn(k, text_key()).withColumn(w, words)
    # the same plan at every size: both sides are dealt by id and text, and rows equal in both are met in one place
    kept = held.where(F.col(w)).join(first.hint("merge"), [i, k], "left_semi").dropDuplicates([i, k])
    return kept.unionByName(held.where(~F.col(w))).select(*[f"`{c}`" for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a benchmark item, its slots filled in anew or not. Other rows with their id stay."""
    i, k, t = free_names(docs.columns, "id", "key", "text_key")
    found = op01_templates.contaminated(docs, table(spark, sf_dir, "benchmark"))
    gone = materialize(found.select(F.col("doc_id").alias(i), F.col("text_key").alias(k)).distinct(), "contaminated")
    held = docs.withColumn(t, text_key())
    return held.join(gone, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(t) == F.col(k)), "left_anti").select(*[f"`{c}`" for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of a row as the mix takes of its words: whole copies, and one more if the mix takes a part of one. Rows equal in
    doc_id, text and source share their copies out evenly."""
    per_doc = op05_mixing.mixed(docs)[0]
    i, k, s, n, r, c = free_names(docs.columns, "id", "key", "source", "copies", "rank", "copy")
    by = ("doc_id", "text_md5", "source")
    copies = per_doc.groupBy(*by).agg(F.sum(F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)).alias("n"), F.count("*").alias("rows")).where("n > 0")
    copies = materialize(copies, "copies").select(F.coalesce("doc_id", F.lit(-(2**63))).alias(i), F.col("text_md5").alias(k), F.coalesce("source", F.lit("\0")).alias(s), F.col("n").alias(n), F.col("rows").alias(r))
    text_md5 = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    held = docs.withColumn(i, F.coalesce("doc_id", F.lit(-(2**63)))).withColumn(k, text_md5).withColumn(s, F.coalesce("source", F.lit("\0")))
    met = held.join(copies.hint("merge"), [i, k, s])
    # of n copies of R equal rows the k-th has (n + R - k) div R
    at = F.row_number().over(Window.partitionBy(i, k, s).orderBy(i))
    own = met.withColumn(c, at).withColumn(c, F.expr(f"({n} + {r} - {c}) div {r}").cast("int")).where(F.col(c) > 0)
    return own.withColumn(c, F.explode(F.sequence(F.lit(1), F.col(c)))).select(*[f"`{x}`" for x in docs.columns])


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in shuffled shards: which, and where."""
    return op09_shards.digest(op09_shards.shuffle_shards(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Near-dedup and the shuffled order aren't expressible in SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(tuned(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
