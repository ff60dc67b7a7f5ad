"""Ordered signals (signal_id, n, x) and frames (signal_id, hop, s) from the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCALE = 500.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Ids in one range of the two-level numbering.
RANGE = 1 << 16


def numbered(df: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """df with the position of each row among those with its key, from 0. For keys that are few: rows are counted by range of
    order first, so a task numbers a range of one key and no key is in one task."""
    at = df.withColumn("_range", F.expr(f"{order} div {RANGE}"))
    count = at.groupBy(key, "_range").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(key).orderBy("_range")) - F.col("_rows")
    first = count.select(F.col(key).alias("_key"), F.col("_range").alias("_r"), before.alias("_first"))
    both = at.join(first, F.col(key).eqNullSafe(F.col("_key")) & F.col("_range").eqNullSafe(F.col("_r")))
    n = F.row_number().over(Window.partitionBy(key, "_range").orderBy(order)) - 1 + F.col("_first")
    return both.withColumn(out, n.cast("long")).drop("_range", "_key", "_r", "_first")


def _signal(events: DataFrame, key: str, n) -> DataFrame:
    return events.select(F.col(key).cast("string").alias("signal_id"), n, (F.col("value") / SCALE).alias("x"))


def user_signals(spark, sf_dir: str) -> DataFrame:
    """One signal for each user, in order of event_id: many short signals."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return _signal(table(spark, sf_dir, "events"), "user_id", n.cast("long").alias("n"))


def type_signals(spark, sf_dir: str) -> DataFrame:
    """One signal for each type of event, in order of event_id: few long signals."""
    return _signal(numbered(table(spark, sf_dir, "events"), "event_type", "event_id", "n"), "event_type", F.col("n"))


def embedding_frames(spark, sf_dir: str) -> DataFrame:
    """The embeddings as frames of 64 samples, one signal per label."""
    at = numbered(table(spark, sf_dir, "embeddings"), "label", "vec_id", "hop")
    return at.select(F.col("label").cast("string").alias("signal_id"), "hop", F.col("embedding").cast("array<double>").alias("s"))


def sql_signal(key: str) -> str:
    return f"sig AS (SELECT CAST({key} AS VARCHAR) AS signal_id, CAST(row_number() OVER (PARTITION BY {key} ORDER BY event_id) - 1 AS BIGINT) AS n, value / {SCALE}::DOUBLE AS x FROM events)"


USER, TYPE = sql_signal("user_id"), sql_signal("event_type")
FRAMES = "fr AS (SELECT CAST(label AS VARCHAR) AS signal_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS hop, CAST(embedding AS DOUBLE[]) AS s FROM embeddings)"


def rows(spark: SparkSession, n: int, signal: str = "gen") -> DataFrame:
    """An empty time line of n samples."""
    return spark.range(n).select(F.lit(signal).alias("signal_id"), F.col("id").alias("n"))
