"""Event-time windows, count windows, live parameters and the rule for late events on Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.operators.rewindow import cut
from rillflow.sources.signals import RANGE, numbered


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share (spark.checkpoint.dir; a temporary one where it is unset, as in tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="rillflow-")
    return f"{root.rstrip('/')}/rillflow-{name}-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Parquet files as a stream, at most so many in a micro-batch: the source holds back what the query can't take yet. The path
    is given as a pattern, as a stream takes a single file in no other way."""
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    return (source.option("maxFilesPerTrigger", files) if files else source).parquet(f"{path[:-1]}[{path[-1]}]")


@dataclass
class Stepped:
    """A stream each of whose micro-batches is a query over its rows and what was kept of those before: step(batch, kept) gives
    (rows, what to keep). No process holds a signal, however long it is within a micro-batch."""

    source: DataFrame
    schema: str
    state: str
    step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def collected(df: DataFrame | Stepped, mode: str = "append", name: str = "stream") -> DataFrame:
    """Runs a stream over what is there now and returns what it gave: all rows in append mode, the last state in complete mode. What
    a stepped one keeps is a table for each micro-batch, beside the rows."""
    stepped = df if isinstance(df, Stepped) else None
    source = stepped.source if stepped else df
    spark, sink = source.sparkSession, shared_path(source.sparkSession, name)

    def keep(batch: DataFrame, number: int) -> None:
        if stepped:
            own = batch.sparkSession
            kept = own.read.schema(stepped.state).parquet(f"{sink}/kept/{number - 1}") if number else own.createDataFrame([], stepped.state)
            batch, rest = stepped.step(batch, kept)
            rest.write.mode("overwrite").parquet(f"{sink}/kept/{number}")
        batch.write.mode("overwrite").parquet(f"{sink}/rows" if mode == "complete" else f"{sink}/rows/batch={number}")

    query = source.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{sink}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.schema(stepped.schema if stepped else df.schema).parquet(f"{sink}/rows")
    return got.drop("batch") if stepped else got.select(*df.columns)


def telemetry(query) -> list[dict]:
    """Of each micro-batch: rows, rows a second, milliseconds, rows of state."""
    return [
        {"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p.get("processedRowsPerSecond"), "ms": p["durationMs"].get("triggerExecution"), "state_rows": sum(s["numRowsTotal"] for s in p.get("stateOperators", []))}
        for p in query.recentProgress
    ]


def event_windows(df: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) by tumbling, or with a slide hopping, windows. Rows later than the watermark are dropped by
    Spark, unlike those of late_events()."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    by = df.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("rows"), F.sum("value").alias("total"))
    return by.select(F.unix_timestamp("w.start").alias("start"), "event_type", "rows", "total")


def sessions(df: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Events (ts, user_id) by sessions that a gap ends."""
    by = df.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("rows"))
    return by.select("user_id", F.unix_timestamp("w.start").alias("start"), "rows")


def stream_frames(df: DataFrame, frame: int, hop: int) -> Stepped:
    """Hopping count windows on a stream: the last samples of each signal are kept. Equals frames() however the samples are split, if
    each signal's come in order. Positions are numbered by ranges of n and frames grouped by hop, so a signal is in no one task."""
    if not 0 < hop <= frame:
        raise ValueError("hop must be at most frame")

    def step(batch: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
        size = kept.groupBy(F.col("signal_id").alias("_own")).agg((F.max("n") + 1).alias("_size"))
        at = numbered(batch.select("signal_id", "n", "x"), "signal_id", "n", "_p").join(size, F.col("signal_id").eqNullSafe(F.col("_own")), "left")
        line = kept.unionByName(at.select("signal_id", (F.col("_p") + F.coalesce("_size", F.lit(0))).alias("n"), "x"))
        ends = line.groupBy(F.col("signal_id").alias("_own")).agg(F.max("n").alias("_last"))
        rest = line.join(ends, F.col("signal_id").eqNullSafe(F.col("_own"))).where(F.col("n") > F.col("_last") - frame).select("signal_id", "n", "x")
        given = cut(line, frame, hop).join(size, F.col("signal_id").eqNullSafe(F.col("_own")), "left")
        return given.where((F.col("hop") + 1) * hop > F.coalesce("_size", F.lit(0))).select("signal_id", "hop", "s"), rest

    return Stepped(df, "signal_id string, hop long, s array<double>", "signal_id string, n long, x double", step)


def late_events(df: DataFrame, size: int) -> Stepped:
    """(signal_id, seq, at) to (signal_id, seq, block, offset). The furthest block that an event has reached is where a signal's
    transport stands; an event from before applies at that block's start and isn't dropped. How far events had come is found for
    ranges of seq first, then within a range, so a signal is in no one task."""
    reach, past = F.expr(f"at div {size}"), (Window.unboundedPreceding, -1)

    def step(batch: DataFrame, stood: DataFrame) -> tuple[DataFrame, DataFrame]:
        at = batch.select("signal_id", "seq", "at").withColumn("_range", F.expr(f"seq div {RANGE}"))
        far = at.groupBy("signal_id", "_range").agg(F.max(reach).alias("_far"))
        far = far.join(stood.select(F.col("signal_id").alias("_own"), "stand"), F.col("signal_id").eqNullSafe(F.col("_own")), "left")
        before = F.greatest(F.lit(0), "stand", F.max("_far").over(Window.partitionBy("signal_id").orderBy("_range").rowsBetween(*past)))
        first = far.select(F.col("signal_id").alias("_key"), F.col("_range").alias("_r"), before.alias("_before"))
        both = at.join(first, F.col("signal_id").eqNullSafe(F.col("_key")) & F.col("_range").eqNullSafe(F.col("_r")))
        low = F.greatest("_before", F.max(reach).over(Window.partitionBy("signal_id", "_range").orderBy("seq").rowsBetween(*past)))
        applied = both.withColumn("_at", F.greatest(F.col("at"), low * size))
        stands = stood.unionByName(at.select("signal_id", F.greatest(F.lit(0), reach).alias("stand"))).groupBy("signal_id").agg(F.max("stand").alias("stand"))
        return applied.select("signal_id", "seq", F.expr(f"_at div {size}").alias("block"), F.expr(f"_at % {size}").alias("offset")), stands

    return Stepped(df, "signal_id string, seq long, block long, offset long", "signal_id string, stand long", step)


def live_gain(df: DataFrame, params: DataFrame, size: int, default: float = 1.0) -> DataFrame:
    """A streaming signal times a level from a table (signal_id, at, value) of commands, read at block starts and ramped across the
    block: a stream-static join and a closed form, without state. The table is read anew for each micro-batch."""
    said = params.groupBy("signal_id").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("said"))
    both = df.join(said, "signal_id", "left").withColumn("block", F.expr(f"n div {size}"))

    def level(block):
        due = F.filter("said", lambda s: s["at"] <= block * size)
        return F.when(block < 0, F.lit(default)).otherwise(F.coalesce(F.get(due, F.size(due) - 1)["value"], F.lit(default)))

    g0, g1 = level(F.col("block") - 1), level(F.col("block"))
    return both.select("signal_id", "n", (F.col("x") * (g0 + (F.col("n") % size + 1) * (g1 - g0) / size)).alias("y"))
