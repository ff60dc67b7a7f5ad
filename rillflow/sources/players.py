"""Sources that are read at a demand of their own: looped and drained buffers, prefetched ones with gaps, players with a pitch
schedule, taps between two plans, buffered events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.ship import ship
from rillflow.operators import history


def demanded(df: DataFrame, length: Column) -> DataFrame:
    """(signal_id, len, n): n below a length given in terms of len, the signal's own. Each sample makes its share of them, so a
    partition makes as many rows as it has samples for; from a table of lengths, which is small, few tasks would make all. The number
    of partitions is given, as Spark would merge them by the bytes they read, which are few against those they make."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = Window.partitionBy("signal_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = df.select("signal_id", "n").repartition(parts, "signal_id")
    own = own.select("signal_id", "n", (F.max("n").over(whole) + 1).alias("len"), F.lag("n").over(history.order()).alias("_past"))
    own = own.withColumn("_size", length.cast("long")).where("n >= 0")
    first = (F.greatest(F.coalesce("_past", F.lit(-1)), F.lit(-1)) + 1) * F.col("_size")
    own = own.select("signal_id", "len", first.alias("_from"), ((F.col("n") + 1) * F.col("_size")).alias("_to"))
    own = own.withColumn("_from", F.expr("_from div len")).withColumn("_to", F.expr("_to div len - 1")).where("_from <= _to")
    return own.select("signal_id", "len", F.explode(F.sequence("_from", "_to")).alias("n"))


def buffer(df: DataFrame, length: Column, loop: bool) -> DataFrame:
    """(signal_id, n, y, exhausted): a buffer read to a length, from its start again or with silence past its end."""
    out = demanded(df, length)
    read = history.gather(df, out, F.col("n") % F.col("len") if loop else F.col("n"))
    return read.select("signal_id", "n", F.col("_v").alias("y"), (F.lit(not loop) & (F.col("n") >= F.col("len"))).alias("exhausted"))


def prefetched(df: DataFrame, length: Column) -> DataFrame:
    """(signal_id, n, y, underruns): samples that haven't come are the last one that has, and are counted."""
    out = demanded(df, length).select("signal_id", "n").join(df.select("signal_id", "n", "x"), ["signal_id", "n"], "left")
    past = history.order().rowsBetween(Window.unboundedPreceding, 0)
    missing = F.sum(F.when(F.col("x").isNull(), 1).otherwise(0)).over(past)
    return out.select("signal_id", "n", F.coalesce(F.last("x", ignorenulls=True).over(past), F.lit(0.0)).alias("y"), missing.alias("underruns"))


def played(df: DataFrame, pitch: Column, length: Column, loop: bool) -> DataFrame:
    """(signal_id, n, y): a buffer read at a step of pitch (in 1/2 .. 2, a column of n) per sample, by linear interpolation."""
    out = demanded(df, length).withColumn("step", F.greatest(F.lit(0.5), F.least(F.lit(2.0), pitch)))
    at = out.withColumn("c", F.sum("step").over(history.order()) - F.col("step"))
    if loop:
        at = at.withColumn("c", F.col("c") - F.floor(F.col("c") / F.col("len")) * F.col("len"))
    one = history.gather(df, at, F.floor("c")).withColumnRenamed("_v", "a")
    after = F.floor("c") + 1
    two = history.gather(df, one, after % F.col("len") if loop else after)
    y = F.col("a") + (F.col("c") - F.floor("c")) * (F.col("_v") - F.col("a"))
    return two.select("signal_id", "n", F.when(F.col("c") < F.col("len"), y).otherwise(0.0).alias("y"))


def varied(df: DataFrame, ratio: Column, top: int = 4) -> DataFrame:
    """(signal_id, n, y): outputs per input by a ratio in 1/4 .. 4, a column of the output's n; interpolation between the two inputs
    before the read position. Ends where the position passes the last input."""
    out = demanded(df, F.col("len") * top).withColumn("step", 1 / F.greatest(F.lit(0.25), F.least(F.lit(4.0), ratio)))
    at = out.withColumn("c", F.sum("step").over(history.order()) - F.col("step")).where("c < len")
    one = history.gather(df, at, F.floor("c") - 1).withColumnRenamed("_v", "a")
    two = history.gather(df, one, F.floor("c"))
    return two.select("signal_id", "n", (F.col("a") + (F.col("c") - F.floor("c")) * (F.col("_v") - F.col("a"))).alias("y"))


def injected(df: DataFrame, start: int, length: int) -> DataFrame:
    """A window of a signal as a signal of its own: [start, start + length), silence past the end."""
    out = demanded(df, F.lit(length)).select("signal_id", "n")
    return history.gather(df, out, F.col("n") + start).select("signal_id", "n", F.col("_v").alias("x"))


def captured(df: DataFrame, skip: int, capacity: int) -> DataFrame:
    """What a sink of a capacity holds after it has passed over the first skip samples (a plan's latency)."""
    return df.where((F.col("n") >= skip) & (F.col("n") < skip + capacity)).withColumn("n", F.col("n") - skip)


def tap(df: DataFrame, push: int, pop: int, cap: int) -> DataFrame:
    """What comes through a ring between two plans: each tick the one puts push samples in, of which those that find it full are
    dropped, then the other takes pop; what it finds missing is silence. (signal_id, n, y), n as the reader counts."""
    ship(df.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("n")["x"].tolist()
        ring, out = [], []
        for at in range(0, len(x), push):
            ring += x[at : at + push][: cap - len(ring)]
            got, ring = ring[:pop], ring[pop:]
            out += got + [0.0] * (pop - len(got))
        return pd.DataFrame({"signal_id": pdf["signal_id"].iloc[0], "n": range(len(out)), "y": out})

    return df.select("signal_id", "n", "x").groupBy("signal_id").applyInPandas(one, "signal_id string, n long, y double")


def buffered_events(events: DataFrame, capacity: int) -> DataFrame:
    """Timed events (node, seq, at, ...) as a queue of a capacity hands them on: the first that came, in order of time."""
    came = F.row_number().over(Window.partitionBy("node").orderBy("seq"))
    held = events.withColumn("_k", came).where(F.col("_k") <= capacity).drop("_k")
    return held.withColumn("position", F.row_number().over(Window.partitionBy("node").orderBy("at", "seq")) - 1)
