"""Block aggregates, controllers and gates over (signal_id, n, x), and their closed-form ramps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.ship import ship


def by_block():
    return Window.partitionBy("signal_id").orderBy("block")


def block_power(df: DataFrame, size: int) -> DataFrame:
    return df.groupBy("signal_id", F.expr(f"n div {size}").alias("block")).agg(F.avg(F.col("x") * F.col("x")).alias("power"))


def ramped(df: DataFrame, gains: DataFrame, size: int, start: float = 1.0) -> DataFrame:
    """x times a gain (signal_id, block, g) that moves linearly across each block and arrives at its end."""
    both = gains.withColumn("g0", F.lag("g", 1, start).over(by_block()))
    at = df.withColumn("block", F.expr(f"n div {size}")).join(both, ["signal_id", "block"])
    return at.select("signal_id", "n", (F.col("x") * (F.col("g0") + (F.col("n") % size + 1) * (F.col("g") - F.col("g0")) / size)).alias("y"))


def glide(df: DataFrame, levels: dict[str, tuple[DataFrame, float]], size: int) -> DataFrame:
    """df with a column per parameter: its level (signal_id, block, g) moves linearly across each block, from the block before (or
    the value it starts with) to its own at the block's end. How parameter edges, mutes, solos and fades reach a node."""
    at = df.withColumn("block", F.expr(f"n div {size}"))
    for name, (level, start) in levels.items():
        both = level.select("signal_id", "block", F.col("g").alias("_g"), F.lag("g", 1, start).over(by_block()).alias("_g0"))
        at = at.join(both, ["signal_id", "block"]).withColumn(name, F.col("_g0") + (F.col("n") % size + 1) * (F.col("_g") - F.col("_g0")) / size).drop("_g", "_g0")
    return at.drop("block")


def transitions(blocks: DataFrame, said: DataFrame, nodes: list[str], start: float = 0.0) -> DataFrame:
    """The level of each node by block from a short table of commands (block, command, node): mute and fade_out to 0, unmute and
    fade_in to 1, solo to 1 and all others to 0; a later command of a block wins over an earlier one by its place in this list."""
    orders = ["mute", "unmute", "solo", "fade_in", "fade_out"]
    rank = F.array_position(F.array(*[F.lit(o) for o in orders]), F.col("command"))
    out = blocks
    for k in nodes:
        target = F.when(F.col("command") == "solo", F.when(F.col("node") == k, 1.0).otherwise(0.0)).when(F.col("node") == k, F.when(F.col("command").isin("unmute", "fade_in"), 1.0).otherwise(0.0))
        own = said.select(F.col("block").alias("_b"), rank.alias("_r"), target.alias("_t")).where("_t is not null")
        # the commands are a handful, typed by hand: they go with the plan
        due = F.broadcast(own.groupBy("_b").agg(F.max_by("_t", "_r").alias("_t")))
        named = out.join(due, F.col("block") == F.col("_b"), "left").drop("_b")
        held = F.last("_t", ignorenulls=True).over(by_block().rowsBetween(Window.unboundedPreceding, 0))
        out = named.withColumn(k, F.coalesce(held, F.lit(start))).drop("_t")
    return out


def agc_gains(df: DataFrame, size: int, target: float = 0.25, rate: float = 0.1, top: float = 8.0) -> DataFrame:
    """(signal_id, block, g): g moves by a rate towards target / rms, at most top. Blocks are few, so the fold runs per signal."""
    ship(df.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        g, out = 1.0, []
        for p in pdf["power"]:
            g += rate * (min(target / max(p**0.5, 1e-9), top) - g)
            out.append(g)
        return pd.DataFrame({"signal_id": pdf["signal_id"], "block": pdf["block"], "g": out})

    return block_power(df, size).groupBy("signal_id").applyInPandas(one, "signal_id string, block long, g double")


def agc(df: DataFrame, size: int, **kw) -> DataFrame:
    return ramped(df, agc_gains(df, size, **kw), size)


def power_gate(df: DataFrame, size: int, opens: float, closes: float) -> DataFrame:
    """1 once power is over opens, 0 once under closes, else as before: the last decision that was made."""
    if opens < closes:
        raise ValueError("opens must be at least closes")
    p = block_power(df, size)
    said = F.when(F.col("power") > opens, 1).when(F.col("power") < closes, 0)
    held = F.last(said, ignorenulls=True).over(by_block().rowsBetween(Window.unboundedPreceding, 0))
    return p.select("signal_id", "block", F.coalesce(held, F.lit(0)).alias("gate"))


def block_end(df: DataFrame, size: int, col: str) -> DataFrame:
    """A sample-rate control read at the end of each block."""
    return df.groupBy("signal_id", F.expr(f"n div {size}").alias("block")).agg(F.max_by(col, "n").alias(col))


def scheduled(df: DataFrame, params: DataFrame, size: int, default: float = 1.0) -> DataFrame:
    """As-of join of a parameter table (at, value): a block takes the latest value due by its start. One ordered pass over the
    union of block starts and commands."""
    starts = df.select("signal_id", F.expr(f"n div {size}").alias("block")).distinct()
    due = starts.select("signal_id", "block", (F.col("block") * size).alias("at"), F.lit(None).cast("double").alias("value"), F.lit(1).alias("kind"))
    said = params.join(df.select("signal_id").distinct(), "signal_id", "left_semi").select("signal_id", F.lit(None).cast("long").alias("block"), "at", "value", F.lit(0).alias("kind"))
    w = Window.partitionBy("signal_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = due.unionByName(said).withColumn("value", F.coalesce(F.last("value", ignorenulls=True).over(w), F.lit(default)))
    return both.where("kind = 1").select("signal_id", "block", "value")


def event_lane(events: DataFrame, size: int, blocks_from: int = 0, cap: int | None = None) -> DataFrame:
    """(block, offset) of events by their sample: those before the first block apply at its start; cap keeps the first of a
    block if asked for."""
    at = F.greatest(F.col("at"), F.lit(blocks_from * size))
    out = events.withColumn("block", F.expr(f"greatest(at, {blocks_from * size}) div {size}")).withColumn("offset", at % size)
    if cap is not None:
        w = Window.partitionBy("signal_id", "block").orderBy("offset", "seq")
        out = out.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cap).drop("_k")
    return out
