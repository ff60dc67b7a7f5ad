"""Sharding by a two-pass external shuffle, in DataFrame operations only.

A first look counts rows and bytes per cell, a seeded hash of the row. Pass one scatters all records by their cell
into buckets that fit in memory: the exchange writes them to disk. Pass two takes a bucket at a time, puts its rows into an order
that doesn't depend on how they came, shuffles them by Spark's seeded Fisher-Yates, and writes them. Buckets follow
one another, so a row has a position in the whole order; shard = position * shards / rows, hence counts of shards
differ by one at most (law 'rows'). The files of a shard lie in shard=<n>; column slot gives the order in it.

Rows that are equal in all columns share a cell, whose bucket may then be too large. Rows of cells over bucket_bytes are
counted by value, and the copies of a value, which are interchangeable, are numbered and scattered by value and number.
There are CELLS_PER_BUCKET cells for each bucket, at least LEAST_CELLS, whatever the input's size; buckets grow beyond bucket_bytes only
where there would be more than MOST_BUCKETS (12 TB; 190 MB a bucket at 100 TB), which bounds the broadcast table of their first positions.

Null texts have no bytes; null ids scatter by their text. Columns must be orderable (no maps); any names may occur, but for
'shard' and 'slot', which are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.llm.common import free_names, fresh_path, materialize, table

SHARDS, SEED = 24, 20240607
#: A bucket's bytes of text: a task holds a few copies of it.
BUCKET_BYTES = 24 << 20
LEAST_CELLS, CELLS_PER_BUCKET, MOST_BUCKETS = 1 << 16, 64, 1 << 19
LAW = "rows"


def text_size(text="text"):
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long")


def counted(rows: DataFrame, cells: int) -> DataFrame:
    """(cell, n, bytes) of rows with a 64-bit draw and a size."""
    return materialize(rows.groupBy(F.pmod("draw", F.lit(cells)).alias("cell")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "cells")


def shuffle_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> DataFrame:
    """docs with columns shard and slot, as written to path (a fresh one in the shared folder)."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    cols = docs.columns
    body = F.struct(*[F.col(f"`{c}`") for c in cols]).alias("r")
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    drawn = docs.select(draw.alias("draw"), text_size().alias("size"))
    cells = LEAST_CELLS
    counts = counted(drawn, cells)
    rows, size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    buckets = min(MOST_BUCKETS, max(1, math.ceil(size / bucket_bytes)))
    if buckets * CELLS_PER_BUCKET > cells:
        cells = 1 << (buckets * CELLS_PER_BUCKET - 1).bit_length()
        counts = counted(drawn, cells)
    cell = F.pmod("draw", F.lit(cells))
    most = max(bucket_bytes, math.ceil(size / buckets))
    held = docs.select(draw.alias("draw"), body)
    # few: at most size / most of them
    hot = [r.cell for r in counts.where(F.col("bytes") > most).select("cell").collect()]
    if hot:
        among = cell.isin(hot)
        value = held.where(among).groupBy("draw", "r").agg(F.count("*").alias("copies"))
        spread = value.select(F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("k"), "draw", "r").select(F.xxhash64("draw", "k").alias("draw"), "r")
        held = held.where(~among).unionByName(materialize(spread, "copies"))
        counts = counted(held.select("draw", text_size("r.text").alias("size")), cells)
    bucket_of = lambda c: F.floor(c * buckets / cells).cast("int")
    per_bucket = counts.groupBy(bucket_of(F.col("cell")).alias("b")).agg(F.sum("n").alias("n"))
    before = per_bucket.select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("first"))  # MOST_BUCKETS rows at most
    scattered = held.select(bucket_of(cell).alias("b"), F.struct(F.xxhash64(F.lit(seed + 1), "draw").alias("o"), "r").alias("x")).repartitionById(buckets, F.col("b"))
    whole = scattered.groupBy("b").agg(F.sort_array(F.collect_list("x")).alias("xs")).join(F.broadcast(before), "b").sortWithinPartitions("b")
    dealt = whole.select("first", F.posexplode(F.shuffle("xs", F.lit(seed))).alias("i", "x"))
    place = F.col("first") + F.col("i")
    shard = F.floor(place * shards / max(1, rows)) if rows * shards < 2**52 else F.expr(f"(first + i) * {shards} div {rows}")
    (at,) = free_names(cols, "place")
    out = dealt.select("x.r.*", place.alias(at), shard.cast("int").alias("shard"))
    # the least place in shard s is ceil(s * rows / shards)
    slot = F.col(at) - F.expr(f"(cast(shard as bigint) * {rows} + {shards - 1}) div {shards}")
    path = path or fresh_path(spark, "shards")
    out = out.withColumn("slot", slot.cast("long")).drop(at)
    out.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    fields = [f for f in out.schema.fields if f.name != "shard"]
    return spark.read.schema(type(out.schema)([*fields, out.schema["shard"]])).parquet(path)


def digest(sharded: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return sharded.select("doc_id", text_size().alias("size"), F.crc32(text).alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    return digest(shuffle_shards(table(spark, sf_dir, "documents")))
