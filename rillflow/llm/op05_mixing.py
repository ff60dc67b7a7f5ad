"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Every source's documents are put into a seeded shuffled order; laid end to end they are a stream of words, cut into
blocks of BLOCK words. Slot j of the schedule takes the golden-ratio point frac(j * phi), which falls to one source in
the cumulated target shares; its rank among that source's slots is the block it takes, modulo the source's blocks, so
the stream is read again from its start where a target exceeds it. A source has as many slots as its target needs:
surplus slots of a source are void, missing ones follow at the end (their number is bounded by the sequence's
discrepancy), and its last block is cut at the target. Hence every source yields floor(target) words.

Targets: sources by code point (null last) weigh 5, 2, 1, repeating, and share all words; a target stops at 3 times its
source's words, and the excess goes to the others by weight (water filling, solved in closed form).

Running sums are two-level (buckets of the shuffled order, chunks of the schedule), so a source with a third of all rows isn't in
one task. A row's place in the order comes from its doc_id and text together, so rows that share an id, or have none, are
dealt out like others. Rows without words are in no stream, as they are never taken: null and empty texts. Rows that
repeat a doc_id are rows of their own. Of docs only doc_id, text and source are read. An empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.llm.common import materialize, table

WEIGHTS, CAP, BLOCK, SEED = (5, 2, 1), 3, 4096, 20240607
PHI = 0.6180339887498949
ROWS, CHUNK = 1024, 1 << 16
SPACES = "[\\x20\\x09-\\x0D]+"


def word_count(text="text"):
    """Runs of anything but ASCII white space."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACES))).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, src, source_size, target) from rows with source and size; one row per source, src its rank."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("src", F.row_number().over(every) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod("src", F.lit(len(WEIGHTS))) + 1)
    by = by.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(CAP)))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    by = by.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(fill), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(fill), F.lit(0.0))))
    met = F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(F.col("cap") / F.col("w"), "src", "level"))
    by = by.withColumn("lambda", F.min(met).over(whole)["level"])
    return by.select("source", "src", "source_size", F.least(F.col("cap"), F.col("lambda") * F.col("w")).alias("target"))


def streams(sizes: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """sizes with src and the document's range [start, end) in its source's shuffled stream."""
    sizes = sizes.where("size > 0")
    n = sizes.count()
    digits = max(1, math.ceil(math.log(max(1, n / ROWS), 16)))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("text_md5")))
    named = sizes.join(sources.select(F.col("source").alias("_s"), "src"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("key", key).withColumn("part", F.substring("key", 1, digits))
    parts = named.groupBy("src", "part").agg(F.sum("size").alias("part_size"))
    parts = parts.select("src", "part", (F.sum("part_size").over(Window.partitionBy("src").orderBy("part")) - F.col("part_size")).alias("base"))
    inside = Window.partitionBy("src", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = named.withColumn("end", F.sum("size").over(inside)).join(parts, ["src", "part"])
    return out.select("src", "doc_id", "text_md5", "size", (F.col("base") + F.col("end") - F.col("size")).alias("start"), (F.col("base") + F.col("end")).alias("end"))


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(position, src, epoch, block, lo, hi): which words [lo, hi) of its source's stream each slot takes."""
    spark = sources.sparkSession
    need = sources.select("src", "source_size", F.floor("target").cast("long").alias("words")).where("words > 0")
    need = need.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("slots", F.expr("words div source_size * blocks") + F.ceil(F.expr("words % source_size") / block))
    need = need.withColumn("from", (F.sum("slots").over(Window.orderBy("src")) - F.col("slots"))).withColumn("total", F.sum("slots").over(Window.partitionBy()))
    need = materialize(need, "slots")
    total, kinds = need.agg(F.coalesce(F.max("total"), F.lit(0)), F.count("*")).first()
    grid = max(1, 4 * kinds)
    cells = need.select("src", "from", (F.col("from") + F.col("slots")).alias("to"), F.explode(F.sequence(F.floor(F.col("from") * grid / F.col("total")), F.ceil((F.col("from") + F.col("slots")) * grid / F.col("total")))).alias("cell"))
    x = F.col("j") * PHI - F.floor(F.col("j") * PHI)
    points = spark.range(int(total)).select(F.col("id").alias("j")).withColumn("y", x * int(total)).withColumn("cell", F.floor(F.col("y") * grid / max(1, total)))
    hit = points.join(cells, "cell").where("y >= `from` and y < `to`").select("j", "src", F.expr(f"j div {CHUNK}").alias("chunk"))
    per = hit.groupBy("src", "chunk").agg(F.count("*").alias("n"))
    per = per.select("src", "chunk", (F.sum("n").over(Window.partitionBy("src").orderBy("chunk")) - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy("src")).alias("got"))
    per = materialize(per, "chunks")
    ranked = hit.withColumn("k", F.row_number().over(Window.partitionBy("src", "chunk").orderBy("j")) - 1).join(per, ["src", "chunk"]).select("j", "src", (F.col("base") + F.col("k")).alias("rank"))
    got = per.groupBy("src").agg(F.max("got").alias("got"))
    late = need.join(got, "src", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
    late = late.select((F.col("total") + F.col("from")).alias("j"), "src", F.explode(F.expr("sequence(got, slots - 1)")).alias("rank"))
    late = late.select((F.col("j") + F.col("rank")).alias("j"), "src", "rank")
    slots = ranked.unionByName(late).join(need.select("src", "source_size", "words", "blocks", "slots"), "src").where("rank < slots")
    slots = slots.withColumn("epoch", F.expr("rank div blocks")).withColumn("block", F.expr("rank % blocks")).withColumn("lo", F.col("block") * block)
    hi = F.least((F.col("block") + 1) * block, F.col("source_size"), F.col("words") - F.col("epoch") * F.col("source_size"))
    return slots.select(F.col("j").alias("position"), "src", "epoch", "block", "lo", hi.alias("hi"))


def mixed(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per document, schedule, pieces). Per document: doc_id, text_md5 and the columns of the query. pieces: (src, block, doc_id, size, start, lo, hi), the part of each document
    in each block; schedule joined with pieces on (src, block) is the mix in order of position."""
    text_md5 = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    sizes = materialize(docs.select("doc_id", text_md5.alias("text_md5"), "source", word_count().alias("size")), "sizes")
    sources = materialize(targets(sizes), "sources")
    stream = materialize(streams(sizes, sources, seed), "streams")
    slots = schedule(sources, block)
    pieces = stream.select("src", "doc_id", "size", "start", "end", F.explode(F.expr(f"sequence(start div {block}, (end - 1) div {block})")).alias("block"))
    pieces = pieces.select("src", "block", "doc_id", "size", "start", F.greatest("start", F.col("block") * block).alias("lo"), F.least("end", (F.col("block") + 1) * block).alias("hi"))
    uses = slots.groupBy("src", "block", "hi").agg(F.count("*").alias("uses")).withColumnRenamed("hi", "to")
    got = pieces.join(uses, ["src", "block"]).select("src", "start", (F.col("uses") * F.greatest(F.lit(0), F.least("hi", "to") - F.col("lo"))).alias("t")).groupBy("src", "start").agg(F.sum("t").alias("taken"))
    out = stream.join(got, ["src", "start"], "left").select("src", "doc_id", "text_md5", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    told = sources.select("source", "src", "source_size", "target")
    out = out.join(told, "src").select("doc_id", "text_md5", "source", "size", "source_size", "target", "taken")
    none = sizes.where("size = 0").alias("d").join(told.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    none = none.select("doc_id", "text_md5", "d.source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return out.unionByName(none), slots, pieces


def query(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS src FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][src % 3 + 1] AS w, source_size * 3.0::DOUBLE AS cap FROM s),
f AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS level
    FROM w WINDOW b AS (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, w * (SELECT level FROM f WHERE cap / w >= level ORDER BY cap / w, src LIMIT 1)) AS target FROM f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS words,
        CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE words // source_size * size + greatest(0, least(hi, words % source_size) - (hi - size)) END AS BIGINT) AS taken FROM p
"""
