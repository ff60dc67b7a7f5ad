"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (hi, lo, n_docs, last_doc), one row per line key: the 128-bit hash of the key, the rows (documents) that
hold it and the greatest doc_id among them. Runs are bucketed and sorted by the key, all in the same buckets, so two of them
meet bucket by bucket in a merge join without being dealt out again. Each batch adds a run of level 0; FANOUT runs of a level
are merged to one of the next.

Documents come in batches from the greatest ids down. A batch's keys are anti-joined with the runs so far: a key that no run has and
one row of the batch alone holds is settled, as that row is its last document; all other lines are put by. A line is
dropped if its key is found in at least MIN_DOCS documents and its document isn't the key's last: how many hold it is known
after the last batch, so lines that were put by are joined with the merged runs then. A store that is kept serves later batches.
In these joins the keys that more than one in HEAVY of the rows hold, fewer than HEAVY of them at any size, are sent to the rows, as
a common line's rows would else meet in one task; the rows of the others are dealt by key.

A key is the line stripped of ASCII white space at both ends, A-Z lower-cased; keys under MIN_CHARS code points are
never dropped. Null or empty texts are one empty line, and an empty table gives an empty one. Every row is a document; rows that
repeat the greatest doc_id of a key all keep its lines, and a null doc_id ranks below all others. Rows are told apart by
doc_id and text; those equal in both lose the same lines. Of docs only doc_id and text are read, so other columns' names don't matter.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import as_bytes, batches, forget, fresh_path, materialize, table, text_key, tuned

MIN_CHARS, MIN_DOCS = 20, 3
BATCHES, FANOUT = 4, 2
#: Keys in one bucket of a run, about.
BUCKET_KEYS, LEAST_BUCKETS = 1_000_000, 16
_SPACE = b" \t\n\x0b\x0c\r"
#: 1 / HEAVY of all rows are too many for one task; as many keys, of 40 bytes each, aren't too many to send.
HEAVY = 20_000
RUN = "hi long, lo long, n_docs long, last_doc long"


def line_key(line: bytes) -> bytes | None:
    """The 16-byte hash of the line's key, or None if the key is short."""
    key = line.strip(_SPACE).lower()
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode("utf-8", "replace")) < MIN_CHARS):
        return None
    return xxhash.xxh3_128_digest(key)


def _keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n x 2 int64 of distinct keys in each text, their text)."""
    found, at = [], []
    for i, t in enumerate(texts):
        own = {k for line in t.split(b"\n") if (k := line_key(line)) is not None}
        found += own
        at += [i] * len(own)
    return np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, 2), np.array(at, np.int64)


KEYED = pa.schema([("batch", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64())])


def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it, column=3):
        key, at = _keys(b.column(3).to_pylist())
        rows = pa.array(at)
        yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array(key[:, 0]), pa.array(key[:, 1]), b.column(1).take(rows), b.column(2).take(rows)], schema=KEYED)


def join_keys(rows: DataFrame, run: DataFrame, total: int) -> DataFrame:
    """The inner join of rows (hi, lo, ...) with a run, whose n_docs are total at most in sum."""
    many = F.col("n_docs") > total // HEAVY
    heavy = F.broadcast(materialize(run.where(many), "heavy"))  # fewer than HEAVY keys can have that many of total
    rest = rows.join(heavy.select("hi", "lo"), ["hi", "lo"], "left_anti").join(run.where(~many), ["hi", "lo"])
    return rows.join(heavy, ["hi", "lo"]).unionByName(rest)


class LineRuns:
    """A store of levelled sorted runs in one folder. add() takes (hi, lo, doc_id), one row per key and document."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT, buckets: int = LEAST_BUCKETS):
        self.spark, self.path, self.fanout, self.buckets = spark, path or fresh_path(spark, "runs"), fanout, buckets
        self.levels: list[list[str]] = []
        self.name = f"rillflow_{uuid.uuid4().hex}"
        self.written, self.total = 0, 0

    def _write(self, run: DataFrame, level: int) -> str:
        name, at = f"{self.name}_{self.written}", f"{self.path}/level={level}/run={self.written}"
        self.written += 1
        # rows go where the table's buckets are: a file for each
        dealt = run.repartitionById(self.buckets, F.expr(f"pmod(hash(hi, lo), {self.buckets})"))
        dealt.write.format("parquet").option("path", at).bucketBy(self.buckets, "hi", "lo").sortBy("hi", "lo").saveAsTable(name)
        forget(self.spark, at)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """The runs as one, by merge joins of their buckets."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).select("hi", "lo", F.col("n_docs").alias("n"), F.col("last_doc").alias("d"))
            both = out.hint("merge").join(more.hint("merge"), ["hi", "lo"], "full")
            out = both.select("hi", "lo", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "d").alias("last_doc"))
        return out

    def add(self, keys: DataFrame) -> DataFrame:
        """Adds a batch's run; returns the keys (hi, lo) that aren't settled by it."""
        return self.add_counted(keys).select("hi", "lo")

    def add_counted(self, keys: DataFrame) -> DataFrame:
        """Adds a batch's run. Returns what it has of the keys (hi, lo, n_docs, last_doc) that aren't settled by it: the anti join
        with the runs before has left them out, or several of the batch's rows hold them."""
        before = self.rows() if any(self.levels) else None
        own = self._write(keys.groupBy("hi", "lo").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")), 0)
        run = self.spark.table(own)
        self.total += run.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
        if before is not None:
            fresh = run.hint("merge").join(before.select("hi", "lo").hint("merge"), ["hi", "lo"], "left_anti").where("n_docs = 1")
        else:
            fresh = run.where("n_docs = 1")
        open_keys = run.hint("merge").join(fresh.select("hi", "lo").hint("merge"), ["hi", "lo"], "left_anti")
        open_keys = materialize(open_keys, "open-keys")
        level = 0
        while len(self.levels[level]) >= self.fanout:  # compaction
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)
            for name in full:
                self.spark.sql(f"DROP TABLE {name}")
            level += 1
        return open_keys

    def rows(self) -> DataFrame:
        """The whole store, merged over all runs."""
        names = [p for level in self.levels for p in level]
        return self._merged(names) if names else self.spark.createDataFrame([], RUN)

    def dropped(self, keys: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
        """The rows of keys (hi, lo, doc_id, ...) that the runs let go."""
        often = self.rows().where(F.col("n_docs") >= min_docs)
        return join_keys(keys, often, self.total).where(F.coalesce(F.col("doc_id") < F.col("last_doc"), F.col("doc_id").isNull() & F.col("last_doc").isNotNull()))

    def close(self) -> None:
        for name in [p for level in self.levels for p in level]:
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


CLEAN = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text binary"


def _stripped(it: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches(it):
        out: list[list] = [[], [], [], []]
        for text, drop in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            lines = text.split(b"\n")
            kept = lines
            if drop:
                gone = {bytes(drop[i : i + 16]) for i in range(0, len(drop), 16)}
                kept = [x for x in lines if line_key(x) not in gone]
            whole = b"\n".join(kept)
            for col, v in zip(out, (len(lines), len(lines) - len(kept), hashlib.sha256(whole).hexdigest(), whole if with_text else None), strict=True):
                col.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.binary())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"])


def dedup_lines(docs: DataFrame, store: LineRuns | None = None, with_text: bool = True) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_dropped, kept_sha256 and kept_text (bytes; null unless with_text)."""
    spark = tuned(docs.sparkSession)
    text = as_bytes(docs.select("doc_id", text_key().alias("text_key"), "text"), "doc_id", "text_key")
    # from the greatest ids down; where exactly batches end doesn't matter
    ends = docs.agg(F.percentile_approx("doc_id", [k / BATCHES for k in range(BATCHES - 1, 0, -1)], 1000)).first()[0] or []
    batch = F.lit(BATCHES - 1)
    for k, end in reversed(list(enumerate(ends))):
        batch = F.when(F.col("doc_id") > end, k).otherwise(batch)
    path = fresh_path(spark, "line-keys")
    text.select(batch.cast("int").alias("batch"), "doc_id", "text_key", "text").mapInArrow(keyed, "batch int, hi long, lo long, doc_id long, text_key long").write.partitionBy("batch").parquet(path)
    forget(spark, path)
    keys = spark.read.schema("hi long, lo long, doc_id long, text_key long, batch int").parquet(path)
    store = store or LineRuns(spark, buckets=max(LEAST_BUCKETS, -(-keys.count() // BUCKET_KEYS)))
    waiting = []
    for b in range(BATCHES):
        own = keys.where(F.col("batch") == b)
        before = store.total
        open_keys = store.add_counted(own.select("hi", "lo", "doc_id"))
        rows = join_keys(own.select("hi", "lo", "doc_id", "text_key"), open_keys, store.total - before)
        waiting.append(materialize(rows.select("hi", "lo", "doc_id", "text_key").distinct(), "put-by"))
    gone = store.dropped(reduce(DataFrame.unionByName, waiting))
    digest = F.unhex(F.concat(*[F.lpad(F.hex(k), 16, "0") for k in ("hi", "lo")]))
    per_doc = gone.select("doc_id", "text_key", digest.alias("k")).groupBy("doc_id", "text_key").agg(F.array_join(F.transform(F.collect_list("k"), F.hex), "").alias("k"))
    gone = materialize(per_doc.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), F.unhex("k").alias("gone")), "dropped")
    store.close()
    joined = text.join(gone, text["doc_id"].eqNullSafe(gone["gone_id"]) & (text["text_key"] == gone["gone_key"]), "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(lambda it: _stripped(it, with_text), CLEAN)


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


ORACLE = r"""
WITH l AS (SELECT doc_id, row_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT doc_id, row_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS pos
        FROM (SELECT doc_id, row_number() OVER () AS row_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
o AS (SELECT k, max(doc_id) AS last_doc FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT row_id) >= 3),
m AS (SELECT l.*, (o.k IS NOT NULL AND coalesce(l.doc_id < o.last_doc, l.doc_id IS NULL AND o.last_doc IS NOT NULL)) AS gone FROM l LEFT JOIN o USING (k))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY row_id, doc_id
"""
