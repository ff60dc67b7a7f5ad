"""Shared helpers: durable intermediate tables, tokenisation to hashes, batch plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions.ship import ship

U64 = np.uint64
#: Rows in one Arrow batch; documents may be long, so batches are kept short.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or an own one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        found = tempfile.mkdtemp(prefix="rillflow-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/rillflow-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors, and lets the
    planner know the true size of what follows."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    forget(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str, now: bool = False) -> None:
    """Delete an intermediate table when the application ends, or now."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(target, True) if now else files.deleteOnExit(target)


def free_names(columns: list[str], *bases: str) -> list[str]:
    """A name for each base that no column has."""
    taken = {c.lower() for c in columns}
    return [next(n for i in range(len(taken) + 1) if (n := f"_{b}{i or ''}") not in taken) for b in bases]


def text_key(text: str = "text"):
    """A 64-bit hash of the text; with the doc_id it tells rows apart that share an id. Rows equal in both are interchangeable."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")).cast("binary"))


#: Bits of a bitmap that lets the rows through whose key may be among some; at most so many, whatever the number of keys.
BITMAP_BITS = 1 << 26


def bitmap_of(keys: DataFrame, key: str, n: int) -> np.ndarray:
    """Bits of the low part of each 64-bit key, 16 for a key until BITMAP_BITS are reached; from there more rows pass. Words are made by
    the executors; the driver gets BITMAP_BITS / 64 numbers at most."""
    bits = min(BITMAP_BITS, 1 << max(12, (16 * max(1, n)).bit_length()))
    at = F.col(key).bitwiseAND(F.lit(bits - 1))
    words = keys.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(`{key}` & 63 as int))").alias("b")).groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Of int64 keys, whether each one's bit is set."""
    at = keys & np.int64(len(bitmap) * 64 - 1)
    return ((bitmap[at >> 6] >> (at & 63)) & 1).astype(bool)


def tuned(spark: SparkSession) -> SparkSession:
    """Short Arrow batches, so that a worker's memory doesn't follow the length of documents."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_bytes(docs: DataFrame, *cols: str) -> DataFrame:
    """The named id columns and the text as UTF-8 bytes (column 'text'), null texts as empty."""
    return docs.select(*cols, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


#: For word hashes: a random odd base, its inverse modulo 2^64, and a random value for each byte.
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 2**64)
_BYTE = np.random.default_rng(20240607).integers(0, 2**64, 256, U64)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
#: ASCII white space, [\x20\x09-\x0D].
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[k] = np.cumprod(p)
    return _POWERS


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without copying it."""
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type) else np.int32
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words of each document) of all words, runs of bytes that aren't white space."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    ink = ~IS_SPACE[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edge] = ink[edge]
    edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[edge] = ink[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    cuts = np.searchsorted(start, offsets)
    return start, end, np.diff(cuts)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes (of its length and bytes, A-Z lower-cased if asked), without a loop."""
    power, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum((_LOWER if lower else _BYTE)[data] * power[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64))


def words_of(col: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each document) of a binary column of texts."""
    data, offsets = buffer_of(col)
    start, end, lengths = word_spans(data, offsets)
    return span_hashes(data, start, end, lower), lengths


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64 bits with good avalanche."""
    with np.errstate(over="ignore"):
        x = x + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width consecutive hashes (len(h) - width + 1 of them)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for k in range(1, width):
            out = out * U64(0x9E3779B97F4A7C15) + h[k : n + k]
            out ^= out >> U64(32)
        return mix(out)


def flat_windows(h: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of many documents whose hashes lie end to end. Returns (window hash, document index, start within the
    document). A document shorter than width but not empty yields one window: all it has."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)
    pos = np.arange(len(h)) - np.repeat(starts, lengths)
    n = max(0, len(h) - width + 1)
    full = window_hashes(h, width)
    ok = pos[:n] + width <= lengths[doc[:n]]
    short = np.flatnonzero((lengths > 0) & (lengths < width))
    one = np.array([window_hashes(h[starts[d] : ends[d]], int(lengths[d]))[0] for d in short], U64)
    return (
        np.concatenate([full[ok], one]),
        np.concatenate([doc[:n][ok], short]),
        np.concatenate([pos[:n][ok], np.zeros(len(short), pos.dtype)]),
    )


def batches(it: Iterator, rows: int = BATCH_ROWS, column: int = 1, size: int = 16_000_000) -> Iterator:
    """Arrow batches cut to at most so many rows and, but for single long rows, bytes of the named binary column."""
    for b in it:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, rows)
            _, offsets = buffer_of(part.column(column))
            n = max(1, int(np.searchsorted(offsets, size, "right")) - 1)
            yield part.slice(0, n)
            at += min(n, part.num_rows)


def trim() -> None:
    """Give memory that large arrays have left back to the system, as workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def crc_mod(col: str, mod: int):
    """crc32 of the id written as text, modulo mod (null ids: of the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod
