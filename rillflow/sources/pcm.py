"""PCM files: WAV and raw reading, feature matrices, sidecars."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions.ship import ship
from rillflow.operators import history

#: Samples in one output batch.
STEP = 1 << 16
#: Bytes of a text in one row of an input batch.
PIECE = 1 << 10


def normalised(raw: bytes, form: str) -> np.ndarray:
    """Samples of a format such as s16le, u8, s24be or f32le, as float64."""
    kind, rest = form[0], form[1:]
    little = not rest.endswith("be")
    bits = int(rest.removesuffix("le").removesuffix("be"))
    width = bits // 8
    raw = raw[: len(raw) // width * width]
    if kind == "f":
        return np.frombuffer(raw, f"{'<' if little else '>'}f{width}").astype(float)
    b = np.frombuffer(raw, np.uint8).reshape(-1, width).astype(np.int64)
    b = b if little else b[:, ::-1]
    code = (b << (8 * np.arange(width))).sum(axis=1)
    mid = 1 << (bits - 1)
    return (code - mid) / mid if kind == "u" else np.where(code >= mid, code - 2 * mid, code) / mid


def wav(raw: bytes) -> tuple[int, int, str, bytes]:
    """(rate, channels, format, sample bytes) of a RIFF file."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate, channels, form, data = 12, 0, 0, "", b""
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        body = raw[at + 8 : at + 8 + size]
        if name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if code == 0xFFFE:
                code = struct.unpack_from("<H", body, 24)[0]
            form = f"f{bits}le" if code == 3 else "u8" if bits == 8 else f"s{bits}le"
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    return rate, channels, form, data


def read_pcm(spark: SparkSession, path: str, form: str | None = None, channels: int = 1) -> DataFrame:
    """(signal_id, n, ch, x) of all files under a path: raw samples of one format, or WAV files if none is named. Files are
    tasks; a file is read whole."""
    ship(spark)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rate, c, f, data = (0, channels, form, raw) if form else wav(raw)
                x = normalised(data, f)
                for at in range(0, len(x), STEP):
                    part = x[at : at + STEP]
                    pos = np.arange(at, at + len(part))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(pos // c), pa.array((pos % c).astype(np.int32)), pa.array(part)], names=["signal_id", "n", "ch", "x"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "signal_id string, n long, ch int, x double")


def byte_levels(docs: DataFrame) -> DataFrame:
    """(doc_id, n, mean, low) of each row's text read as unsigned 8-bit samples: one pass over the bytes. A text comes in pieces,
    in order, so a batch holds as many bytes as its rows have room for, however long the texts are."""
    ship(docs.sparkSession)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        ids, n, total, least = zip(*rows, strict=True)
        mean = [(t - 128 * k) / 128 / k if k else None for t, k in zip(total, n, strict=True)]
        low = [(v - 128) / 128 if k else None for v, k in zip(least, n, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(mean, pa.float64()), pa.array(low, pa.float64())], names=["doc_id", "n", "mean", "low"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row whose pieces may go on in the next batch
        for b in it:
            ids, piece, raw = b.columns
            if not len(ids):
                continue
            at = np.concatenate([[0], np.cumsum(pc.binary_length(raw).to_numpy(zero_copy_only=False), dtype=np.int64)])
            whole = np.frombuffer(raw.buffers()[2], np.uint8) if at[-1] else np.empty(0, np.uint8)
            firsts = np.flatnonzero(piece.to_numpy() == 0).tolist()
            starts = firsts if firsts[:1] == [0] else [0, *firsts]
            keys = ids.take(pa.array(starts, pa.int64())).to_pylist()
            done = []
            for key, i, j in zip(keys, starts, [*starts[1:], len(ids)], strict=True):
                part = whole[at[i] : at[j]]
                n, total, least = len(part), int(part.sum(dtype=np.int64)), int(part.min()) if len(part) else 255
                if i == 0 and firsts[:1] != [0]:
                    last = (last[0], last[1] + n, last[2] + total, min(last[3], least))
                    continue
                if last:
                    done.append(last)
                last = (key, n, total, least)
            if done:
                yield out(done)
        if last:
            yield out([last])

    raw = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("_raw"))
    parts = raw.select("doc_id", "_raw", F.explode(F.expr(f"sequence(0, greatest(octet_length(_raw) - 1, 0) div {PIECE})")).alias("_piece"))
    parts = parts.select("doc_id", "_piece", F.expr(f"substring(_raw, int(_piece) * {PIECE} + 1, {PIECE})").alias("_raw"))
    return parts.mapInArrow(run, "doc_id long, n long, mean double, low double")


def analysis_lpcm(spark: SparkSession, path: str, rate: int, source_rate: int, form: str | None = None, channels: int = 1) -> tuple[DataFrame, DataFrame]:
    """Files to mono at one rate: (signal_id, n, x) with what isn't finite as silence, and a sidecar row for each file."""
    mono = to_mono(read_pcm(spark, path, form, channels))
    out = history.resample_to(mono, source_rate, rate)
    out = out.select("signal_id", "n", F.when(F.isnan("y") | (F.abs("y") == float("inf")), 0.0).otherwise(F.col("y")).cast("float").alias("x"))
    sidecar = out.groupBy("signal_id").agg(F.count("*").alias("frames")).select(
        F.col("signal_id").alias("source"), F.lit(source_rate).alias("source_sample_rate"), F.lit(rate).alias("sample_rate"), F.lit(1).alias("channels"), F.lit("float32").alias("dtype"), "frames", (F.col("frames") / rate).alias("duration_sec")
    )
    return out, sidecar


def to_mono(df: DataFrame) -> DataFrame:
    """Channel mean, with what isn't a number as silence."""
    return df.groupBy("signal_id", "n").agg(F.avg(F.when(F.isnan("x"), 0.0).otherwise(F.col("x"))).alias("x"))


def matrix_columns(df: DataFrame, keys: tuple[str, ...] = ("signal_id", "hop")) -> DataFrame:
    """A row of floats per hop, scalars and arrays end to end in column order."""
    parts = [F.transform(c, lambda v: v.cast("float")) if t.startswith("array") else F.array(F.col(c).cast("float")) for c, t in df.dtypes if c not in keys]
    return df.select(*keys, F.flatten(F.array(*parts)).alias("row"))


def matrix_width(row, sizes: dict[str, int] | None = None, keys: tuple[str, ...] = ("signal_id", "hop")) -> int:
    """How many floats a row of a schema flattens to: one for each number, sizes[name] for each array; anything else is refused."""
    width = 0
    for f in row.fields:
        if f.name in keys:
            continue
        kind = f.dataType.typeName()
        if kind == "array":
            width += (sizes or {})[f.name]
        elif kind in ("double", "float", "integer", "long", "short", "byte"):
            width += 1
        else:
            raise TypeError(f"{f.name} is neither a number nor an array of numbers")
    return width


def write_raw_matrix(df: DataFrame, path: str, sidecar: dict) -> None:
    """One signal's matrix as raw row-major little-endian float32 and a JSON sidecar, to any file system that Spark reaches. Rows come to
    the driver a partition at a time, as a raw file has one writer."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def written(to: str, chunks) -> None:
        target = jvm.org.apache.hadoop.fs.Path(to)
        stream = target.getFileSystem(conf).create(target, True)
        for c in chunks:
            stream.write(bytearray(c))
        stream.close()

    n = 0

    def rows():
        nonlocal n
        for r in matrix_columns(df).orderBy("signal_id", "hop").select("row").toLocalIterator():
            n += 1
            yield np.asarray(r.row, "<f4").tobytes()

    written(path, rows())
    written(f"{path}.json", [json.dumps(sidecar | {"n_frames": n}).encode()])


def write_matrix(df: DataFrame, path: str) -> None:
    """The feature matrix as Parquet, hops in order within a signal."""
    matrix_columns(df).repartition("signal_id").sortWithinPartitions("signal_id", "hop").write.mode("overwrite").parquet(path)


def matrix_bytes(rows: list[list[float]]) -> bytes:
    """Row-major native float32, for small results."""
    return np.asarray(rows, np.float32).tobytes()
