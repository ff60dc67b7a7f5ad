"""Benchmark decontamination by templates.

A text is canonicalised to tokens: words without outer punctuation, A-Z lower-cased, in which numbers (words that begin with a
digit, number words), units after a number, and names (capitalised words inside a sentence, unless all in capitals) are typed
placeholders that remember their value. Windows of WIDTH tokens with LITERALS or more words that aren't placeholders are
hash-joined between documents and items; an item of fewer tokens is one window, and documents have windows of its width as well.
Windows of one item that lie on one diagonal (position in the document minus position in the item) are one alignment; its
slots must be consistent: a value of the item stands for one value of the document and the other way round. Of values that
contradict each other those count that most windows show, and windows with others are dropped. A document is
contaminated by an item if consistent windows cover COVERAGE of the item's windows, and LEAST of them (or all, if it has fewer).

Beside its template, each window has a hash of its tokens as they are, whatever their number of literals and wherever a sentence begins. A
document that templates don't show to be contaminated is so if windows found as they are cover as much of all windows of the
item: verbatim copies of items of numbers and names, or of a single word, are found by them alone.

Windows of documents that can't match are dropped early by a bitmap of the items' hashes, of bounded size however many items
there are. No document is cut, no window count capped. Null and empty texts have no windows. Rows are told apart by
doc_id and text, so that rows with one id, or none, neither hide nor accuse each other; rows equal in both are one. Items
with equal texts are all reported. The result has only contaminated documents; empty tables give an empty one. Other columns
of docs are not read, so their names don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import U64, batches, bitmap_of, buffer_of, flat_windows, in_bitmap, materialize, mix, span_hashes, table, text_key, tuned, word_spans

WIDTH, LITERALS = 5, 3
COVERAGE, LEAST = 0.3, 4
#: Number words and units.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs pound pounds ounce ounces "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "degree degrees percent dollar dollars cent cents euro euros meter meters metre metres kilometer kilometers kilometre kilometres mph kph"
).split()
NUM, UNIT, NAME, EXACT = (U64(k * 0x9E3779B97F4A7C15 % 2**64) for k in (3, 5, 7, 11))
_INK = np.zeros(256, bool)
_INK[48:58] = _INK[65:91] = _INK[97:123] = _INK[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63, 58, 59]] = True


def _hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return np.sort(span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends))


_NUMBERS, _UNITS = _hashes(NUMBERS), _hashes(UNITS)


def canonical(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template code, value hash, tokens of each text): the code of a placeholder is NUM, UNIT or NAME."""
    data, offsets = buffer_of(col)
    start, end, lengths = word_spans(data, offsets)
    if not len(start):
        return np.empty(0, U64), np.empty(0, U64), lengths
    at = np.where(_INK[data], np.arange(len(data)), -1)
    before = np.maximum.accumulate(at)
    after = np.minimum.accumulate(np.where(at < 0, len(data), at)[::-1])[::-1]
    a, b = after[start], before[end - 1] + 1
    keep = (a < end) & (b > a)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    lines = np.cumsum(data == 10)
    begins = np.ones(len(start), bool)
    begins[1:] = _STOP[data[end[:-1] - 1]] | (lines[start[1:]] > lines[end[:-1] - 1]) | (doc[1:] != doc[:-1])
    # a word without letters passes the start of a sentence on
    a, b, begins, doc = a[keep], b[keep], begins[keep], doc[keep]
    lengths = np.bincount(doc, minlength=len(lengths))
    value = span_hashes(data, a, b)
    first, second = data[a], data[np.minimum(a + 1, len(data) - 1)]
    digit = (first >= 48) & (first <= 57)
    number = digit | np.isin(value, _NUMBERS)
    unit = np.zeros(len(a), bool)
    unit[1:] = number[:-1] & np.isin(value[1:], _UNITS) & (doc[1:] == doc[:-1])
    upper = _UPPER[first] | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    name = upper & ~begins & ~(_UPPER[second] & (b - a > 1))
    code = value.copy()
    code[number], code[unit], code[name & ~number] = NUM, UNIT, NAME
    return code, value, lengths


def item_windows(col: pa.Array, widths: list[int] | None = None) -> Iterator[tuple]:
    """(exact, hash, text index, position, start, end, is a placeholder, values) of all windows by exact values and of those
    with enough literals by template: of WIDTH tokens or a shorter text's own, or of each of the widths given."""
    code, value, lengths = canonical(col)
    slot = (code == NUM) | (code == UNIT) | (code == NAME)
    literal = np.append(0, np.cumsum(~slot))
    for width in widths or [WIDTH]:
        for exact in (False, True):
            h, doc, pos = flat_windows(value if exact else code, lengths, width)
            at = (np.cumsum(lengths) - lengths)[doc] + pos
            ends = at + np.minimum(lengths[doc], width)
            ok = literal[ends] - literal[at] >= np.minimum(ends - at, LITERALS)
            if exact:
                h, ok = mix(h ^ EXACT), np.ones(len(h), bool)
            if widths:
                ok &= lengths[doc] >= width
            yield exact, h[ok], doc[ok], pos[ok], at[ok], ends[ok], slot, value


WINDOW = "id long, text_key long, exact boolean, hash long, pos long, width int, slots array<long>"


def windows(it: Iterator[pa.RecordBatch], bitmap: np.ndarray | None = None, widths: list[int] | None = None) -> Iterator[pa.RecordBatch]:
    """Windows of batches (id, text_key, text), those that the bitmap lets pass."""
    for b in batches(it, 100_000, 2, 8_000_000):
        for exact, h, doc, pos, at, ends, slot, value in item_windows(b.column(2), widths):
            if bitmap is not None:
                ok = np.flatnonzero(in_bitmap(bitmap, h.view(np.int64)))
                h, doc, pos, at, ends = h[ok], doc[ok], pos[ok], at[ok], ends[ok]
            signed = value.view(np.int64)
            slots = [signed[i:j][slot[i:j]] for i, j in zip(at, ends, strict=True)]
            columns = (pa.array(np.full(len(h), exact)), pa.array(h.view(np.int64)), pa.array(pos, pa.int64()), pa.array(ends - at, pa.int32()), pa.array(slots, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc)), *columns], names=["id", "text_key", "exact", "hash", "pos", "width", "slots"])


def agreed(windows: list[tuple[int, list[tuple[int, int]]]]) -> tuple[list[int], set[tuple[int, int]]]:
    """Of one alignment's windows (position in the item, pairs of values): the positions of those that agree, and their pairs. Pairs are
    taken by the number of windows that show them, of equals the least; each value is taken once."""
    shown = Counter(pair for _, pairs in windows for pair in set(pairs))
    left, right, taken = set(), set(), set()
    for (i, d), _ in sorted(shown.items(), key=lambda x: (-x[1], x[0])):
        if i not in left and d not in right:
            left.add(i), right.add(d), taken.add((i, d))
    kept = [(at, pairs) for at, pairs in windows if taken.issuperset(pairs)]
    return [at for at, _ in kept], {pair for _, pairs in kept for pair in pairs}


ALIGNED = "doc_id long, text_key long, item_id long, exact boolean, at array<long>, slots long, changed long"


def consistent(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Alignments (keys, windows as lists of (item_pos, i, d)) cut to what agrees. An alignment has at most the item's windows."""
    for b in it:
        out: list[list] = [[], [], []]
        for rows in b.column(4).to_pylist():
            at, pairs = agreed([(r["item_pos"], list(zip(r["i"], r["d"], strict=True))) for r in rows])
            for col, v in zip(out, (at, len(pairs), sum(i != d for i, d in pairs)), strict=True):
                col.append(v)
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out[0], pa.list_(pa.int64())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["doc_id", "text_key", "item_id", "exact", "at", "slots", "changed"])


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, matched, windows, coverage, slots, changed): each contaminated document with each item in it."""
    spark = tuned(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    named = items.select(F.col("item_id").cast("long").alias("id"), F.lit(0).cast("long").alias("text_key"), text)
    asked = materialize(named.mapInArrow(windows, WINDOW), "item-windows")
    total = asked.groupBy(F.col("id").alias("item_id"), "exact").agg(F.count_distinct("pos").alias("windows"))
    widths = sorted({WIDTH, *(r.width for r in asked.select("width").distinct().collect())})  # at most WIDTH numbers
    sent = spark.sparkContext.broadcast(bitmap_of(asked, "hash", asked.count()))  # BITMAP_BITS at most
    rows = docs.select(F.col("doc_id").alias("id"), text_key().alias("text_key"), text)
    found = rows.mapInArrow(lambda it: windows(it, sent.value, widths), WINDOW).select(F.col("id").alias("doc_id"), "text_key", "hash", "pos", "slots")
    asked = asked.select("hash", "exact", F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    hits = found.join(asked, "hash")  # how, the planner decides by the bytes of the items' windows
    # windows found as they are have the item's own values, also where a sentence begins elsewhere
    own = F.when(F.col("exact"), F.col("item_slots")).otherwise(F.col("slots"))
    shown = F.struct("item_pos", F.col("item_slots").alias("i"), own.alias("d"))
    by = ("doc_id", "text_key", "item_id", "exact")
    lines = hits.groupBy(*by, (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(F.collect_set(shown).alias("shown"))
    lines = lines.select(*by, "shown").mapInArrow(consistent, ALIGNED)
    matched = F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("matched")
    out = lines.groupBy(*by).agg(matched, F.max("slots").alias("slots"), F.max("changed").alias("changed")).join(total, ["item_id", "exact"]).withColumn("coverage", F.col("matched") / F.col("windows"))
    out = out.where((F.col("coverage") >= COVERAGE) & (F.col("matched") >= F.least(F.lit(LEAST), "windows")))
    columns = ("matched", "windows", "coverage", "slots", "changed")
    first = F.min(F.struct("exact", *columns)).alias("f")  # false before true: by template if that is enough
    return out.groupBy("doc_id", "text_key", "item_id").agg(first).select("doc_id", "text_key", "item_id", *[f"f.{k}" for k in columns])


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
