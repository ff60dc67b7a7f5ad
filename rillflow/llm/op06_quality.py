"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

measures() adds the counts to each row, TABLE names the ratios and the range in which each passes, compiled() turns a
table into one Column. All stay inside the JVM; no shuffle is needed, and each row is judged on its whole text.

Null texts count as empty: no word, hence base_failed and not kept. Other columns of docs pass through; the counts
are kept in one struct column, so that no name can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import table

#: White space, symbols, and common words of English, French, German and Spanish.
SPACE = " \t\n\x0b\f\r"
SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
STOP_WORDS = (
    "the of and to in is was for that it on are with this be a by "
    "le la les des du de et un une en est que qui dans pour pas sur "
    "der die das und ist ein eine zu von mit den im nicht sich auf "
    "el los las y del se por con para una no es lo al como"
).split()
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A ratio numerator / denominator that must lie in [low, high] once the text has min_words words."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The threshold table. Bounds are wide: a text fails only by what prose of any language hardly shows.
TABLE = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.25),
    Rule("longest_word", "longest_word", "one", None, 200.0),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.4),
    Rule("stop_words", "n_stop_words", "n_words", 0.01, None, 100),
    Rule("capital_words", "n_capital_words", "n_words", None, 0.6, 20),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_capital_words", "longest_word")


def measures(docs: DataFrame, text: str = "text", into: str = "measures") -> DataFrame:
    """docs with a struct column of COUNTS (all long).

    n_repeat_words: words covered by a WINDOW-word window that occurs twice or more in the text. Windows are told
    apart by a 64-bit hash of their words' hashes. Only texts that repeat a window sort their windows."""
    names = set(docs.columns)
    tmp = {k: next(n for i in range(99) if (n := f"_{k}{i or ''}") not in names) for k in ("t", "w", "h", "g", "r", "l")}
    t, w, h, g, r, lines = (F.col(f"`{tmp[k]}`") for k in ("t", "w", "h", "g", "r", "l"))
    out = docs.withColumn(tmp["t"], F.coalesce(F.col(f"`{text}`"), F.lit("")))
    trimmed = F.trim(t, F.lit(SPACE))
    out = out.withColumn(tmp["w"], F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES)))
    out = out.withColumn(tmp["h"], F.transform(w, lambda x: F.xxhash64(x)))
    n = F.size(w)
    # h is named five times, so the optimizer keeps it as a column of its own below this one
    ranks = F.when(F.size(h) >= WINDOW, F.sequence(F.lit(0), F.size(h) - WINDOW)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn(tmp["g"], F.transform(ranks, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
    pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    out = out.withColumn(tmp["r"], F.when(F.size(F.array_distinct(g)) < F.size(g), pairs))
    same = lambda x, i, k: F.coalesce(F.get(r, i + k)["x"] == x["x"], F.lit(False))
    at = F.sort_array(F.transform(F.filter(r, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"]))
    covered = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(acc["to"], i)).alias("n"), (i + WINDOW).alias("to")), lambda acc: acc["n"])
    out = out.withColumn(tmp["l"], F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != ""))
    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(r.isNull(), F.lit(0)).otherwise(covered),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))),
        "n_capital_words": F.size(F.filter(w, lambda x: (F.upper(x) == x) & (F.lower(x) != x))),
        "longest_word": F.coalesce(F.array_max(F.transform(w, lambda x: F.length(x))), F.lit(0)),
    }
    struct = F.struct(*[counts[k].cast("long").alias(k) for k in COUNTS])
    return out.withColumn(into, struct).drop(*tmp.values())


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def compiled(rules=TABLE, m: Column | None = None) -> Column:
    """True where every rule of the table passes. Ratios are compared as products, so nothing is divided by zero."""
    m = F.col("measures") if m is None else m
    verdict = F.lit(True)
    for rule in rules:
        top, bottom = (F.lit(1.0) if k == "one" else m[k].cast("double") for k in (rule.numerator, rule.denominator))
        ok = F.lit(True)
        if rule.low is not None:
            ok = ok & (top >= bottom * rule.low)
        if rule.high is not None:
            ok = ok & (top <= bottom * rule.high)
        verdict = verdict & ((m["n_words"] < rule.min_words) | ok)
    return verdict


def judged(docs: DataFrame, rules=TABLE, into: str = "quality") -> DataFrame:
    """docs with a struct column of the counts, base_failed and kept."""
    m = measures(docs, into=into)
    q = F.col(f"`{into}`")
    failed = base_failed(q)
    return m.withColumn(into, F.struct(*[q[k].alias(k) for k in COUNTS], failed.alias("base_failed"), (~failed & compiled(rules, q)).alias("kept")))


def passing(docs: DataFrame, rules=TABLE) -> DataFrame:
    """The rows of docs that are kept. The row number, which is never negative, keeps the optimizer from pushing the filter
    into the projections below, where each count would be computed anew for every use."""
    names = set(docs.columns)
    q, k, r = (next(n for i in range(99) if (n := f"_{x}{i or ''}") not in names) for x in ("quality", "kept", "row"))
    judgement = judged(docs, rules, q)
    marked = judgement.select(*[f"`{c}`" for c in docs.columns], F.col(f"{q}.kept").alias(k), F.monotonically_increasing_id().alias(r))
    return marked.where(F.col(k) & (F.col(r) >= 0)).select(*[f"`{c}`" for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    q = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", *[F.col(f"quality.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_RULES = " AND ".join(
    f"(n_words < {r.min_words} OR ({' AND '.join(f'{a} {op} {b} * CAST({x} AS DOUBLE)' for op, x in (('>=', r.low), ('<=', r.high)) if x is not None for a, b in [(f'CAST({r.numerator} AS DOUBLE)', '1.0' if r.denominator == 'one' else r.denominator)])}))"
    for r in TABLE
)
ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
        list_transform(range(0, greatest(len(w) - {WINDOW - 1}, 0)), lambda i: array_to_string(w[i + 1 : i + {WINDOW}], ' ')) AS g FROM t),
k AS (SELECT row_number() OVER () AS row_id, * FROM l),
f AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, x) AS n FROM (
        SELECT row_id, unnest(g) AS x, unnest(range(0, len(g))) AS i FROM k WHERE len(list_distinct(g)) < len(g))),
s AS (SELECT row_id, sum(least({WINDOW}, coalesce(i - before, {WINDOW}))) AS n_repeat_words FROM (
        SELECT row_id, i, lag(i) OVER (PARTITION BY row_id ORDER BY i) AS before FROM f WHERE n > 1) GROUP BY row_id),
r AS (SELECT k.*, coalesce(s.n_repeat_words, 0) AS n_repeat_words FROM k LEFT JOIN s USING (row_id)),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
        CAST(len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS BIGINT) AS n_stop_words,
        CAST(len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x)) AS BIGINT) AS n_capital_words,
        CAST(coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS longest_word FROM r),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {_RULES}) AS kept FROM b
"""
