"""The pipeline, stage after stage, against brute force on the smallest documents."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rillflow.llm import op06_quality as op6

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def words(t):
    return [w.decode() for w in (t or "").encode().split()]


def quality(t):
    w = words(t)
    at = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {p for i in range(len(w) - 4) if at[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if x.strip()]
    m = {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t or ""), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_stop_words": sum(x.lower() in op6.STOP_WORDS for x in w), "n_capital_words": sum(x.upper() == x != x.lower() for x in w), "longest_word": max(map(len, w), default=0), "one": 1,
    }
    ok = all(len(w) < r.min_words or ((r.low is None or m[r.numerator] >= m[r.denominator] * r.low) and (r.high is None or m[r.numerator] <= m[r.denominator] * r.high)) for r in op6.TABLE)
    return len(w) >= 10 and 100 * len(hit) <= 20 * len(w) and ok


def survivors(docs):
    bags = {}
    for i, (t, _) in docs.items():
        w = (t or "").encode().lower().split()
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    holders = {}
    for i, b in bags.items():
        for s in b:
            holders.setdefault(s, []).append(i)
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(a, b) for own in holders.values() for a in own for b in own if a < b}:
        both = sum((bags[a] & bags[b]).values())
        if both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: docs[i] for i in docs if find(i) == i}


def copies(docs):
    size = {i: len(words(t)) for i, (t, _) in docs.items()}
    by = Counter()
    for i, (_, s) in docs.items():
        by[s] += size[i]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free, target = sum(by.values()), set(by), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * by[s]}
        target |= {s: 3 * by[s] if full else level * weight[s] for s in full or free}
        left -= sum(3 * by[s] for s in full)
        free -= full or free
    out = Counter()
    for s in by:
        at, goal = 0, math.floor(target[s])
        place = lambda i: hashlib.md5(f"20240607:{i}:{hashlib.md5((docs[i][0] or '').encode()).hexdigest()}".encode()).hexdigest()
        for i in sorted((i for i in docs if docs[i][1] == s), key=lambda i: (place(i), i)):
            taken = goal // by[s] * size[i] + max(0, min(at + size[i], goal % by[s]) - at)
            at += size[i]
            out[i] = -(-taken // size[i])
    return +out


def test_stages_against_brute_force(spark, sf):
    docs = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {i: d for i, d in docs.items() if quality(d[0])}
    kept = survivors(kept)
    kept = {i: d for i, d in kept.items() if not any(x in " ".join(words(d[0])) for x in items)}
    want = copies(kept)
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in got) == want
    per = Counter(r.shard for r in got)
    assert max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(per[s]))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]


def test_rows_that_share_an_id(spark, sf):
    """Which rows stay is decided by row, not by id."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key int, _id int, _copies int"
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "ABCD"}
    docs = lambda *rows: spark.createDataFrame([(i, text.get(t, t), "en", "a", 1, 77, 78, 79) for i, t in rows], schema)
    rows = lambda df: Counter((r.doc_id, next((k for k, v in text.items() if v == r.text), r.text)) for r in df.collect())
    dedup = lambda *r: rows(corpus_pipeline.near_dedup(spark, docs(*r), sf))
    assert dedup((3, "B"), (8, "A"), (8, "B")) == {(3, "B"): 1, (8, "A"): 1}
    assert dedup((5, "B"), (None, "A"), (None, "B")) == {(None, "B"): 1, (None, "A"): 1}
    near = text["A"].replace("A29", "x")
    assert sum(dedup((8, "A"), (8, near), (8, "A"), (9, "C")).values()) == 2
    assert dedup((1, ""), (1, ""), (1, None), (2, " \n")) == {(1, ""): 2, (1, None): 1, (2, " \n"): 1}
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    clean = lambda *r: rows(corpus_pipeline.decontamination(spark, docs(*r), sf))
    assert clean((None, item), (None, "A"), (6, item), (6, "B"), (5, "C"), (None, None)) == {(None, "A"): 1, (6, "B"): 1, (5, "C"): 1, (None, None): 1}
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.decontamination, corpus_pipeline.mixing):
        out = stage(spark, docs((1, "A"), (1, "B"), (None, "C"), (None, "D")), sf)
        assert all((r._key, r._id, r._copies) == (77, 78, 79) for r in out.collect()) and out.count() == 4
    mixed = rows(corpus_pipeline.mixing(spark, docs(*[(1, "A")] * 3, (1, "B"), (None, "C")), sf))
    assert mixed == {(1, "A"): 3, (1, "B"): 1, (None, "C"): 1}


def test_stages_on_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    prose = "the quick brown fox jumps over the lazy dog and runs to the river for a drink of water"
    docs = spark.createDataFrame([(1, prose, "en", "a", 1), (1, prose, "en", "a", 1), (None, prose + " again and again today", None, None, None), (2, None, None, None, None), (3, "", "en", "a", 0)], schema)
    for rows in (docs, docs.limit(0)):
        now = rows
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, sf)
            if name != "sharding":
                assert now.columns == docs.columns
        assert now.count() >= (1 if rows is docs else 0)
        assert now.where(F.col("slot") < 0).count() == 0
