"""Toxicity by weak supervision.

1. Lexicons: over all labelled training rows, the documents of either class that hold a word or a prefix of one; what
   is LOG_ODDS likelier in toxic ones, in MIN_DOCS of them or more, is in the lexicon of its kind. Counted by key, so no row is passed
   over, and a lexicon has as many entries as pass. Up to BROADCAST_ENTRIES go to every task; beyond, the features of the
   documents are shuffle-joined with them. Labelled texts are found by a bitmap of the labels' ids, of bounded size, and joined by shuffle.
2. Voters: lexicon and pattern voters say toxic, clean or nothing on every training document, labelled or not; a label is no voter.
   Votes are grouped by pattern, at most 3 ** voters groups whatever the input.
3. A generative label model, fitted by EM on the pattern counts: in each class a voter's vote depends on one other voter's at
   most, by the tree of the pairs with the most mutual information within the classes (above LINKED), so that voters
   that repeat each other don't count twice. The share of toxic documents is that of the labels.
4. A logistic regression on the voters' counts is fitted to the model's posterior labels of at most SAMPLE training
   rows, chosen by hash, labelled or not, and scores every row inside the JVM.

Words are runs of ASCII letters and digits and non-ASCII bytes, A-Z lower-cased. Null and empty texts get the score of
a text in which nothing is found. labels, lang, source and doc_id are no inputs of a score. Without any training label the
built-in lexicon alone speaks. A doc_id with several labels is toxic if any of them is; repeated rows are scored each; null ids
have no label. Empty tables give empty ones. Columns other than those named aren't read, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import U64, as_bytes, batches, bitmap_of, buffer_of, crc_mod, in_bitmap, materialize, mix, span_hashes, table, tuned

#: A small English list of insults, known before any label.
INSULTS = "idiot stupid moron dumb loser scum trash pathetic worthless disgusting".split()
PREFIXES = (4, 5, 6, 7, 8)
LOG_ODDS, MIN_DOCS = 2.0, 5
SAMPLE, LINKED = 20_000, 0.02
BROADCAST_ENTRIES = 500_000
THRESHOLD = 0.3
_INK = np.zeros(256, bool)
_INK[48:58] = _INK[65:91] = _INK[97:123] = _INK[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def spans(col: pa.Array):
    """(bytes, offsets, start, end, document) of all words."""
    data, offsets = buffer_of(col)
    if not len(data):
        return data, offsets, *(np.empty(0, np.int64),) * 3
    ink = _INK[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    some = offsets[:-1] < offsets[1:]
    a, b = offsets[:-1][some], offsets[1:][some] - 1
    first[a], last[b] = ink[a], ink[b]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return data, offsets, start, end, np.searchsorted(offsets, start, "right") - 1


def features(col: pa.Array):
    """(number of documents, kind, key, document) of each word and prefix; kind 0 words, then PREFIXES."""
    data, _, start, end, doc = spans(col)
    out = [(0, span_hashes(data, start, end), doc)]
    for kind, n in enumerate(PREFIXES, 1):
        ok = end - start > n
        out.append((kind, span_hashes(data, start[ok], start[ok] + n) ^ mix(np.full(1, kind, U64)), doc[ok]))
    return out


COUNTED = "kind int, key long, toxic long, clean long"


def class_counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either class by feature, of batches (toxic, text)."""
    for b in batches(it, 100_000, 1, 8_000_000):
        toxic = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        kinds, keys, yes, no = [], [], [], []
        for kind, key, doc in features(b.column(1)):
            _, at = np.unique(key ^ mix(doc.astype(U64)), return_index=True)  # once a document
            key, back = np.unique(key[at], return_inverse=True)
            t = np.bincount(back, toxic[doc[at]], len(key)).astype(np.int64)
            kinds.append(np.full(len(key), kind, np.int32)), keys.append(key.view(np.int64)), yes.append(t), no.append(np.bincount(back, minlength=len(key)) - t)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (kinds, keys, yes, no)], names=["kind", "key", "toxic", "clean"])


def lexicons(labelled: DataFrame) -> dict:
    """Sorted keys and log odds per kind, from rows (toxic, text as bytes); of a large lexicon its table of entries instead."""
    n1, n0 = labelled.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    by = labelled.select("toxic", "text").mapInArrow(class_counts, COUNTED).groupBy("kind", "key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    entries = materialize(by.where(F.col("toxic") >= MIN_DOCS).withColumn("odds", odds).where(F.col("odds") >= LOG_ODDS).select("kind", "key", "odds"), "lexicon")
    out = {kind: (np.empty(0, U64), np.empty(0)) for kind in range(len(PREFIXES) + 1)}
    if entries.count() > BROADCAST_ENTRIES:
        out["entries"] = entries
    else:
        t = entries.toArrow()
        kinds, keys, found = (t.column(k).to_numpy() for k in ("kind", "key", "odds"))
        for kind in out:
            own = keys[kinds == kind].view(U64)
            order = np.argsort(own)
            out[kind] = (own[order], found[kinds == kind][order])
    words = [w.encode() for w in INSULTS]
    ends = np.cumsum([len(w) for w in words])
    seed = span_hashes(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    out["seed"] = (np.sort(seed), np.ones(len(seed)))
    out["prior"] = (n1 + 1) / (n1 + n0 + 2) if n1 + n0 else 0.1
    return out


COUNTS = ("n_words", "words", "strong", "seed", *(f"prefix{n}" for n in PREFIXES), "best", "caps", "marks")


def count_table(col: pa.Array, lex: dict) -> np.ndarray:
    """COUNTS of each text."""
    n = len(col)
    data, offsets, start, end, doc = spans(col)
    out = np.zeros((n, len(COUNTS)))
    out[:, 0] = np.bincount(doc, minlength=n)
    for kind, key, at in features(col):
        for name, (keys, odds) in ((kind, lex[kind]), *((("seed", lex["seed"]),) if kind == 0 else ())):
            if not len(keys) or not len(key):
                continue
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = np.flatnonzero(keys[i] == key)
            k = COUNTS.index("seed") if name == "seed" else 1 if kind == 0 else COUNTS.index(f"prefix{PREFIXES[kind - 1]}")
            out[:, k] += np.bincount(at[hit], minlength=n)
            if name != "seed":
                np.maximum.at(out[:, COUNTS.index("best")], at[hit], odds[i[hit]])
                if kind == 0:
                    strong = hit[odds[i[hit]] >= 2 * LOG_ODDS]
                    out[:, 2] += np.bincount(at[strong], minlength=n)
    if len(data):
        edge = lambda x: np.diff(np.append(0, np.cumsum(x))[offsets])
        out[:, -2], out[:, -1] = edge(_UPPER[data]), edge(data == 33)
    return out


FOUND = "found array<struct<kind: int, key: long, n: long>>"


def found_features(col: pa.Array) -> pa.Array:
    """Of each text: its words and prefixes, and how often each is in it."""
    docs, kinds, keys, n = [], [], [], []
    for kind, key, doc in features(col):
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))) if len(key) else np.empty(0, np.int64)
        docs.append(doc[at]), kinds.append(np.full(len(at), kind, np.int32)), keys.append(key[at].view(np.int64)), n.append(np.diff(np.append(at, len(key))))
    doc = np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    each = pa.StructArray.from_arrays([pa.array(np.concatenate(x)[order]) for x in (kinds, keys, n)], names=["kind", "key", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[order], np.arange(len(col) + 1)), pa.int32()), each)


def joined_counts(text: DataFrame, lex: dict) -> DataFrame:
    """COUNTS of the rows (doc_id, held_out, text), by a shuffle join of their features with the entries of a lexicon of any size."""
    lex, entries = {k: v for k, v in lex.items() if k != "entries"}, lex["entries"]

    def run(it):
        for b in batches(it, 100_000, 2, 8_000_000):
            own = count_table(b.column(2), lex)  # what needs no entries
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(own[:, k]) for k in range(len(COUNTS))), found_features(b.column(2))], names=["doc_id", "held_out", *COUNTS, "found"])

    rows = text.mapInArrow(run, "doc_id long, held_out boolean, " + ", ".join(f"{k} double" for k in COUNTS) + ", " + FOUND)
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "features")
    hits = rows.select("_row", F.explode("found").alias("f")).select("_row", "f.*").join(entries, ["kind", "key"])
    times = lambda x: F.sum(F.when(x, F.col("n")).otherwise(0)).cast("double")
    of = {"words": times(F.col("kind") == 0), "strong": times((F.col("kind") == 0) & (F.col("odds") >= 2 * LOG_ODDS)), "best": F.max("odds")}
    of |= {f"prefix{n}": times(F.col("kind") == kind) for kind, n in enumerate(PREFIXES, 1)}
    by = hits.groupBy("_row").agg(*[v.alias(f"_{k}") for k, v in of.items()])
    return rows.drop("found").join(by, "_row", "left").select("doc_id", "held_out", *[F.coalesce(F.col(f"_{k}"), F.lit(0.0)).alias(k) if k in of else F.col(k) for k in COUNTS])


VOTERS = ("words", "strong", "seed", "dense", *(f"prefix{n}" for n in PREFIXES), "shouting", "marks", "nothing")


def votes(c: dict[str, Column]) -> list[Column]:
    """2 toxic, 1 clean, 0 nothing, in the order of VOTERS."""
    toxic = lambda x: F.when(x, 2).otherwise(0)
    hits = c["words"] + sum((c[f"prefix{n}"] for n in PREFIXES[1:]), F.lit(0.0))
    found = [toxic(c["words"] >= 2), toxic(c["strong"] >= 1), toxic(c["seed"] >= 1), toxic((hits >= 2) & (hits >= 0.02 * c["n_words"]))]
    found += [toxic(c[f"prefix{n}"] >= (3 if n == PREFIXES[0] else 2)) for n in PREFIXES]
    found += [toxic(c["caps"] >= 2 * c["n_words"]), toxic(c["marks"] >= 0.3 * F.greatest(c["n_words"], F.lit(1.0))), F.when(hits == 0, 1).otherwise(0)]
    return found


def spanning_tree(joint: np.ndarray, size: np.ndarray) -> list[int]:
    """The parent of each voter (-1: none) in the forest of pairs with the most mutual information given the class: joint is
    classes x voters x voters x votes x votes, size the classes' weights."""
    v = joint.shape[1]
    marginal = np.einsum("ciikk->cik", joint)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = joint * np.log(joint / (marginal[:, :, None, :, None] * marginal[:, None, :, None, :]))
    info = np.einsum("c,cij->ij", size / size.sum(), np.nan_to_num(gain).sum(axis=(3, 4)))
    parent, reach, best, left = [-1] * v, np.full(v, -1), np.full(v, -np.inf), set(range(v))
    while left:
        k = max(sorted(left), key=lambda i: best[i])
        left.discard(k)
        if best[k] > LINKED:
            parent[k] = int(reach[k])
        for j in left:
            if info[k, j] > best[j]:
                best[j], reach[j] = info[k, j], k
    return parent


def label_model(patterns: np.ndarray, n: np.ndarray, prior: float, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """EM on vote patterns (rows of 0, 1, 2) seen n times. Returns (posterior of each pattern, P(vote | class) as voters x 3
    x 2, the parent of each voter in the tree of dependences). The tree is sought anew every ten rounds; votes are
    smoothed by half an observation, dependences by five towards independence."""
    v = patterns.shape[1]
    one = np.eye(3)[patterns]  # patterns x voters x votes
    start = (patterns == 2).sum(1) - (patterns == 1).sum(1)
    q = np.where(start > 0, 0.9, 0.02)
    parent = [-1] * v
    for turn in range(rounds):
        weights = np.stack([n * (1 - q), n * q])
        size = weights.sum(axis=1)
        theta = (np.einsum("cp,pvk->cvk", weights, one) + 0.5) / (size + 1.5)[:, None, None]
        joint = np.stack([np.einsum("p,pik,pjl->ijkl", w, one, one, optimize=True) for w in weights])
        if turn and turn % 10 == 0:
            parent = spanning_tree(joint / np.maximum(size, 1e-9)[:, None, None, None, None], size)
        log = np.zeros((2, len(patterns)))
        for j in range(v):
            if parent[j] < 0:
                log += np.log(theta[:, j, patterns[:, j]])
            else:
                pair = joint[:, parent[j], j]  # classes x the parent's vote x own vote
                given = (pair + 5 * theta[:, j, None, :]) / (pair.sum(axis=2, keepdims=True) + 5)
                log += np.log(given[:, patterns[:, parent[j]], patterns[:, j]])
        q = 1 / (1 + np.exp(-np.clip(log[1] - log[0] + np.log(prior / (1 - prior)), -30, 30)))
    return q, theta.transpose(1, 2, 0), parent


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression on soft labels by Newton's method; the first column of x is the constant."""
    w = np.zeros(x.shape[1])
    ridge = l2 * len(x) * np.eye(x.shape[1]) + 1e-6 * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def inputs(c: dict[str, Column]) -> list[Column]:
    """The linear classifier's features."""
    size = F.greatest(c["n_words"], F.lit(1.0))
    hit = lambda k: F.least(c[k], F.lit(4.0)) / 4
    out = [F.lit(1.0)]
    for k in ("words", "strong", "seed", *(f"prefix{n}" for n in PREFIXES)):
        out += [hit(k), F.when(c[k] >= 2, 1.0).otherwise(0.0), F.least(F.lit(1.0), 10 * c[k] / size)]
    return [*out, c["best"] / 8, F.least(F.lit(1.0), c["caps"] / size / 4), F.least(F.lit(1.0), c["marks"] / size), F.log1p(size) / 10]


def toxicity(docs: DataFrame, labels: DataFrame, train: Column) -> tuple[DataFrame, dict]:
    """docs (doc_id, text) with held_out (not train), score and predicted; and what was learned."""
    tuned(docs.sparkSession)
    named = docs.select("doc_id", (~train).alias("held_out"), "text")
    gold = labels.where("toxic is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    gold = materialize(gold.where("label_id is not null"), "gold")
    sent = docs.sparkSession.sparkContext.broadcast(bitmap_of(gold.select(F.xxhash64("label_id").alias("h")), "h", gold.count()))  # BITMAP_BITS at most

    def maybe(it):
        for b in it:
            yield b.filter(pa.array(in_bitmap(sent.value, b.column(0).to_numpy()))).select([1, 2])

    text = as_bytes(named.where(~F.col("held_out")).select(F.xxhash64("doc_id").alias("h"), "doc_id", "text"), "h", "doc_id")
    some = text.mapInArrow(maybe, "doc_id long, text binary")
    # the same plan at every size: labelled texts and labels are dealt by id
    labelled = some.join(gold.hint("merge"), F.col("doc_id") == F.col("label_id")).select("toxic", "text")
    lex = lexicons(labelled)

    def run(it):
        for b in batches(it, 100_000, 2, 8_000_000):
            found = count_table(b.column(2), lex)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(found[:, k]) for k in range(len(COUNTS)))], names=["doc_id", "held_out", *COUNTS])

    text = as_bytes(named, "doc_id", "held_out")
    counts = joined_counts(text, lex) if "entries" in lex else text.mapInArrow(run, "doc_id long, held_out boolean, " + ", ".join(f"{k} double" for k in COUNTS))
    counts = materialize(counts, "counts")
    c = {k: F.col(k) for k in COUNTS}
    known = counts.where(~F.col("held_out"))
    vote = F.array(*votes(c))
    by = known.groupBy(vote.alias("v")).count().collect()  # 3 ** voters rows at most
    weights = np.zeros(len(inputs(c)))
    learned = {"lexicon": lex, "patterns": len(by)}
    if by:
        patterns, n = np.array([r.v for r in by]), np.array([r["count"] for r in by], float)
        q, theta, parent = label_model(patterns, n, lex["prior"])
        learned |= {"theta": theta, "parents": parent}
        posterior = {tuple(p): float(x) for p, x in zip(patterns.tolist(), q, strict=True)}
        rows = known.orderBy(F.xxhash64(F.lit(4), "doc_id", *COUNTS), *COUNTS).limit(SAMPLE).select(vote.alias("v"), F.array(*inputs(c)).alias("x")).collect()
        weights = logistic(np.array([r.x for r in rows]), np.array([posterior[tuple(r.v)] for r in rows]))
    learned["weights"] = weights
    z = sum((F.lit(float(w)) * x for w, x in zip(weights, inputs(c), strict=True)), F.lit(0.0))
    score = 1 / (1 + F.exp(-z))
    return counts.select("doc_id", "held_out", score.alias("score"), F.when(score >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted")), learned


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity(docs, labels.select("doc_id", "toxic"), crc_mod("doc_id", 4) != 2)[0]
