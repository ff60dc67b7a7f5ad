"""Language ID with a linear-chain conditional random field over words.

A sequence is a run of words up to one that ends a sentence (. ! ?) or a line's end, however long: sequences are computed in
pieces of at most PIECE words, whose messages are handed over exactly. A word's features are its prefixes and suffixes, its
inner byte n-grams, whether it is all letters, and the word itself (the lexicon), hashed to SLOTS slots; each has a weight
per language, and each ordered pair of languages a transition weight. Weights maximise the penalised likelihood (Adam
over the whole sample, gradients by forward-backward). Every word starts with its document's language as its label; after
half of the epochs words that the model holds to be of another language with SURE or more are relabelled, so that
code-switched passages teach switching and not noise.

The fit uses a bounded sample of training rows: at most DOCS texts of at most SAMPLE_BYTES bytes, equally many of each of at
most LANGS languages (the most frequent ones, ties by name), chosen by hash of id and text. A document's language is the one
with the largest sum of the posteriors of its words with a letter (of equals the first by name); score is that sum over
their number. Texts that are null or have no letter are `und` with score 0. Without any training row all are `und`. Rows that
repeat are predicted each, and equally; empty tables give empty ones. Columns other than those named aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.llm.common import U64, batches, buffer_of, crc_mod, mix, span_hashes, table, tuned, word_spans

PIECE, SLOTS = 48, 1 << 17
DOCS, SAMPLE_BYTES, LANGS = 1200, 1 << 16, 256
EPOCHS, RATE, L2, SURE = 24, 0.15, 1e-4, 0.9
AFFIXES, GRAMS = (1, 2, 3, 4), (2, 3)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True


def parsed(col: pa.Array):
    """(bytes, start, end, words of each document, piece number of each word, which pieces go on with the sequence before)."""
    data, offsets = buffer_of(col)
    start, end, lengths = word_spans(data, offsets)
    n = len(start)
    if n == 0:
        return data, start, end, lengths, np.empty(0, np.int64), np.empty(0, bool)
    lines = np.cumsum(data == 10)
    cut = np.zeros(n, bool)
    cut[1:] = _STOP[data[end[:-1] - 1]] | (lines[start[1:]] > lines[end[:-1] - 1])
    cut[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    cut[0] = True
    first = np.flatnonzero(cut)
    pos = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    begins = cut | (pos % PIECE == 0)
    return data, start, end, lengths, np.cumsum(begins) - 1, ~cut[begins]


def word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, slot) of all features of the words."""
    n, size = len(start), end - start
    words, keys = [np.arange(n)], [span_hashes(data, start, end)]

    def add(ok, a, b, kind):
        words.append(ok)
        keys.append(span_hashes(data, a, b) ^ mix(np.full(1, kind, U64)))

    for k in AFFIXES:
        ok = np.flatnonzero(size >= k)
        add(ok, start[ok], start[ok] + k, 10 + k)
        add(ok, end[ok] - k, end[ok], 20 + k)
    for k in GRAMS:
        m = np.maximum(size - k + 1, 0)
        ok = np.repeat(np.arange(n), m)
        at = np.arange(len(ok)) - np.repeat(np.cumsum(m) - m, m) + start[ok]
        add(ok, at, at + k, 30 + k)
    return np.concatenate(words), (np.concatenate(keys) % U64(SLOTS)).astype(np.int64)


def distinct(data, start, end):
    """(features of the distinct words, number of each word)."""
    _, at, back = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
    return word_features(data, start[at], end[at]), len(at), back


def emissions(feats, n: int, weights: np.ndarray) -> np.ndarray:
    word, slot = feats
    return np.stack([np.bincount(word, weights[slot, k], n) for k in range(weights.shape[1])], axis=1)


def handed_over(x: np.ndarray, m: np.ndarray, first: np.ndarray, size: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What comes to each piece from the left (a factor of its first word) and from the right (of its last word), exactly: each piece's
    transfer matrix, then a pass over the pieces of all sequences, the k-th ones together."""
    k = x.shape[1]
    left, right = np.ones((len(first), k)), np.ones((len(first), k))
    head = np.maximum.accumulate(np.where(linked, 0, np.arange(len(first))))
    turn = np.arange(len(first)) - head
    some = np.flatnonzero(linked | np.append(linked[1:], False))
    if not len(some):
        return left, right
    t = np.where(linked[some, None, None], m[None], np.eye(k)[None]) * x[first[some]][:, None, :]
    for j in range(1, int(size[some].max())):
        at = np.flatnonzero(size[some] > j)
        t[at] = (t[at] @ m) * x[first[some[at]] + j][:, None, :]
        t[at] /= t[at].sum(axis=(1, 2), keepdims=True)
    where = np.full(len(first), -1)
    where[some] = np.arange(len(some))
    out, back = np.ones((len(first), k)), np.ones((len(first) + 1, k))
    by_turn = [some[turn[some] == j] for j in range(int(turn[some].max()) + 1)]
    for j, at in enumerate(by_turn):
        v = np.ones((len(at), k)) if j == 0 else out[at - 1]
        v = np.einsum("pi,pij->pj", v, t[where[at]])
        out[at] = v / v.sum(axis=1, keepdims=True)
        if j:
            left[at] = out[at - 1] @ m
    goes_on = np.append(linked[1:], False)
    for at in reversed(by_turn[1:]):
        v = np.einsum("pij,pj->pi", t[where[at]], np.where(goes_on[at, None], back[at + 1], 1.0))
        back[at] = v / v.sum(axis=1, keepdims=True)
    right[goes_on] = back[np.flatnonzero(goes_on) + 1]
    return left, right


def forward_backward(e: np.ndarray, seq: np.ndarray, trans: np.ndarray, linked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each word's label, expected transitions) of all pieces at once, step by step; e is words x labels, seq the
    rising piece number of each word, linked which pieces go on with the one before."""
    n, k = e.shape
    if n == 0:
        return np.empty((0, k)), np.zeros((k, k))
    first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
    size = np.diff(np.append(first, n))
    x = np.exp(e - e.max(axis=1, keepdims=True))
    m = np.exp(trans)
    linked = np.zeros(len(first), bool) if linked is None else linked
    left, right = handed_over(x, m, first, size, linked)
    begun = first[linked]
    order = np.argsort(-size, kind="stable")
    first, size, left, right = first[order], size[order], left[order], right[order]
    steps = int(size[0])
    live = [int(np.searchsorted(-size, -t, "left")) for t in range(steps)]  # pieces longer than t
    alpha, beta, expected = np.empty((n, k)), np.empty((n, k)), np.zeros((k, k))
    for t in range(steps):
        at = first[: live[t]] + t
        a = x[at] * left if t == 0 else (alpha[at - 1] @ m) * x[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(steps - 1, -1, -1):
        now, more = first[: live[t]] + t, live[t + 1] if t + 1 < steps else 0
        b = right[: live[t]].copy()
        if more:
            nxt = now[:more] + 1
            after = x[nxt] * beta[nxt]
            b[:more] = after @ m.T
            pair = alpha[now[:more], :, None] * m[None] * after[:, None, :]
            expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[now] = b / b.sum(axis=1, keepdims=True)
    if len(begun):
        pair = alpha[begun - 1, :, None] * m[None] * (x[begun] * beta[begun])[:, None, :]
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    post = alpha * beta
    return post / post.sum(axis=1, keepdims=True), expected


def fit(texts: list[bytes], langs: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights: SLOTS x languages, transitions)."""
    data, start, end, lengths, seq, linked = parsed(pa.array(texts, pa.binary()))
    (word, slot), n, back = distinct(data, start, end)
    # only slots that occur are kept while fitting
    used, slot = np.unique(slot, return_inverse=True)
    feats = (word, slot)
    label = np.repeat(np.array(langs), lengths)
    inner = np.flatnonzero((seq[1:] == seq[:-1]) | linked[seq[1:]]) if len(seq) else np.empty(0, np.int64)
    w, trans = np.zeros((len(used), k)), np.zeros((k, k))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]
    total = max(1, len(label))
    for epoch in range(1, EPOCHS + 1):
        post, expected = forward_backward(emissions(feats, n, w)[back], seq, trans, linked)
        if epoch == EPOCHS // 2 + 1:
            best = post.argmax(axis=1)
            label = np.where(post.max(axis=1) >= SURE, best, label)
        gold = np.zeros((k, k))
        np.add.at(gold, (label[inner], label[inner + 1]), 1)
        gap = np.stack([np.bincount(back, (label == j) - post[:, j], n) for j in range(k)], axis=1)
        grad = np.stack([np.bincount(slot, gap[word, j], len(used)) for j in range(k)], axis=1) / total - L2 * w
        grad_t = (gold - expected) / total - L2 * trans
        for x, g, m1, m2 in ((w, grad, state[0], state[1]), (trans, grad_t, state[2], state[3])):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            x += RATE * (m1 / (1 - 0.9**epoch)) / (np.sqrt(m2 / (1 - 0.99**epoch)) + 1e-8)
    full = np.zeros((SLOTS, k))
    full[used] = w
    return full, trans


def learn(docs: DataFrame, train: Column, text: str = "text") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, weights, transitions) from a bounded sample of the rows that train."""
    body = F.col(text).cast("binary")
    rows = docs.where(train & F.col("lang").isNotNull() & F.col(text).isNotNull() & (F.octet_length(body) <= SAMPLE_BYTES))
    seen = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()}
    langs = sorted(seen)
    if not langs:
        return [], np.zeros((SLOTS, 0)), np.zeros((0, 0))
    need = max(1, DOCS // len(langs))
    # about three times as many as are needed by hash, and of those the first: no language's rows are sorted in one task
    share = F.create_map(*[x for k, n in seen.items() for x in (F.lit(k), F.lit(min(1.0, (3 * need + 20) / n)))])
    h = F.xxhash64(F.lit(7), "doc_id", body)
    chosen = rows.select("doc_id", "lang", h.alias("h"), body.alias("text")).where(F.pmod("h", F.lit(1 << 32)) / float(1 << 32) < share[F.col("lang")])
    turn = Window.partitionBy("lang").orderBy("h", "doc_id")
    sample = chosen.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= need).orderBy("h", "doc_id").collect()  # DOCS texts of SAMPLE_BYTES
    return langs, *fit([bytes(r.text) for r in sample], [langs.index(r.lang) for r in sample], len(langs))


def labelled(col: pa.Array, model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each word, words of each document, whether a word has a letter)."""
    _, weights, trans = model
    data, start, end, lengths, seq, linked = parsed(col)
    if not len(start):
        return np.empty((0, weights.shape[1])), lengths, np.empty(0, bool)
    feats, n, back = distinct(data, start, end)
    post, _ = forward_backward(emissions(feats, n, weights)[back], seq, trans, linked)
    ink = np.append(0, np.cumsum(_LETTER[data]))
    return post, lengths, ink[end] > ink[start]


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, model) -> DataFrame:
    """Language and score of every row of docs (doc_id, held_out, text)."""
    langs = model[0]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x languages numbers, whatever the input
    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 100_000, 3, 4_000_000):
            n, has = b.num_rows, b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            pred, score = np.full(n, "und", object), np.zeros(n)
            if langs:
                post, lengths, ink = labelled(b.column(3), sent.value)
                doc = np.repeat(np.arange(n), lengths)[ink]
                sums = np.stack([np.bincount(doc, post[ink, k], n) for k in range(len(langs))], axis=1)
                words = np.bincount(doc, minlength=n)
                ok = has & (words > 0)
                pred[ok] = np.array(langs, object)[sums[ok].argmax(axis=1)]
                score[ok] = np.minimum(1.0, sums[ok].max(axis=1) / words[ok])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", letters, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).mapInArrow(run, PREDICTED)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs, crc_mod("doc_id", 3) != 1)
    return predict(docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "text"), model)
