"""LM scoring with an Elias-Fano n-gram trie.

Tokens: words (runs of anything but ASCII white space, A-Z lower-cased) and one end per document. Three levels:

1. words: the rising 64-bit word hashes in Elias-Fano form, and exact counts (a byte each, large ones apart);
2. pairs: (word, successor's number) as one rising sequence; monotone pointers to each word's first successor; the
   discounted share a = (count - D) / context count and the word's back-off weight, a byte each in logarithmic steps;
3. triples: the third word is numbered by its rank among the successors of the second (context-relative), so the
   sequence stays dense; a quantised share, and the pair's back-off weight.

p1 = (c + 0.1) / (N + 0.1 (V + 1)), p(w | h) = a(h w) + backoff(h) p(w | shorter h); what discounting takes goes to the
back-off weight, so probabilities add up to one but for the steps of quantisation. All pairs and triples are kept, however rare.

Each level is counted by one pass over the training texts. Tasks count what they read and deal it by ranges of the
level's order to shards, as steps between rising keys; a shard is merged and coded in one task. Shards follow the
corpus (SHARD_BYTES of text each). A word or pair that has more occurrences than half a shard is cut into ranges of its
successors, so no task has all that follows "the"; its weight and first position are put together from its pieces, few numbers a
piece. A task writes its shard to the shared folder, from where tasks memory-map just the shards that they ask for; the driver sees
sizes and the pieces' numbers alone. Where the shared folder is no file system of the machines (an object store), shards
are handed out by Spark, each executor then holding copies of all of them.

Null texts are empty: only an end. Rows are scored each by its own; rows that repeat train each; ties don't matter. Very
long texts are one batch. With no training row N = V = 0 and every word has probability 1; an empty table gives an empty
one. Only doc_id, held_out and text are read, so other columns' names don't matter.
"""

from __future__ import annotations

import json
import math
import mmap
import os
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm import eliasfano as ef
from rillflow.llm.common import U64, as_bytes, batches, buffer_of, crc_mod, forget, fresh_path, span_hashes, table, trim, tuned, word_spans

ADD, DISCOUNT = 0.1, 0.75
#: Bytes of text a shard stands for.
SHARD_BYTES = 32 << 20
#: Tokens a task counts before it passes them on.
PENDING = 1_500_000
END = U64(0x6A09E667F3BCC909)
#: Shares and weights are kept as x = round(-log10(value) / STEP), at most 255 (zero).
STEP = 1 / 32
BATCH_BYTES = 4_000_000
SHARDED = "shard int, run binary"


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, tokens per document) with the end of each document."""
    data, offsets = buffer_of(col)
    start, end, lengths = word_spans(data, offsets)
    h = span_hashes(data, start, end)
    h[h == END] ^= U64(1)
    return np.insert(h, np.cumsum(lengths), END), lengths + 1


def quantised(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.minimum(254, np.rint(-np.log10(np.maximum(x, 1e-12)) / STEP)), 255).astype(np.uint8)


VALUE = np.append(10.0 ** (-STEP * np.arange(255)), 0.0)


def counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, their numbers)."""
    if n is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(n, at, dtype=np.int64) if len(at) else np.empty(0, np.int64)


def packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Rising keys and their numbers: the first key, steps by planes of bytes (as many as the largest needs), numbers of a byte, large
    ones apart. Planes of equal bytes are what the exchange's compression takes out."""
    steps, large = np.diff(keys), n[n >= 255].astype(np.uint32)
    planes = (int(steps.max(initial=0)).bit_length() + 7) // 8
    body = steps.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()
    return struct.pack("<QIIB", int(keys[0]), len(keys), len(large), planes) + body + np.minimum(n, 255).astype(np.uint8).tobytes() + large.tobytes()


HEAD = struct.calcsize("<QIIB")


def unpacked(raw) -> tuple[np.ndarray, np.ndarray]:
    first, size, large, planes = struct.unpack_from("<QIIB", raw)
    steps = np.zeros((size - 1, 8), np.uint8)
    steps[:, :planes] = np.frombuffer(raw, np.uint8, planes * (size - 1), HEAD).reshape(planes, size - 1).T
    keys = np.empty(size, U64)
    keys[0], keys[1:] = first, steps.view(U64)[:, 0]
    at = HEAD + planes * (size - 1)
    n = np.frombuffer(raw, np.uint8, size, at).astype(np.int64)
    n[n == 255] = np.frombuffer(raw, np.uint8, 4 * large, at + size).view(np.uint32)
    return np.cumsum(keys, dtype=U64), n


def dealt(it: Iterator[pa.RecordBatch], grams, shard_of, text: int = 0) -> Iterator[pa.RecordBatch]:
    """Counts grams(binary column) -> uint64 keys over the texts and yields a run of each shard's keys, whose order shards follow."""
    pending: list[np.ndarray] = []

    def passed():
        keys, n = counted(np.concatenate(pending))
        shard = shard_of(keys)
        at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
        ends = np.append(at[1:], len(shard)) if len(shard) else []
        return pa.RecordBatch.from_arrays([pa.array(shard[at].astype(np.int32) if len(shard) else [], pa.int32()), pa.array([packed(keys[a:b], n[a:b]) for a, b in zip(at, ends)], pa.binary())], names=["shard", "run"])

    for b in batches(it, 100_000, text, BATCH_BYTES):
        pending.append(grams(b.column(text)))
        if sum(map(len, pending)) >= PENDING:
            yield passed()
            pending = []
            trim()
    if pending:
        yield passed()


def gathered(t: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """(shard, distinct keys in order, their numbers) of all runs of a shard."""
    trim()
    runs = [unpacked(r.as_buffer()) for c in t.column("run").chunks for r in c]
    keys, n = (np.concatenate(x) for x in zip(*runs, strict=True))
    del runs
    return t.column("shard")[0].as_py(), *counted(keys, n)


def coded(folder: dict, shard: int, arrays: dict[str, np.ndarray], n: int, total: int, edges: list, hot: list) -> pa.Table:
    """One row about a shard: entries, total, and what the driver puts together: (context, part of its weight, children) of
    contexts cut apart, (entry, count) of entries to be cut on the next level. The arrays go to a file, or along with the row."""
    head, body, at = {}, [], 0
    for k, v in arrays.items():
        raw = np.ascontiguousarray(v).tobytes()
        head[k] = (at, str(v.dtype), len(v))
        raw += bytes(-len(raw) % 8)
        body.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    blob = struct.pack("<q", len(text)) + text + b"".join(body)
    if folder["mounted"]:
        os.makedirs(folder["path"], exist_ok=True)
        own = f"{folder['path']}/{shard}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            f.write(blob)
        os.replace(own, f"{folder['path']}/{shard}.bin")  # whole or not at all; a second attempt writes the same
        blob = None
    return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([n], pa.int64()), "total": pa.array([total], pa.int64()), "said": pa.array([json.dumps([edges, hot])]), "blob": pa.array([blob], pa.binary())})


CODED = "shard int, n long, total long, said string, blob binary"


class Level:
    """A level of the trie: the number of entries before each shard, and the shards' arrays, each mapped when it is first asked for."""

    def __init__(self, meta: dict):
        self.meta, self.maps = meta, {}
        self.base = np.cumsum([0, *meta["n"]])
        self.cuts = np.array(meta.get("cuts", []), U64)
        self.cut_ids, self.cut_first = np.array(meta.get("cut_ids", []), np.int64), np.array(meta.get("cut_first", []), np.int64)
        self.cut_backoff, self.cut_children = np.array(meta.get("cut_backoff", []), np.uint8), np.array(meta.get("cut_children", []), np.int64)

    def part(self, k: int) -> tuple[dict, dict]:
        """(arrays, sequences) of a shard."""
        if k not in self.maps:
            name = f"{self.meta['path']}/{k}.bin" if self.meta["mounted"] else SparkFiles.get(f"{self.meta['name']}-{k}.bin")
            with open(name, "rb") as f:
                held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            (size,) = struct.unpack_from("<q", held)
            first = 8 + size
            p = {key: np.frombuffer(held, kind, n, first + at) for key, (at, kind, n) in json.loads(held[8:first]).items()}
            self.maps[k] = p, {key: ef.Sequence(p, key) for key in ("keys", "first") if f"{key}.meta" in p}
        return self.maps[k]

    def each(self, shard: np.ndarray):
        """(number, positions, arrays, sequences) of every shard that is asked for and has entries."""
        if not len(shard):
            return
        if (shard[1:] >= shard[:-1]).all():
            order, ranked = np.arange(len(shard)), shard
        else:
            order = np.argsort(shard, kind="stable")
            ranked = shard[order]
        kinds, first = np.unique(ranked, return_index=True)
        for k, a, b in zip(kinds.tolist(), first, np.append(first[1:], len(shard)), strict=True):
            if self.meta["n"][k]:
                yield k, order[a:b], *self.part(k)

    def cut(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of contexts: which are cut apart, and their number among those."""
        if not len(self.cut_ids):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        i = np.minimum(np.searchsorted(self.cut_ids, ids), len(self.cut_ids) - 1)
        at = np.flatnonzero(self.cut_ids[i] == ids)
        return at, i[at]


_OPEN: dict[str, Level] = {}


def opened(meta: dict) -> Level:
    if meta["name"] not in _OPEN:
        for k in [k for k in _OPEN if len(_OPEN) > 8]:
            del _OPEN[k]
        _OPEN[meta["name"]] = Level(meta)
    return _OPEN[meta["name"]]


def bits_of(shards: int) -> int:
    return max(0, (shards - 1).bit_length())


def by_range(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def by_cut(cuts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts[:-1], keys, "right") - 1


class Trie:
    """Queries over the levels whose meta is given."""

    def __init__(self, metas: list[dict]):
        self.levels, self.metas = [opened(m) for m in metas], metas
        self.N, self.V, self.bits = metas[0]["total"], int(self.levels[0].base[-1]), metas[0]["bits"]

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of each word hash."""
        one = self.levels[0]
        kinds, back = np.unique(h, return_inverse=True)
        ids, count = np.full(len(kinds), -1, np.int64), np.zeros(len(kinds), np.int64)
        for k, at, p, s in one.each(by_range(kinds, self.bits)):
            got = s["keys"].find(kinds[at])
            ok = got >= 0
            n = p["count"][got[ok]].astype(np.int64)
            big = np.flatnonzero(n == 255)
            n[big] = p["large.n"][np.searchsorted(p["large.i"], got[ok][big])]
            ids[at[ok]], count[at[ok]] = got[ok] + one.base[k], n
        return ids[back], count[back]

    def pairs(self, a: np.ndarray, b: np.ndarray):
        """Of pairs of word numbers in rising order (neither -1): position or -1, rank among a's successors, share; and a's
        back-off weight."""
        two = self.levels[1]
        pos, rank, share, weight = np.full(len(a), -1, np.int64), np.full(len(a), -1, np.int64), np.zeros(len(a)), np.ones(len(a))
        key = (a.astype(U64) << U64(32)) | b.astype(U64)
        for k, at, p, s in two.each(by_cut(two.cuts, key)):
            own = a[at] - int(two.cuts[k] >> U64(32))
            weight[at] = VALUE[p["backoff"][own]]
            got = s["keys"].find(own.astype(U64) * U64(self.V) + b[at].astype(U64))
            ok = np.flatnonzero(got >= 0)
            i = at[ok]
            pos[i] = got[ok] + two.base[k]
            new = np.append(True, own[ok][1:] != own[ok][:-1])[: len(ok)]
            rank[i] = got[ok] - s["first"].get(own[ok][new]).astype(np.int64)[np.cumsum(new) - 1]
            share[i] = VALUE[p["share"][got[ok]]]
        at, i = two.cut(a)
        weight[at] = VALUE[two.cut_backoff[i]]
        rank[at] = np.where(pos[at] >= 0, pos[at] - two.cut_first[i], -1)
        return pos, rank, share, weight

    def children(self, a: np.ndarray) -> np.ndarray:
        """How many successors words have."""
        two, out = self.levels[1], np.zeros(len(a), np.int64)
        for k, at, _, s in two.each(by_cut(two.cuts, a.astype(U64) << U64(32))):
            own = a[at] - int(two.cuts[k] >> U64(32))
            out[at] = s["first"].get(own + 1).astype(np.int64) - s["first"].get(own).astype(np.int64)
        at, i = two.cut(a)
        out[at] = two.cut_children[i]
        return out

    def triples(self, pair: np.ndarray, rank: np.ndarray):
        """Of (position of a pair, rank of the next word among the second's successors): share, the pair's weight."""
        three, wide = self.levels[2], self.metas[1]["wide"]
        share, weight = np.zeros(len(pair)), np.ones(len(pair))
        for k, at, p, s in three.each(by_cut(three.cuts, pair.astype(U64) * U64(wide) + np.maximum(rank, 0).astype(U64))):
            own = pair[at] - int(three.cuts[k]) // wide
            weight[at] = VALUE[p["backoff"][own]]
            ask = np.flatnonzero(rank[at] >= 0)
            got = s["keys"].find(own[ask].astype(U64) * U64(wide) + rank[at[ask]].astype(U64))
            ok = got >= 0
            share[at[ask[ok]]] = VALUE[p["share"][got[ok]]]
        at, i = three.cut(pair)
        weight[at] = VALUE[three.cut_backoff[i]]
        return share, weight


def neighbours(lengths: np.ndarray) -> np.ndarray:
    """Index of each token that has one before it in its document."""
    first = np.zeros(int(lengths.sum()), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    return np.flatnonzero(~first)


def pair_keys(trie: Trie, col: pa.Array) -> np.ndarray:
    """Word numbers a << 32 | b of all pairs."""
    h, lengths = tokens(col)
    ids, _ = trie.words(h)
    i = neighbours(lengths)
    return (ids[i - 1].astype(U64) << U64(32)) | ids[i].astype(U64)


def walk(trie: Trie, col: pa.Array):
    """Of all tokens: number, count, and of those with one before: index, pair position, rank, share, weight."""
    h, lengths = tokens(col)
    ids, count = trie.words(h)
    i = neighbours(lengths)
    known = i[ids[i - 1] >= 0]
    kinds, back = np.unique((ids[known - 1].astype(U64) << U64(32)) | (ids[known] + 1).astype(U64), return_inverse=True)
    a, b = (kinds >> U64(32)).astype(np.int64), (kinds & U64(0xFFFFFFFF)).astype(np.int64) - 1
    ask = np.where(b >= 0, b, trie.V - 1)
    # an unknown word is asked for as the last one, and its finds are thrown away: the order stays
    order = np.argsort((a << 32) | ask, kind="stable")
    pos, rank, share, weight = (np.empty(len(a), t) for t in (np.int64, np.int64, float, float))
    pos[order], rank[order], share[order], weight[order] = trie.pairs(a[order], ask[order])
    pos[b < 0], rank[b < 0], share[b < 0] = -1, -1, 0.0
    n = len(h)
    full = [np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n), np.ones(n)]
    for out, x in zip(full, (pos, rank, share, weight), strict=True):
        out[known] = x[back]
    return count, lengths, i, *full


def triple_keys(trie: Trie, col: pa.Array) -> np.ndarray:
    """(position of the first pair) * wide + rank of the third word, of all triples."""
    _, lengths, i, pos, rank, _, _ = walk(trie, col)
    i = i[(pos[i] >= 0) & (pos[i - 1] >= 0)]
    second = np.zeros(len(pos), bool)
    second[neighbours(lengths)] = True
    i = i[second[i - 1]]
    return pos[i - 1].astype(U64) * U64(trie.metas[1]["wide"]) + rank[i].astype(U64)


def merge_words(t: pa.Table, folder: dict, much: int) -> pa.Table:
    shard, keys, n = gathered(t)
    large = np.flatnonzero(n >= 255)
    arrays = ef.build(keys, "keys") | {"count": np.minimum(n, 255).astype(np.uint8), "large.i": large, "large.n": n[large]}
    hot = np.flatnonzero(n > much)
    return coded(folder, shard, arrays, len(keys), int(n.sum()), [], [[int(i), int(n[i])] for i in hot])


def counts_of(level: Level, first: int, last: int) -> np.ndarray:
    """Exact counts of the entries numbered first to last, which lie in one shard."""
    k = int(np.searchsorted(level.base, first, "right")) - 1
    p, _ = level.part(k)
    a, b = first - int(level.base[k]), min(last - int(level.base[k]) + 1, level.meta["n"][k])
    n = p["count"][a:b].astype(np.int64)
    x, y = np.searchsorted(p["large.i"], (a, b))
    n[p["large.i"][x:y] - a] = p["large.n"][x:y]
    return n


def merge_contexts(t: pa.Table, meta: dict, cuts: np.ndarray, folder: dict, bits_or_wide: tuple[int, int], multiplier: int, much: int) -> pa.Table:
    """A shard of pairs or triples below the level that meta describes. Keys are context * factor + rest (factor a power of two for
    pairs, where the rest is below multiplier)."""
    above = opened(meta)
    shard, keys, n = gathered(t)
    factor, pairs = bits_or_wide
    lo, hi = int(cuts[shard]), int(cuts[shard + 1])
    first, last = lo // factor, (hi - 1) // factor
    context = counts_of(above, first, last)
    a = (keys // U64(factor)).astype(np.int64) - first
    share = (n - DISCOUNT) / context[a]
    kept, children = np.bincount(a, share, len(context)), np.bincount(a, minlength=len(context))
    values = a.astype(U64) * U64(multiplier) + keys % U64(factor)
    arrays = ef.build(values, "keys") | {"share": quantised(share), "backoff": quantised(1 - kept)}
    hot: list = []
    if pairs:
        large = np.flatnonzero(n >= 255)
        arrays |= ef.build(np.append(0, np.cumsum(children)).astype(U64), "first", ones=True) | {"count": np.minimum(n, 255).astype(np.uint8), "large.i": large, "large.n": n[large]}
        hot = [[int(i), int(n[i]), int(keys[i] % U64(factor))] for i in np.flatnonzero(n > much)]
    # a context that a cut goes through is alone in its shards
    edges = [[first, float(kept[0]), int(children[0])]] if lo % factor or hi % factor else []
    return coded(folder, shard, arrays, len(keys), int(children.max(initial=0)), edges, hot)


def stored(built: DataFrame, shards: int, folder: dict) -> dict:
    """Have the shards built; a description of the level, with what contexts that were cut apart come to."""
    spark = built.sparkSession
    at = fresh_path(spark, "level")
    built.write.parquet(at)
    forget(spark, at)
    rows = spark.read.schema(CODED).parquet(at)
    n, total, whole, hot = [0] * shards, [0] * shards, {}, []
    for r in sorted(rows.select("shard", "n", "total", "said").collect()):  # a row for each shard
        n[r.shard], total[r.shard] = r.n, r.total
        edges, some = json.loads(r.said)
        hot += [[r.shard, *x] for x in some]
        for c, kept, children in edges:
            first, sums, count = whole.get(c, (r.shard, 0.0, 0))
            whole[c] = (first, sums + kept, count + children)
    base = np.cumsum([0, *n])
    if not folder["mounted"]:
        for r in rows.select("shard", "blob").toLocalIterator():
            own = f"{tempfile.mkdtemp()}/{folder['name']}-{r.shard}.bin"
            with open(own, "wb") as f:
                f.write(r.blob)
            spark.sparkContext.addFile(own)
    ids = sorted(whole)
    told = {"cut_ids": ids, "cut_first": [int(base[whole[c][0]]) for c in ids], "cut_backoff": quantised(np.array([1 - whole[c][1] for c in ids])).tolist(), "cut_children": [whole[c][2] for c in ids]}
    return folder | told | {"n": n, "totals": total, "total": sum(total), "hot": [[int(base[k]) + i, *rest] for k, i, *rest in hot]}


def cut_keys(base: np.ndarray, factor: int, hot: list[tuple[int, int, int]], much: int) -> np.ndarray:
    """Where shards of the next level begin, and its end: at the first key of each shard of this level, and inside the keys of
    contexts (number, count, span of the rest) that have more occurrences than much."""
    cuts = {int(b) * factor for b in base}
    for c, count, span in hot:
        pieces = min(max(1, span), -(-count // max(1, much)))
        cuts |= {c * factor + j * span // pieces for j in range(pieces)} | {(c + 1) * factor}
    return np.array(sorted(cuts), U64)


def shared_folder(spark, name: str) -> dict:
    """Where a level's shards go: a path that all machines have, or, if the shared folder is in another store, a name only."""
    path = spark._jvm.org.apache.hadoop.fs.Path(fresh_path(spark, f"trie-{name}"))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mounted = files.getScheme() == "file"
    if mounted:
        files.mkdirs(path)
        files.deleteOnExit(path)
    return {"name": path.getName(), "mounted": mounted, "path": path.toUri().getPath()}


def train(texts: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[dict]:
    """The trie of the texts (one binary column): a description of each level, small enough to go with every task."""
    spark = texts.sparkSession
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = bits_of(max(1, math.ceil(size / shard_bytes)))
    # a token is a letter and a space at least; few are so short
    much = max(1, shard_bytes // 12)

    def level(keys, shard_of, merge, folder, shards):
        deal = texts.mapInArrow(lambda it: dealt(it, keys, shard_of), SHARDED)
        return stored(deal.repartitionById(shards, F.col("shard")).groupBy("shard").applyInArrow(merge, CODED), shards, folder)

    f1, f2, f3 = (shared_folder(spark, k) for k in "123")
    one = level(lambda c: tokens(c)[0], lambda k: by_range(k, bits), lambda t: merge_words(t, f1, much), f1, 1 << bits)
    one["bits"] = bits
    words = int(sum(one["n"]))
    cuts2 = cut_keys(np.cumsum([0, *one["n"]]), 1 << 32, [(i, c, words) for i, c in one["hot"]], much)
    two = level(lambda c: pair_keys(Trie([one]), c), lambda k: by_cut(cuts2, k), lambda t: merge_contexts(t, one, cuts2, f2, (1 << 32, 1), max(1, words), much), f2, max(1, len(cuts2) - 1))
    two["cuts"] = cuts2.tolist()
    two["wide"] = max(1, max(two["totals"]), *two["cut_children"])
    spans = Trie([one, two]).children(np.array([b for _, _, b in two["hot"]], np.int64)).tolist() if two["hot"] else []
    cuts3 = cut_keys(np.cumsum([0, *two["n"]]), two["wide"], [(i, c, s) for (i, c, _), s in zip(two["hot"], spans, strict=True)], much)
    three = level(lambda c: triple_keys(Trie([one, two]), c), lambda k: by_cut(cuts3, k), lambda t: merge_contexts(t, two, cuts3, f3, (two["wide"], 0), two["wide"], much), f3, max(1, len(cuts3) - 1))
    three["cuts"] = cuts3.tolist()
    return [one, two, three]


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_column(trie: Trie, col: pa.Array):
    """(n_tokens, n_known, base score, score) of each text."""
    count, lengths, i, pos, rank, share, weight = walk(trie, col)
    floor = trie.N + ADD * (trie.V + 1)
    p1 = (count + ADD) / floor
    p = p1.copy()
    p[i] = share[i] + weight[i] * p1[i]
    second = np.zeros(len(p), bool)
    second[i] = True
    j = i[second[i - 1] & (pos[i - 1] >= 0)]
    more, less = trie.triples(pos[j - 1], rank[j])
    p[j] = more + less * p[j]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.empty(0)
    return lengths, add((count > 0).astype(np.int64)), add(np.log10(p1)), add(np.log10(np.maximum(p, 1e-300)))


def score(docs: DataFrame, metas: list[dict]) -> DataFrame:
    """Scores of all rows of docs (doc_id, held_out, text)."""

    def run(it):
        trie = Trie(metas)
        for b in batches(it, 100_000, 2, BATCH_BYTES):
            n, known, base, full = score_column(trie, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), trie.N), pa.int64()), pa.array(base, pa.float64()), pa.array(full, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        trim()

    return docs.mapInArrow(run, SCORED)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents")
    text = as_bytes(docs.withColumn("held_out", crc_mod("doc_id", 10) == 0), "doc_id", "held_out")
    return score(text, train(text.where(~F.col("held_out")).select("text")))
