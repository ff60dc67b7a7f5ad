"""MinHash near-dedup by BagMinHash.

Each document is a bag of five-word shingles (words are runs of anything but ASCII white space, A-Z lower-cased). For
each shingle of the bag and each dyadic interval of its discretised weight - {1}, {2}, {3,4}, {5..8}, ... - a Poisson
process seeded by (shingle, interval) yields points in rising order; a point names a signature component and a unit
of the interval, and counts if the unit is at most the shingle's multiplicity. A component holds the first point that
counts for it. Two components are equal with the probability of the weighted Jaccard similarity of the two bags.

1. one pass over the texts: a 128-bit key of the word sequence (exact copies are one node), signature, band keys;
2. nodes that share a band key are a bucket; its hub is the member with the largest buckets in all, so the text that many
   near copies stem from is the hub of most of them; each member is tried against the hub;
3. tries are verified on the exact multisets, links are merged to components by large-star / small-star steps;
4. in buckets that still hold more than one component, members outside the hub's are tried against all members of other
   components, in blocks of bounded size; a pair is tried in the first band it shares only. So no bucket is
   capped, no group is collected, and copies that the hub has gathered make no pairs among themselves.

A pair of which under LIKELY of the components agree isn't verified: of pairs at the threshold, 1 in 1.6 billion (a binomial
tail: 39 or fewer of 80 at 0.8). The bands miss 2.5 in 100,000 of pairs at exactly the threshold, and fewer above it.

Nulls and texts without a word belong to no group: each such row is its own class. Rows that repeat a doc_id are
rows of their own; a class is named by the least doc_id in it (null only if all its ids are null), and told apart from
others by class_key, as ids may repeat. Very long texts are bags like others; batches are cut by bytes. An empty table gives an empty
one. Of docs only doc_id and text are read, so other columns' names don't matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import U64, as_bytes, batches, bitmap_of, flat_windows, forget, in_bitmap, materialize, mix, table, text_key, tuned, words_of

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
M = BANDS * ROWS
#: Expected points for each component before a document's time horizon; documents with an empty component run on.
HORIZON = 7.0
#: Members of a block in step 4, about: outside the hub's component, and all.
ACROSS, DOWN = 256, 512
#: Share of signature components (8 bits of each) that must agree before a pair is verified.
LIKELY = 0.5


def bags(col: pa.Array, width: int = WIDTH):
    """Of a binary column of texts: (document index, shingle hash, multiplicity) of distinct shingles, documents in
    order; a 128-bit key of each document's word sequence (None without words)."""
    words, lengths = words_of(col)
    cuts = np.append(0, np.cumsum(lengths))
    nodes = [xxhash.xxh3_128_digest(words[a:b].tobytes()) if b > a else None for a, b in itertools.pairwise(cuts)]
    h, doc, _ = flat_windows(words, lengths, width)
    count = np.ones(len(h), np.int64)
    key = mix(h ^ mix(doc.astype(U64)))
    ranked = np.sort(key)
    twice = ranked[1:] == ranked[:-1]
    if twice.any():  # only what repeats is counted and merged
        found = np.unique(ranked[1:][twice])
        at = np.minimum(np.searchsorted(found, key), len(found) - 1)
        again = found[at] == key
        where = np.flatnonzero(again)
        _, first, n = np.unique(key[where], return_index=True, return_counts=True)
        count[where[first]] = n
        keep = ~again
        keep[where[first]] = True
        h, doc, count = h[keep], doc[keep], count[keep]
        order = np.argsort(doc, kind="stable")
        h, doc, count = h[order], doc[order], count[order]
    elif (doc[1:] < doc[:-1]).any():
        order = np.argsort(doc, kind="stable")
        h, doc, count = h[order], doc[order], count[order]
    return doc, h, count, nodes


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n_docs: int, m: int = M) -> np.ndarray:
    """BagMinHash signatures (n_docs x m, 32 bits) of bags as from bags(); rows of empty bags are zero."""
    weight = np.bincount(doc, weights=count, minlength=n_docs)
    sig, horizon = np.zeros((n_docs, m), np.uint32), np.full(n_docs, HORIZON)
    todo = np.flatnonzero(weight > 0)
    while len(todo):
        wanted = np.zeros(n_docs, bool)
        wanted[todo] = True
        ids, hs, low, size, top = [], [], [], [], []
        lo, step, j = 0, 1, 0
        live = np.flatnonzero(wanted[doc])
        while len(live):  # interval j covers the units lo + 1 .. lo + step
            ids.append(doc[live]), hs.append(mix(h[live] ^ mix(np.full(1, j + 1, U64))))
            low.append(np.full(len(live), lo)), size.append(np.full(len(live), step)), top.append(count[live])
            lo, step, j = lo + step, step if j == 0 else step * 2, j + 1
            live = live[count[live] > lo]
        e, state, lo, size, top = map(np.concatenate, (ids, hs, low, size, top))
        # an entry's time is measured in steps of its own rate, m * size
        until = (horizon / np.maximum(weight, 1))[e] * (m * size)
        t, at_e = np.zeros(len(e)), np.arange(len(e))
        found_at, found_t, found_id = [], [], []
        while len(at_e):
            state = mix(state)
            t = t - np.log(uniform(state))
            ok = np.flatnonzero(t <= until)
            at_e, state, until, t = at_e[ok], state[ok], until[ok], t[ok]
            point = mix(state ^ U64(0xD6E8FEB86659FD93))
            s = size[at_e]
            good = slice(None)
            if len(s) and s.max() > 1:
                unit = lo[at_e] + 1 + ((point >> U64(44)).astype(np.int64) & (s - 1))
                good = np.flatnonzero(unit <= top[at_e])
            p = point[good]
            found_at.append(e[at_e[good]] * m + (((p & U64(0xFFFFF)) * U64(m)) >> U64(20)).astype(np.int64))
            found_t.append(t[good] / (m * s[good]))
            found_id.append((mix(p) >> U64(32)).astype(np.uint32) | np.uint32(1))
        at, when, pid = map(np.concatenate, (found_at, found_t, found_id))
        order = np.argsort(-when, kind="stable")  # the earliest is written last
        flat = sig.reshape(-1)
        flat[at[order]] = pid[order]
        todo = todo[(sig[todo] == 0).any(axis=1)]
        sig[todo] = 0
        horizon[todo] *= 2
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    out = np.empty((len(sig), BANDS), U64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            key = np.full(len(sig), b + 1, U64)
            for r in range(ROWS):
                key = mix(key * U64(0x9E3779B97F4A7C15) ^ sig[:, b * ROWS + r].astype(U64))
            out[:, b] = key
    return out.view(np.int64)


SIGNED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.binary()), ("keys", pa.list_(pa.int64())), ("sig", pa.binary())])


def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it, column=2):
        doc, h, count, nodes = bags(b.column(2))
        sig = signatures(doc, h, count, b.num_rows)
        keys, short = band_keys(sig), (sig >> np.uint32(8)).astype(np.uint8)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, b.num_rows * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.binary()), lists, pa.array([x.tobytes() for x in short], pa.binary())], schema=SIGNED)


SHINGLED = pa.schema([("node", pa.binary()), ("bag", pa.binary())])


def shingled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sorted 64-bit fingerprints of (shingle, k-th occurrence)) of each text of batches (id hash, text)."""
    for b in batches(it):
        doc, h, count, nodes = bags(b.column(1))
        which = np.repeat(np.arange(len(h)), count)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        prints = mix(h[which] ^ mix(nth.astype(U64)))
        edges = np.searchsorted(doc[which], np.arange(b.num_rows + 1))
        bag = [np.sort(prints[p:q]).tobytes() for p, q in itertools.pairwise(edges)]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(bag, pa.binary())], schema=SHINGLED)


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard of two bags from shingled(): each unit of multiplicity is an element."""
    x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
    if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return 0.0
    both = np.sort(np.concatenate([x, y]), kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(x) + len(y) - same)


LINKED = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])


def compared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it, 500, column=2):
        a, b, x, y = (batch.column(k).to_pylist() for k in ("a", "b", "bag_a", "bag_b"))
        s = [similarity(p, q) for p, q in zip(x, y, strict=True)]
        keep = [i for i, v in enumerate(s) if v >= SIMILARITY]
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.binary()), pa.array([b[i] for i in keep], pa.binary()), pa.array([s[i] for i in keep], pa.float64())], schema=LINKED)


def likely(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, M) for k in (2, 3))
        keep = pa.array((x == y).mean(axis=1) >= LIKELY)
        yield batch.select([0, 1]).filter(keep)


def bags_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, bag) of the nodes. A bitmap of bounded size lets nearly only the texts of nodes' first documents through, so that no
    text is shuffled; the join by node decides."""
    spark = docs.sparkSession
    hashed = nodes.select(F.xxhash64("first_id").alias("h"))
    sent = spark.sparkContext.broadcast(bitmap_of(hashed, "h", nodes.count()))  # BITMAP_BITS at most

    def run(it):
        def some():
            for b in it:
                yield b.filter(pa.array(in_bitmap(sent.value, b.column(0).to_numpy())))

        return shingled(some())

    texts = as_bytes(docs.select("text", F.xxhash64("doc_id").alias("h")), "h")
    found = texts.mapInArrow(run, "node binary, bag binary").join(nodes.select("node"), "node", "left_semi")
    return materialize(found.dropDuplicates(["node"]), "bags")


def verified(pairs: DataFrame, nodes: DataFrame, bag: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bags overlap enough, with their similarity."""
    sig = lambda k: nodes.select(F.col("node").alias(k), F.col("sig").alias(f"sig_{k}"))
    some = pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(likely, "a binary, b binary")
    own = lambda k: bag.select(F.col("node").alias(k), F.col("bag").alias(f"bag_{k}"))
    both = some.join(own("a"), "a").join(own("b"), "b").select("a", "b", "bag_a", "bag_b")
    return materialize(both.mapInArrow(compared, "a binary, b binary, similarity double"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node reachable over edges (u, v), by alternating large-star and small-star steps."""
    spark = edges.sparkSession
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark[0] == 0 or mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before = mark
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        old, now = now, materialize(small, "edges")
        forget(spark, old.inputFiles()[0].rsplit("/", 1)[0], now=True)  # this round's table is written; the last one's isn't read again


def block(t: pa.Table) -> pa.Table:
    """Links between the two sides of a block: rows (band key, side 0 or 1, node, comp, keys, sig, bag)."""
    t = t.combine_chunks()
    key = t.column("key")[0].as_py() if t.num_rows else 0
    side = t.column("side").to_numpy()
    keys = np.array(t.column("keys").to_pylist(), np.int64).reshape(-1, BANDS)
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, M)
    node, bag = t.column("node").to_pylist(), [np.frombuffer(x, U64) for x in t.column("bag").to_pylist()]
    _, comp = np.unique(np.array(t.column("comp").to_pylist(), object), return_inverse=True)
    rows, cols = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    out: list[tuple] = []
    if len(rows) and len(cols):
        band = int(np.flatnonzero(keys[rows[0]] == key)[0])
        for r in rows:
            c = cols[comp[cols] != comp[r]]
            c = c[~(keys[c, :band] == keys[r, :band]).any(axis=1)]
            c = c[(sig[c] == sig[r]).mean(axis=1) >= LIKELY]
            own = len(bag[r])
            c = np.array([k for k in c if min(own, len(bag[k])) >= SIMILARITY * max(own, len(bag[k]))], np.int64)
            if not len(c):
                continue
            flat = np.concatenate([bag[k] for k in c])
            hit = bag[r][np.minimum(np.searchsorted(bag[r], flat), own - 1)] == flat
            sizes = np.array([len(bag[k]) for k in c])
            same = np.add.reduceat(hit, np.cumsum(sizes) - sizes)
            for k, s in zip(c, same / (own + sizes - same), strict=True):
                if s >= SIMILARITY:
                    out.append((max(node[r], node[k]), min(node[r], node[k]), float(s)))
    return pa.Table.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.binary(), pa.binary(), pa.float64()))], schema=LINKED)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, node, class_key, class_id, class_size of each row of docs; node and class_key are null without a word."""
    spark = tuned(docs.sparkSession)
    text = as_bytes(docs.select("doc_id", text_key().alias("text_key"), "text"), "doc_id", "text_key")
    signed = materialize(text.mapInArrow(sign, "doc_id long, text_key long, node binary, keys array<long>, sig binary"), "signed")
    nodes = materialize(signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig")), "nodes")
    members = nodes.select(F.explode("keys").alias("key"), "node")
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    member = materialize(members.join(sizes, "key"), "members")
    weight = member.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = member.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("hub"))
    member = materialize(member.join(hubs, "key"), "members")
    pairs = materialize(member.where("node != hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct(), "pairs")
    copied = materialize(nodes.join(weight.select("node"), "node", "left_semi"), "copied")
    bag = bags_of(docs, copied)
    links = verified(pairs, copied, bag)
    as_edges = lambda x: x.select(F.col("a").alias("u"), F.col("b").alias("v"))
    comp = components(as_edges(links))
    named = member.where("size > 2").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of_hub = named.where("node = hub").select("key", F.col("comp").alias("hub_comp"))
    aside = materialize(named.join(of_hub, "key").withColumn("aside", F.col("comp") != F.col("hub_comp")).select("key", "node", "size", "comp", "aside"), "aside")
    mixed = aside.where("aside").groupBy("key").agg(F.count("*").alias("n_aside"))
    part = lambda n: F.pmod(F.xxhash64("node"), n)
    across, down = F.ceil(F.col("n_aside") / ACROSS), F.ceil(F.col("size") / DOWN)
    inside = aside.join(mixed, "key").withColumn("across", across).withColumn("down", down)
    payload = copied.select("node", "keys", "sig").join(bag, "node")
    rows = inside.where("aside").select("key", "node", "comp", F.lit(0).alias("side"), part(F.col("across")).alias("x"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("y"))
    cols = inside.select("key", "node", "comp", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("x"), part(F.col("down")).alias("y"))
    blocks = rows.select("key", "x", "y", "node", "comp", "side").unionByName(cols.select("key", "x", "y", "node", "comp", "side")).join(payload, "node")
    more = materialize(blocks.groupBy("key", "x", "y").applyInArrow(block, "a binary, b binary, similarity double"), "links")
    if not more.isEmpty():
        comp = components(as_edges(links.unionByName(more)))
    named = nodes.select("node", "first_id", "n").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    by_class = named.groupBy("comp").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_size"))
    node_class = materialize(named.join(by_class, "comp").select("node", F.col("comp").alias("class_key"), "class_id", "class_size"), "classes")
    return signed.select("doc_id", "text_key", "node").join(node_class, "node", "left").select(
        "doc_id", "text_key", "node", "class_key", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """One row per document: its class, named by the least doc_id in it, and the class's size."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
