"""HTML extraction with a site style tree.

The DOMs of one host are merged: block elements with the same path of labels (tag, classes, id without digits) are one
node of the site's tree. For a node found on m pages of the host
- presentation: its variants are the sequences of its children's labels, p_i their shares; importance -sum p_i log_m p_i, 1 at most;
- content: the texts of its own blocks, df_i the pages that hold text i; importance 1 - sum df_i log_m(df_i) / sum df_i;
and a node's composite importance is (1 - g^l) presentation + g^l (share-weighted children and content), l its variants.
Branches below LOW (CORE_LOW inside article or main) are removed from each page, as are those whose label says what they are
(menus, headers, footers, asides, forms, adverts, notices, comments: importance 0 whatever their entropy; so are blocks that are
mostly links), and, where a page has an article or main element, what lies outside. If entropy alone would leave a page
without text, its branches stay.

Text: character references decoded, white space inside a block becomes one space, blocks joined in page order by one
space. Null html is empty; broken markup is read as far as it goes, in time linear in the page. Pages without a host in their url
share the host ''. Rows that repeat are pages of their own; importance ties with the threshold stay; an empty table gives an
empty one; other columns than page_id, url and html aren't read.
Neither a host's pages nor its nodes are gathered: counts are summed by (node, feature), a node's key holding its host, and
importances go up the tree level by level, each a join of nodes with the sums of their children. Blocks deeper than LEVELS
belong to their ancestor there. The nodes to remove go to every task while they are LOW_BROADCAST at most; beyond, each page's
nodes are shuffle-joined with them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import U64, batches, materialize, table, tuned

LOW, CORE_LOW, MIN_PAGES, DAMPING = 0.3, 0.1, 5, 0.9
LINKS = 0.6
LEVELS = 64
#: Nodes of a level, of some 50 bytes each, that one task writes.
LEVEL_ROWS = 200_000
#: Nodes, of 8 bytes each.
LOW_BROADCAST = 1 << 21
#: HTML's elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg object select canvas video audio".split())
#: Of these a parser reads on to the end of the page if the closing tag is missing.
ENDLESS = frozenset("script style title textarea iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul head button label caption center".split()
)
SCOPES = frozenset("article aside body div section main nav header footer form td th table blockquote li figure details dialog html".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
NOISE_TAGS = frozenset("nav header footer aside form menu dialog head button search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
CORE_TAGS = frozenset(("article", "main"))
#: Words in classes and ids that name what isn't the article.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar sidebars aside footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay "
    "comment comments reply replies respond discussion disqus share sharing social related recommended recommendations newsletter subscribe "
    "subscription signup login register search pagination pager widget widgets copyright legal disclaimer skip toc rating ratings tags".split()
)
OPENS = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/><]*))")
STOPS = re.compile(r"[>\"']")
#: Quoted values looked through for the end of one tag; beyond, it ends at its first >.
QUOTES = 1000
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WORDS = re.compile(r"[A-Za-z]+")


def labelled(tag: str, attributes: str) -> tuple[str, bool | None]:
    """(label, whether it names noise; None for a header that its classes say is noise even in an article)."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return tag, tag in NOISE_TAGS
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    names = re.sub(r"\d+", "", f"{found.get('class', '')} {found.get('id', '')}").split()
    noise = tag in NOISE_TAGS or found.get("role", "").lower() in NOISE_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    if tag not in ("body", "html", *CORE_TAGS) and (not noise or tag == "header"):
        # an article's own classes say what it is about; a header's, whether it is more than a header
        said = {w.lower() for n in names for w in WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", n))} & NOISE_WORDS
        if tag != "header":
            noise = bool(said)
        elif said - {"header"}:
            return f"{tag}.{'.'.join(sorted(names))}", None
    return f"{tag}.{'.'.join(sorted(names))}", noise


def markup(source: str) -> Iterator[tuple[int, int, bool, str, str, str]]:
    """(start, end, closing, tag, attributes, CDATA) of comments, declarations and tags in order, in time linear in the page: what
    has no end is found so once, by the last place where such an end is."""
    last = {c: source.rfind(c) for c in (">", "\"", "'", "-->", "]]>")}
    pos = 0
    while m := OPENS.search(source, pos):
        start, tag = m.start(), (m[2] or "").lower()
        if m[0] == "<!--":
            end = source.find("-->", m.end() - 2) + 3 if last["-->"] >= m.end() - 2 else len(source)
            yield start, end, False, "", "", ""
        elif m[0] == "<![CDATA[" and last["]]>"] >= m.end():
            end = source.find("]]>", m.end()) + 3
            yield start, end, False, "", "", source[m.end() : end - 3]
        elif last[">"] < m.end():  # no tag ends any more
            return
        elif not tag:
            end = source.find(">", m.end()) + 1
            yield start, end, False, "", "", ""
        else:
            at, seen = m.end(), 0
            while (stop := STOPS.search(source, at)) and stop[0] != ">" and last[stop[0]] > stop.start() and seen < QUOTES:
                at, seen = source.find(stop[0], stop.end()) + 1, seen + 1
            end = stop.end() if stop and stop[0] == ">" else source.find(">", m.end()) + 1
            yield start, end, bool(m[1]), tag, source[m.end() : end - 1], ""
        pos = end


class Page:
    """The block elements of a page and its text blocks in order."""

    def __init__(self, source: str, host: str = ""):
        #: Per node: parent, label, key of its path, key of the path's parent, depth, noise (inherited), core (inherited), child labels.
        self.parent, self.label, self.key, self.up, self.depth = [-1], [""], [xxhash.xxh3_64_intdigest(host)], [0], [0]
        self.noise, self.core, self.children = [False], [False], [[]]
        self.blocks: list[tuple[int, str, float]] = []
        self._read(source)

    def _open(self, at: int, tag: str, attributes: str) -> int:
        label, noise = labelled(tag, attributes)
        self.children[at].append(label)
        self.parent.append(at)
        self.label.append(label)
        deep = self.depth[at] >= LEVELS
        self.key.append(self.key[at] if deep else xxhash.xxh3_64_intdigest(label, seed=self.key[at]))
        self.up.append(self.up[at] if deep else self.key[at])
        self.depth.append(LEVELS if deep else self.depth[at] + 1)
        # within an article a header holds its title, unless its names say otherwise
        self.noise.append(noise is None or noise and not (tag == "header" and self.core[at]) or self.noise[at])
        self.core.append(tag in CORE_TAGS and not self.noise[-1] or self.core[at] or "main" in attributes and 'role="main"' in attributes)
        self.children.append([])
        return len(self.key) - 1

    def _read(self, source: str) -> None:
        stack, tags, pos = [0], [""], 0
        text: list[str] = []
        links, linked = 0, 0

        def flush():
            nonlocal linked
            if text:
                whole = " ".join(html.unescape("".join(text)).split())
                if whole:
                    self.blocks.append((stack[-1], whole, linked / max(1, sum(map(len, text)))))
                text.clear()
            linked = 0

        unclosed: set[str] = set()
        for start, end, closing, tag, attributes, data in markup(source):
            if start < pos:
                continue
            if start > pos:
                piece = source[pos:start]
                text.append(piece)
                if links:
                    linked += len(piece)
            pos = end
            if not tag:
                if data:
                    text.append(html.escape(data))
                continue
            if tag == "br" or tag == "hr":
                text.append(" ")
            elif tag == "a":
                links = 0 if closing else 1
            elif tag in RAW and not closing:
                if not attributes.endswith("/"):
                    end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, pos)
                    if not end:
                        unclosed.add(tag)  # nor is it closed further on
                    pos = end.end() if end else len(source) if tag in ENDLESS else pos
            elif tag in BLOCK:
                flush()
                if closing:
                    for k in range(len(tags) - 1, 0, -1):
                        if tags[k] == tag:
                            del tags[k:], stack[k:]
                            break
                else:
                    if tag in CLOSES or tag in BLOCK and tags[-1] == "p":
                        for k in range(len(tags) - 1, 0, -1):
                            if tags[k] in CLOSES.get(tag, {"p"}):
                                del tags[k:], stack[k:]
                                break
                            if tags[k] in SCOPES:
                                break
                    stack.append(self._open(stack[-1], tag, attributes))
                    tags.append(tag)
        if pos < len(source):
            text.append(source[pos:] if not source[pos:].lstrip().startswith("<") else "")
        flush()

    def kept(self, low: set[int] | None = None) -> list[str]:
        """The blocks that stay, given the keys of the site's unimportant nodes."""
        has_core = any(c and not self.noise[n] for n, c in ((n, self.core[n]) for n, _, _ in self.blocks))
        sound = [(n, t) for n, t, share in self.blocks if not self.noise[n] and (self.core[n] or not has_core) and (share < LINKS or self.core[n])]
        if not low or not sound:
            return [t for _, t in sound]
        gone = [False] * len(self.key)
        for n in range(1, len(self.key)):  # parents come first
            gone[n] = gone[self.parent[n]] or self.key[n] in low
        return [t for n, t in sound if not gone[n]] or [t for _, t in sound]


COUNTED = "node long, up long, depth int, kind int, feature long, n long"


def signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, U64).view(np.int64))


def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages by (node, kind, feature): kind 0 pages with the node, 1 variants of children, 2 texts, 3 pages where it is in the core."""
    for b in batches(it, 4000, 1, 32_000_000):
        found: Counter = Counter()
        for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            page = Page(source.decode("utf-8", "replace"), host)
            seen = set()
            for n in range(1, len(page.key)):
                if page.noise[n]:
                    continue
                base = (page.key[n], page.up[n], page.depth[n])
                shape = [c for i, c in enumerate(page.children[n]) if i == 0 or c != page.children[n][i - 1]]
                seen.add((*base, 0, 0))
                seen.add((*base, 1, xxhash.xxh3_64_intdigest("|".join(shape))))
                if page.core[n]:
                    seen.add((*base, 3, 0))
            for n, text, _ in page.blocks:
                if n and not page.noise[n]:
                    seen.add((page.key[n], page.up[n], page.depth[n], 2, xxhash.xxh3_64_intdigest(text)))
            found.update(seen)
        cols = [[k[i] for k in found] for i in range(5)]
        yield pa.RecordBatch.from_arrays(
            [signed(cols[0]), signed(cols[1]), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), signed(cols[4]), pa.array(list(found.values()), pa.int64())],
            names=["node", "up", "depth", "kind", "feature", "n"],
        )


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def style_nodes(pages: DataFrame) -> DataFrame:
    """A row for each node of the sites' trees, with its own importances, of pages (host, html as bytes)."""
    by = pages.select("host", "html").mapInArrow(counted, COUNTED).groupBy("node", "up", "depth", "kind", "feature").agg(F.sum("n").alias("n"))
    n, kind = F.col("n").cast("double"), F.col("kind")
    only = lambda k, x: F.sum(F.when(kind == k, x).otherwise(0.0))
    sums = {"pages": only(0, n), "core": only(3, n) > 0, "variants": only(1, F.lit(1.0)), "shapes": only(1, n), "s1": only(1, n * F.log(n)), "texts": only(2, n), "s2": only(2, n * F.log(n))}
    node = by.groupBy("node", "up", "depth").agg(*[v.alias(k) for k, v in sums.items()])
    # -sum p log_m p with p = n / sum n, and 1 - sum df log_m df / sum df; both 1 on a single page
    m = F.greatest(F.col("pages"), F.lit(1.0))
    entropy = (F.log("shapes") - F.col("s1") / F.col("shapes")) / F.log(m)
    node = node.withColumn("presentation", F.when(m <= 1, 1.0).otherwise(F.least(F.lit(1.0), entropy)))
    return node.withColumn("content", F.when((m <= 1) | (F.col("texts") == 0), 1.0).otherwise(1 - F.col("s2") / (F.col("texts") * F.log(m)))).drop("shapes", "s1", "s2")


def importances(nodes: DataFrame) -> DataFrame:
    """The nodes with their composite importance (value): from the deepest level up, each node from its own importances and
    those of its children."""
    nodes = materialize(nodes.sortWithinPartitions("depth"), "style-nodes")
    levels, kids = [], None
    for depth, n in sorted(((r.depth, r["count"]) for r in nodes.groupBy("depth").count().collect()), reverse=True):  # LEVELS rows at most
        own = nodes.where(F.col("depth") == depth)
        own = own.join(kids, F.col("node") == F.col("of"), "left") if kids is not None else own.select("*", *[F.lit(None).cast("double").alias(k) for k in ("below_n", "below_sum")])
        weight = F.coalesce(F.col("below_n"), F.lit(0.0)) + F.col("texts")
        below = F.when(weight > 0, (F.coalesce(F.col("below_sum"), F.lit(0.0)) + F.col("texts") * F.col("content")) / weight).otherwise(1.0)
        damp = F.pow(F.lit(DAMPING), F.greatest(F.lit(1.0), F.col("variants")))
        value = F.when(F.col("below_n").isNull(), below).otherwise((1 - damp) * F.col("presentation") + damp * below)
        own = materialize(own.select("node", "up", "depth", "core", "pages", value.alias("value")).coalesce(1 + n // LEVEL_ROWS), "style-level")
        kids = own.groupBy(F.col("up").alias("of")).agg(F.sum("pages").alias("below_n"), F.sum(F.col("pages") * F.col("value")).alias("below_sum"))
        levels.append(own)
    return reduce(DataFrame.unionAll, levels) if levels else nodes.select("node", "up", "depth", "core", "pages", F.lit(1.0).alias("value"))


def unimportant(pages: DataFrame) -> DataFrame:
    """(node): the nodes to remove, of pages (host, html as bytes)."""
    low = F.col("value") < F.when(F.col("core"), CORE_LOW).otherwise(LOW)
    return importances(style_nodes(pages)).where((F.col("pages") >= MIN_PAGES) & low).select("node")


def among(low: np.ndarray, page: Page) -> set[int]:
    """Those of the sorted keys that are keys of the page."""
    if not len(low):
        return set()
    keys = np.array(page.key, U64)
    return set(keys[low[np.minimum(np.searchsorted(low, keys), len(low) - 1)] == keys].tolist())


def listed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, node) of the nodes of each page."""
    for b in batches(it, 2000, 2, 32_000_000):
        rows, nodes = [], []
        for row, host, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
            keys = set(Page(source.decode("utf-8", "replace"), host).key)
            rows += [row] * len(keys)
            nodes += keys
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), signed(nodes)], names=["row", "node"])


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    tuned(pages.sparkSession)
    own = pages.select("page_id", "url", host_of("url").alias("host"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    low = materialize(unimportant(own), "style-low")
    few = low.count() <= LOW_BROADCAST
    sent = own.sparkSession.sparkContext.broadcast(np.sort(low.toArrow().column("node").to_numpy().view(U64)) if few else None)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 2000, 3, 32_000_000):
            texts = []
            for host, source, gone in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                page = Page(source.decode("utf-8", "replace"), host)
                keys = among(sent.value, page) if few else {k & 0xFFFFFFFFFFFFFFFF for k in gone or ()}
                texts.append(" ".join(page.kept(keys)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if few:
        rows = own.withColumn("low", F.lit(None).cast("array<long>"))
    else:
        rows = materialize(own.withColumn("row", F.monotonically_increasing_id()), "style-pages")
        hits = rows.select("row", "host", "html").mapInArrow(listed, "row long, node long").join(low, "node")
        rows = rows.join(hits.groupBy("row").agg(F.collect_set("node").alias("low")), "row", "left")  # a page's own nodes at most
    return rows.select("page_id", "url", "host", "html", "low").mapInArrow(run, EXTRACTED)


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
