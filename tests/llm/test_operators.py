"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.llm import eliasfano as ef
from rillflow.llm import op01_templates as op1
from rillflow.llm import op02_styletree as op2
from rillflow.llm import op03_bagminhash as op3
from rillflow.llm import op04_toxicity as op4
from rillflow.llm import op05_mixing as op5
from rillflow.llm import op06_quality as op6
from rillflow.llm import op07_crf as op7
from rillflow.llm import op08_ngram_trie as op8
from rillflow.llm import op09_shards as op9
from rillflow.llm import op10_linededup as op10
from rillflow.llm.common import as_bytes, crc_mod

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank, very long and repeated texts, ties."""
    base = prose(1, 120)
    rows = [(1, base, "en", "a"), (2, base, "en", "b"), (3, base.replace("alpha", "Alpha"), "de", None), (4, None, None, None), (5, "", "en", "a"), (6, " \n\t ", "en", "c"), (7, "one", "en", "a")]
    rows += [(None, prose(2, 30), "en", "a"), (None, None, None, "b"), (8, prose(3, 60), "fr", "b"), (8, prose(3, 60), "fr", "b"), (9, prose(4, 30_000), "en", "c"), (10, "a b c d e " * 40, "en", "a"), (11, "12 34 !!", "en", "b")]
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_templates(spark, odd, empty):
    item = "If Alice has 3 apples and gives 2 kg of them to Bob then Alice keeps one more apple than Bob had before"
    items = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    again = "If Maria has 17 apples and gives 5 lb of them to Pedro then Maria keeps one more apple than Pedro had before"
    mixed_up = again.replace("then Maria", "then Juan")
    rows = [(1, f"{prose(5, 30)}. {again}", "en", "a"), (2, item, "en", "a"), (3, mixed_up, "en", "a"), (4, prose(6, 50), "en", "a"), (5, None, None, None), (2, item, "en", "a")]
    got = {(r.doc_id, r.item_id): r for r in op1.contaminated(table(spark, rows), items).collect()}
    assert set(got) == {(1, 7), (2, 7), (3, 7)}  # of the third, the windows with the name that doesn't fit are left out
    assert got[1, 7].changed > 0 and got[2, 7].changed == 0 and got[2, 7].coverage == got[1, 7].coverage == 1.0 > got[3, 7].coverage
    assert op1.contaminated(empty, items).count() == 0
    assert op1.contaminated(odd, items.where("item_id = 99")).count() == 0
    assert op1.contaminated(odd.withColumn("hash", F.lit(1)).withColumn("item_id", F.lit(2)).withColumn("_id", F.lit(3)), items).count() == 0


def test_templates_tell_rows_with_one_id_apart(spark):
    item = "If Alice has 3 apples and gives 2 kg of them to Bob then Alice keeps one more apple than Bob had before"
    again, other = item.replace("Alice", "Maria").replace("3", "8"), item.replace("Alice", "Zoe").replace("3", "9")
    rows = [(1, again, "en", "a"), (1, other, "en", "a"), (1, prose(3, 40), "en", "a"), (None, again, "en", "a"), (None, other, "en", "a"), (None, None, "en", "a"), (2, again, "en", "a"), (2, again, "en", "a")]
    got = op1.contaminated(table(spark, rows), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == {(1, 7): 2, (None, 7): 2, (2, 7): 1}


def test_templates_need_consistent_slots(spark):
    names = "Alice Bob Carl Dora Emil Fritz Gerd Hans".split()
    item = "we saw that " + " ".join(f"Alice went off {w}" for w in ("home", "away", "there", "back", "west", "east", "north", "south"))
    other = "we saw that " + " ".join(f"{n} went off {w}" for n, w in zip(names, ("home", "away", "there", "back", "west", "east", "north", "south"), strict=True))
    one = item.replace("Alice", "Zoe")
    got = op1.contaminated(table(spark, [(1, other, "en", "a"), (2, one, "en", "a")]), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in got} == {2}


def template_tokens(text):
    """Tokens (template, value) by plain string operations, for texts of ASCII words."""
    out, begins = [], True
    for line in text.split("\n"):
        begins = True
        for word in line.split():
            bare = word.strip("!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~")
            if bare:
                low = bare.lower()
                number = bare[0].isdigit() or low in op1.NUMBERS
                unit = bool(out) and out[-1][0] == "#" and low in op1.UNITS
                name = bare[0].isupper() and not begins and not (len(bare) > 1 and bare[1].isupper())
                out.append(("#" if number else "@" if name else "u" if unit else low, low))
                if name and unit:
                    out[-1] = ("@", low)
            if bare:
                begins = word[-1] in "!.?:;"
            else:
                begins = begins or word[-1] in "!.?:;"
    return out


def brute_contaminated(text, item):
    """Whether the item is in the text: alignments by every diagonal, slots by the pairs that most windows show."""
    a, b = template_tokens(text), template_tokens(item)
    if not b:
        return False
    width = min(5, len(b))
    for exact in (False, True):
        col = 1 if exact else 0
        ok = [p for p in range(len(b) - width + 1) if exact or sum(x[0] not in "#u@" for x in b[p : p + width]) >= min(width, 3)]
        matched = set()
        for diagonal in range(-len(b), len(a)):
            hits = [p for p in ok if 0 <= p + diagonal and p + diagonal + width <= len(a) and [x[col] for x in a[p + diagonal : p + diagonal + width]] == [x[col] for x in b[p : p + width]]]
            shown = {p: [] if exact else [(b[p + k][1], a[p + diagonal + k][1]) for k in range(width) if b[p + k][0] in ("#", "u", "@")] for p in hits}
            count = Counter(pair for pairs in shown.values() for pair in set(pairs))
            left, right, taken = set(), set(), set()
            for (i, d), _ in count.most_common():
                if i not in left and d not in right:
                    left.add(i), right.add(d), taken.add((i, d))
            matched |= {p for p in hits if set(shown[p]) <= taken}
        if ok and len(matched) >= max(0.3 * len(ok), min(4, len(ok))):
            return True
    return False


def test_templates_against_brute_force(spark):
    r = random.Random(8)
    people, things, units = "Anna Bert Carla Dirk Eva".split(), "apples pears books pens cups".split(), ["kg", "miles", "hours", ""]
    fill = lambda: f"when {r.choice(people)} takes {r.randrange(2, 60)} {r.choice(units)} of {r.choice(things)} from {r.choice(people)} and then hands {r.randrange(2, 60)} of the {r.choice(things)} back how many are left"
    items = [(k, fill()) for k in range(6)] + [(6, "only four small words"), (7, "Add 3 5 8")]
    rows = []
    for k in range(60):
        kind = r.randrange(5)
        body = [prose(k, 12), fill() if kind == 0 else items[r.randrange(8)][1] if kind == 1 else fill().replace("takes", "drops") if kind == 2 else prose(-k, 9), prose(k + 99, 6)]
        rows.append((k, ". ".join(body) if kind else " ".join(body), "en", "a"))
    got = {(x.doc_id, x.item_id) for x in op1.contaminated(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, k) for i, t, *_ in rows for k, item in items if brute_contaminated(t, item)}
    assert got == want and 20 < len(want) < 400


def test_templates_by_shuffle(spark):
    """With joins dealt by hash, as they are once the items are large."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_templates_find_every_verbatim_item(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_templates_find_every_verbatim_item(spark):
    items = [(1, "Calculate 12 + 34 + 56"), (2, "photosynthesis"), (3, "Paris is nice"), (4, "Anna Bert Carl Dora Emil Fritz Gerd Hans"), (5, "7 8 9 10 11 12 13 14"), (6, "so what"), (7, "a b c d")]
    rows = [(k, f"{prose(k, 30)} today {t} and {prose(k + 50, 30)}", "en", "a") for k, t in items] + [(20, prose(9, 60), "en", "a"), (21, "so what", "en", "a"), (22, "Calculate 99 + 98 + 97", "en", "a"), (23, "what so", "en", "a")]
    rows += [(24, f"{prose(11, 20)} 7 8 9 99 98 12 13 14 {prose(12, 20)}", "en", "a")]
    got = {(r.doc_id, r.item_id): r for r in op1.contaminated(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(k, k) for k, _ in items} | {(21, 6)}
    assert all(r.coverage == 1.0 and r.changed == 0 for r in got.values())


def test_style_tree(spark):
    def page(i, body):
        return f"<html><head><title>t</title><style>p{{}}</style></head><body><div class='top'>Same words on every page of this site</div><nav><a>x{i}</a></nav><div class='body'>{body}</div><script>var a='</p>';</script><footer>f{i}</footer></body></html>"

    rows = [(i, f"https://a.example/{i}", page(i, f"<p>{prose(100 + i, 20)} &amp; more<br>text<p>{prose(200 + i, 20)}")) for i in range(12)]
    rows += [(20, "https://b.example/", "<article><h1>T</h1><p>Only &lt;one&gt;</p><section class='comments'>no</section></article><aside>no</aside>"), (21, None, None), (22, "x", ""), (23, "https://b.example/2", "plain text"), (20, "https://b.example/", "<p>again</p>")]
    got = {(r.page_id, r.text): r for r in op2.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = {k[0]: k[1] for k in got}
    assert len(got) == len(rows)
    for i in range(12):
        assert text[i] == f"{prose(100 + i, 20)} & more text {prose(200 + i, 20)}"
    assert (20, "T Only <one>") in got and (20, "again") in got and text[21] == "" and text[22] == "" and text[23] == "plain text"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert op2.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_style_tree_reads_on_after_unclosed_media(spark):
    tags = ("video", "audio", "object", "select", "canvas", "svg", "noscript")
    rows = [(i, "https://c.example/", f"<article><p>Before it<{t} id=x><p>and after it</article>") for i, t in enumerate(tags)]
    rows += [(20, "https://c.example/m", "<article><p>So <math><mi>x</mi><mo>+</mo><mi>y</mi></math> holds</article>"), (21, "https://c.example/s", "<article><p>Shown<script>var hidden = 1</article>")]
    rows += [(22, "https://c.example/v", "<article><p>Shown<video>no player</video> again</article>")]
    got = {r.page_id: r.text for r in op2.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "Before it and after it" for i in range(len(tags)))
    assert got[20] == "So x+y holds" and got[21] == "Shown" and got[22] == "Shown again"


def test_style_tree_reads_hostile_pages_in_linear_time():
    import time

    began = time.time()
    for page in ("<a " * 350_000, "<a x='" * 170_000 + ">", "<!-- " * 200_000, "<![CDATA[ " * 100_000, "<p title=\"" * 90_000, "<" * 10**6, "</" * 500_000, "<a \"" * 90_000 + ">"):
        op2.Page(page).kept()
    assert time.time() - began < 20
    assert op2.Page("<article><p title='a > b'>One<p title=\"it's\">two <b class=x>bold</b> 3 < 4").kept() == ["One", "two bold 3 < 4"]
    assert op2.Page("<p>x <![CDATA[y & z]]> <!-- no --> w</p>").kept() == ["x y & z w"]


def test_style_tree_keeps_articles_by_any_name(spark):
    rows = [(1, "https://d.example/1", "<article class='legal-news'><p>A ruling</article><div class=legal>no</div>"), (2, "https://d.example/2", "<main class='story-tags'><header class='post-header'><h1>Title</h1></header><p>Story</main>")]
    rows += [(3, "https://d.example/3", "<article><header class='share-bar header'>no</header><p>Text</article>"), (4, "https://d.example/4", "<header class=x>no</header><article>Yes</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("low", F.lit(2)).withColumn("text", F.lit("no"))
    assert {r.page_id: r.text for r in op2.extract(df).collect()} == {1: "A ruling", 2: "Title Story", 3: "Text", 4: "Yes"}


def brute_site(pages):
    """The texts that stay of a host's pages, each a list of (label, text, children); every node holds its text before its children."""
    seen = {}

    def walk(nodes, path, k):
        for label, text, kids in nodes:
            own = seen.setdefault((*path, label), {"pages": set(), "shapes": set(), "texts": set()})
            own["pages"].add(k)
            shape = [c[0] for c in kids]
            own["shapes"].add((k, tuple(c for i, c in enumerate(shape) if i == 0 or c != shape[i - 1])))
            if text:
                own["texts"].add((k, text))
            walk(kids, (*path, label), k)

    for k, page in enumerate(pages):
        walk(page, (), k)

    def value(path):
        own = seen[path]
        m = len(own["pages"])
        shapes, texts = Counter(s for _, s in own["shapes"]), Counter(x for _, x in own["texts"])
        content = 1 - sum(n * math.log(n, m) for n in texts.values()) / texts.total() if m > 1 and texts else 1.0
        parts = [(len(seen[c]["pages"]), value(c)) for c in seen if len(c) == len(path) + 1 and c[:-1] == path]
        below = [*parts, *([(texts.total(), content)] if texts else [])]
        mean = sum(w * v for w, v in below) / sum(w for w, _ in below) if below else 1.0
        if not parts:
            return mean
        share = [n / shapes.total() for n in shapes.values()]
        looks = min(1.0, -sum(p * math.log(p, m) for p in share)) if m > 1 else 1.0
        return (1 - op2.DAMPING ** len(shapes)) * looks + op2.DAMPING ** len(shapes) * mean

    low = {p for p in seen if len(seen[p]["pages"]) >= op2.MIN_PAGES and value(p) < op2.LOW}

    def texts(nodes, path, strict):
        for label, text, kids in nodes:
            if not strict or (*path, label) not in low:
                yield from [text] if text else []
                yield from texts(kids, (*path, label), strict)

    return [" ".join([*texts(p, (), True)] or texts(p, (), False)) for p in pages], low


@pytest.mark.parametrize("shuffled", [False, True])
def test_style_tree_is_that_of_brute_force_entropies(spark, monkeypatch, shuffled):
    """Neutral names and no article: the sites' trees alone decide, and each host's for itself."""
    rng = random.Random(5)

    def node(site, depth):
        label = rng.choice("abcdef")
        text = rng.choice(["", f"set {site} {label}", f"set {site} {label}", prose(rng.randrange(10**6), 6)])
        return (f"div.x{label}", text, [node(site, depth + 1) for _ in range(rng.randrange(4 if depth < 4 else 1))])

    def written(nodes):
        return "".join(f"<div class='{label[4:]}'>{text}{written(kids)}</div>" for label, text, kids in nodes)

    hosts = {h: [[("div.xtop", f"Welcome to {h}", []), node(h, 1), node(h, 1), ("div.xend", "", [("div.xa", "Same on all", [])])] for _ in range(n)] for h, n in (("m.example", 40), ("n.example", 9), ("o.example", 4))}
    if shuffled:
        monkeypatch.setattr(op2, "LOW_BROADCAST", -1)
    rows, want = [], {}
    for h, pages in hosts.items():
        kept, low = brute_site(pages)
        assert bool(low) == (len(pages) >= op2.MIN_PAGES)
        for page, text in zip(pages, kept, strict=True):
            want[len(rows)] = text
            rows.append((len(rows), f"https://{h}/{len(rows)}", written(page)))
    got = {r.page_id: r.text for r in op2.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    assert any("Welcome" in x for x in got.values()) and not any("Welcome to m.example" in x for x in got.values())


def test_style_tree_of_deep_pages(spark):
    rows = [(i, "https://e.example/", "<div>" * 300 + prose(i, 9) + "</div><p>" + prose(i + 50, 5)) for i in range(6)]
    rows += [(9, "https://e.example/", "<div class=z>" * 300 + "end")]
    got = {r.page_id: r.text for r in op2.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{prose(i, 9)} {prose(i + 50, 5)}" for i in range(6)} | {9: "end"}


def brute_classes(rows):
    bags = {}
    for k, (_, t, *_x) in enumerate(rows):
        w = (t or "").encode().lower().split()
        bags[k] = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = sum((bags[a] & bags[b]).values())
            if both and both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                parent[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    return sorted(sorted(g, key=str) for g in groups.values())


def test_bagminhash_classes(spark, odd, empty):
    rows = [(i, prose(i, 80), "en", "a") for i in range(30)]
    r = random.Random(0)
    for i in range(30, 130):  # near copies of five texts, edited more and more
        w = prose(i % 5, 80).split()
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "a"))
    rows += [(200, "x y", "en", "a"), (201, "X  y", "en", "a"), (202, "", "en", "a"), (203, None, "en", "a")]
    got = {}
    for row in op3.near_duplicates(table(spark, rows)).collect():
        got.setdefault(row.class_id, []).append(row.doc_id)
    assert sorted(sorted(g, key=str) for g in got.values()) == brute_classes(rows)
    assert op3.near_duplicates(odd).count() == odd.count()
    assert {r.class_id for r in op3.near_duplicates(odd).where("doc_id in (1, 2, 3)").collect()} == {1}
    assert op3.near_duplicates(empty).count() == 0
    assert op3.near_duplicates(odd.withColumn("node", F.lit(1)).withColumn("keys", F.lit(2)).withColumn("text_key", F.lit(3))).count() == odd.count()


def test_bagminhash_loses_no_link(spark):
    """All pairs of many edits around the threshold."""
    r = random.Random(4)
    rows = []
    for base in range(12):
        for _ in range(25):
            w = prose(base, 60 + 20 * (base % 3)).split()
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w), "en", "a"))
    got = {}
    for row in op3.near_duplicates(table(spark, rows)).collect():
        got.setdefault(row.class_id, []).append(row.doc_id)
    assert sorted(sorted(g, key=str) for g in got.values()) == brute_classes(rows)


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(0)
    off = []
    for q in range(30):
        a = rng.integers(0, 120, 200).tolist()
        b = a[: int(200 * rng.random())] + rng.integers(0, 120, 60).tolist()
        doc, h, n = zip(*[(k, x * 7919 + q, c) for k, d in enumerate((a, b)) for x, c in Counter(d).items()])
        s = op3.signatures(np.array(doc), op3.mix(np.array(h, np.uint64)), np.array(n), 2, m=1000)
        both = sum((Counter(a) & Counter(b)).values())
        off.append((s[0] == s[1]).mean() - both / (len(a) + len(b) - both))
    assert abs(np.mean(off)) < 0.012


def test_toxicity(spark, odd, empty):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, prose(i, 40) + (" vequ" + r.choice("abcdef") + "x moron vequ" + r.choice("abcdef") if bad else ""), "en", "a"))
        labels.append((i, 1, int(bad)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = op4.toxicity(table(spark, rows), lab, crc_mod("doc_id", 4) != 2)[0].collect()
    assert len(got) == 400 and all(0 <= g.score <= 1 for g in got)
    held = [g for g in got if g.held_out]
    assert {g.doc_id for g in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(g.predicted == int(g.doc_id % 5 == 0) for g in held) / len(held) > 0.97
    assert op4.toxicity(odd, lab.limit(0), crc_mod("doc_id", 4) != 2)[0].count() == odd.count()
    assert op4.toxicity(empty, lab, crc_mod("doc_id", 4) != 2)[0].count() == 0
    clashing = table(spark, rows).withColumn("label_id", F.lit(1)).withColumn("h", F.lit(2)).withColumn("toxic", F.lit(1)).withColumn("n_words", F.lit(0))
    again = op4.toxicity(clashing, lab, crc_mod("doc_id", 4) != 2)[0].collect()
    assert sorted(again) == sorted(got)


def brute_em(rows, prior, parent, rounds):
    """The label model row by row, with plain loops."""
    v = len(rows[0])
    q = [0.9 if r.count(2) > r.count(1) else 0.02 for r in rows]
    for _ in range(rounds):
        logs = []
        for c in (0, 1):
            w = [x if c else 1 - x for x in q]
            size = sum(w)
            theta = [[(sum(a for a, r in zip(w, rows) if r[j] == k) + 0.5) / (size + 1.5) for k in range(3)] for j in range(v)]
            col = [0.0] * len(rows)
            for j in range(v):
                for i, r in enumerate(rows):
                    if parent[j] < 0:
                        p = theta[j][r[j]]
                    else:
                        same = sum(a for a, s in zip(w, rows) if s[parent[j]] == r[parent[j]])
                        both = sum(a for a, s in zip(w, rows) if s[parent[j]] == r[parent[j]] and s[j] == r[j])
                        p = (both + 5 * theta[j][r[j]]) / (same + 5)
                    col[i] += math.log(p)
            logs.append(col)
        q = [1 / (1 + math.exp(-max(-30, min(30, b - a + math.log(prior / (1 - prior)))))) for a, b in zip(*logs)]
    return q


def test_label_model_against_brute_force():
    r = random.Random(5)
    rows = []
    for i in range(300):
        toxic = i % 4 == 0
        a, b, c, d = ((2 if r.random() < (0.8 if toxic else 0.03 * k) else 0) for k in (1, 2, 3, 4))
        rows.append((a, a if r.random() < 0.95 else 0, b, c, d, 1 if not (a or b or c) else 0))
    kinds = Counter(rows)
    patterns = np.array(sorted(kinds))
    n = np.array([kinds[tuple(p)] for p in patterns], float)
    for rounds in (1, 5, 11, 14):
        q, theta, parent = op4.label_model(patterns, n, 0.25, rounds)
        # the tree changes after ten rounds only; before, all voters are on their own
        before = brute_em(rows, 0.25, [-1] * 6, min(rounds, 10))
        if rounds <= 10:
            want = before
            assert parent == [-1] * 6
            assert np.allclose([q[[tuple(p) for p in patterns].index(x)] for x in rows], want)
    assert parent[1] == 0 or parent[0] == 1  # the voter that repeats another hangs on it
    truth = np.array([i % 4 == 0 for i in range(300)])
    found = np.array([q[[tuple(p) for p in patterns].index(x)] for x in rows]) > 0.5
    assert (found == truth).mean() > 0.8  # "nothing" is a voter, so a lone vote in error weighs much here


def test_tree_is_the_heaviest():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, (4000, 4))
    x[:, 2] = np.where(rng.random(4000) < 0.9, x[:, 0], x[:, 2])
    x[:, 3] = np.where(rng.random(4000) < 0.7, x[:, 2], x[:, 3])
    one = np.eye(3)[x]
    joint = np.einsum("pik,pjl->ijkl", one, one)[None] / 4000
    parent = op4.spanning_tree(joint, np.array([1.0]))
    edges = {frozenset((i, p)) for i, p in enumerate(parent) if p >= 0}
    assert edges == {frozenset((0, 2)), frozenset((2, 3))}


def test_toxicity_lexicon_has_no_cap(spark, monkeypatch):
    # 4,000 words of nine letters, each in five toxic documents; those that a clean one has as well have odds under 2
    size = (4000 - sum(i % 3 > 0 for i in range(50, 150))) * (1 + len(op4.PREFIXES))
    name = lambda k: "".join(chr(97 + k // 26**j % 26) for j in (0, 1, 2)) + "qwzxyv"
    rows = [(i, " ".join(name(k) for k in range(i // 5 * 400, i // 5 * 400 + 400)), "en", "a") for i in range(50)]
    rows += [(i, prose(i, 40) + f" {name(i)}" * (i % 3), "en", "a") for i in range(50, 150)] + [(7, "moron!", "en", "a"), (None, None, None, None)]
    lab = spark.createDataFrame([(i, 1, int(i < 50)) for i in range(150)], "doc_id long, quality int, toxic int")
    docs, train = table(spark, rows), F.lit(True)
    few, learned = op4.toxicity(docs, lab, train)
    assert sum(len(learned["lexicon"][k][0]) for k in range(len(op4.PREFIXES) + 1)) == size > 20_000
    monkeypatch.setattr(op4, "BROADCAST_ENTRIES", 10)
    joined, learned = op4.toxicity(docs, lab, train)
    assert learned["lexicon"]["entries"].count() == size
    order = lambda d: sorted(d.collect(), key=str)
    assert len(order(few)) == len(rows) and order(few) == order(joined)


def test_mixing(spark, odd, empty):
    rows = [(i, prose(i, 5 + i % 50), "en", f"s{i % 7}" if i % 11 else None) for i in range(500)]
    out = op5.mixed(table(spark, rows), block=64)[0].collect()
    by, target, taken = Counter(), {}, Counter()
    name = {i: s for i, _, _, s in rows}
    for r in out:
        s = name[r.doc_id]
        by[s] += r.size
        target[s] = r.target
        taken[s] += r.taken
        assert r.taken <= 3 * r.size and r.size == len(dict((a, b) for a, b, *_ in rows)[r.doc_id].split())
    order = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, level, free = sum(by.values()), 0.0, set(by)
    want = {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * by[s]}
        if not full:
            want |= {s: level * weight[s] for s in free}
            break
        for s in full:
            want[s] = 3.0 * by[s]
            left -= want[s]
        free -= full
    for s in by:
        assert math.isclose(target[s], want[s]) and taken[s] == math.floor(want[s])
    assert sorted(out) == sorted(op5.mixed(table(spark, rows).repartition(5), block=64)[0].collect())
    assert op5.mixed(odd)[0].count() == odd.count()
    equal = table(spark, [(None, prose(k, 20), "en", "a") for k in range(300)] + [(5, prose(1, 9), "en", "b")] * 40 + [(None, None, None, None)] * 20)
    got = op5.mixed(equal.withColumn("src", F.lit(1)).withColumn("key", F.lit(2)).withColumn("size", F.lit(3)), block=64)[0].collect()
    assert len(got) == 360 and sum(x.taken for x in got if x.source == "a") == math.floor(max(x.target for x in got if x.source == "a"))
    assert op5.mixed(empty)[0].count() == 0


def test_low_discrepancy(spark):
    sources = spark.createDataFrame([("a", 0, 10**6, 5e5), ("b", 1, 10**6, 3e5), ("c", 2, 10**6, 2e5)], "source string, src int, source_size long, target double")
    slots = [r.src for r in op5.schedule(sources, 1000).orderBy("position").collect()]
    assert Counter(slots) == {0: 500, 1: 300, 2: 200}
    for n in range(50, 1000, 50):
        assert abs(slots[:n].count(0) / n - 0.5) < 8 / n + 0.01


def brute_quality(t):
    w = [x for x in (t or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if x]
    at = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {p for i in range(len(w) - 4) if at[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if line.strip(" \t\n\v\f\r"):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit)


def test_quality(spark, odd, empty):
    texts = ["a b c d e a b c d e a b", "x\nx\n\nx y\nx", "#$ %& ok", "é ü z a b c d e f g h", None, "", prose(1, 50)]
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).unionByName(odd).withColumn("measures", F.lit(1)).withColumn("_w", F.lit(2))
    got = op6.judged(docs).select("text", "quality.*").collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert op6.passing(docs).columns == docs.columns
    assert op6.passing(docs).count() == sum(r.kept for r in got)
    assert op6.judged(empty).count() == 0


def test_crf(spark, odd, empty):
    r = random.Random(1)
    word = {"xx": lambda: "ka" + r.choice(["zu", "ze", "zi"]) + r.choice(["ko", "ki"]), "yy": lambda: "ble" + r.choice(["non", "nen"]) + r.choice(["ar", "er"])}
    rows = [(i, " ".join(word["xx" if i % 2 else "yy"]() for _ in range(20)) + ".", "xx" if i % 2 else "yy", "a") for i in range(60)]
    docs = table(spark, rows)
    model = op7.learn(docs, crc_mod("doc_id", 3) != 1)
    got = op7.predict(docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "text"), model).collect()
    assert all(g.lang_pred == ("xx" if g.doc_id % 2 else "yy") for g in got)
    import pyarrow as pa

    both = " ".join(word["xx"]() for _ in range(6)) + ". " + " ".join(word["yy"]() for _ in range(6)) + "."
    post, _, _ = op7.labelled(pa.array([both.encode()]), model)
    assert (post.argmax(axis=1) == [0] * 6 + [1] * 6).all()
    named = odd.select("doc_id", F.lit(False).alias("held_out"), "text")
    got = op7.predict(named, model).collect()
    assert len(got) == odd.count() and {g.lang_pred for g in got if g.doc_id in (4, 5, 6, 11)} == {"und"}
    assert op7.predict(named, op7.learn(empty, F.lit(True))).where("lang_pred != 'und'").count() == 0
    assert op7.predict(named.limit(0), model).count() == 0
    clashing = named.withColumn("letters", F.lit(1)).withColumn("lang_pred", F.lit("q")).withColumn("score", F.lit(9.0))
    assert sorted(map(str, op7.predict(clashing, model).collect())) == sorted(map(str, op7.predict(named, model).collect()))


def test_crf_long_sequences_are_not_cut(monkeypatch):
    """Words without any stop: posteriors and expected transitions don't depend on the pieces they are computed in."""
    rng = np.random.default_rng(3)
    e, trans = rng.normal(size=(200, 3)) * 2, rng.normal(size=(3, 3))
    begins = np.zeros(200, bool)
    begins[[0, 5, 90, 91]] = True
    whole = op7.forward_backward(e, np.cumsum(begins) - 1, trans)
    for piece in (1, 2, 7, 48):
        pos = np.arange(200) - np.maximum.accumulate(np.where(begins, np.arange(200), 0))
        cut = begins | (pos % piece == 0)
        got = op7.forward_backward(e, np.cumsum(cut) - 1, trans, ~begins[cut])
        assert np.allclose(got[0], whole[0]) and np.allclose(got[1], whole[1])
    import pyarrow as pa

    model = (["xx", "yy"], rng.normal(size=(op7.SLOTS, 2)), rng.normal(size=(2, 2)))
    text = pa.array([("ka zu " * 300).encode(), b"", (prose(1, 500) + ". " + prose(2, 7)).encode()])
    want = op7.labelled(text, model)[0]
    monkeypatch.setattr(op7, "PIECE", 10_000)
    assert np.allclose(op7.labelled(text, model)[0], want)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    e, trans, seq = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), np.array([0, 0, 0, 0, 1, 2, 2, 2, 2])
    post, _ = op7.forward_backward(e, seq, trans)
    import itertools

    for s in (0, 1, 2):
        at = np.flatnonzero(seq == s)
        want = np.zeros((len(at), 3))
        for path in itertools.product(range(3), repeat=len(at)):
            p = math.exp(sum(e[a, y] for a, y in zip(at, path)) + sum(trans[a, b] for a, b in itertools.pairwise(path)))
            for i, y in enumerate(path):
                want[i, y] += p
        assert np.allclose(post[at], want / want.sum(axis=1, keepdims=True))


@pytest.mark.parametrize("n,top", [(1, 5), (10, 12), (5000, 10**7), (3000, 2**63), (3, 2**64 - 1), (0, 1)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, top, n, np.uint64))
    s = ef.Sequence(ef.build(v, "a", ones=True), "a")
    assert (s.find(v) == np.arange(len(v))).all() and (s.get(np.arange(len(v))) == v).all()
    q = rng.integers(0, top, 500, np.uint64)
    assert ((s.find(q) >= 0) == np.isin(q, v)).all()


def exact_lm(rows):
    """(tokens, known ones, N, base score, score) of each text, with all pairs and triples of the training rows."""
    tok = lambda t: [*(t or "").encode().lower().split(), b"\0end"]
    grams, after = Counter(), {}
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            k = tok(t)
            grams.update(tuple(k[j : j + n]) for n in (1, 2, 3) for j in range(len(k) - n + 1))
    v = [g for g in grams if len(g) == 1]
    size = sum(grams[g] for g in v)
    for g in grams:
        after.setdefault(g[:-1], []).append(grams[g])

    def p(g):
        if len(g) == 1:
            return (grams[g] + 0.1) / (size + 0.1 * (len(v) + 1))
        if not grams[g[:-1]]:
            return p(g[1:])
        return max(0.0, grams[g] - 0.75) / grams[g[:-1]] + (1 - sum(x - 0.75 for x in after.get(g[:-1], ())) / grams[g[:-1]]) * p(g[1:])

    out = {}
    for _, t in rows:
        k = tok(t)
        out[t] = (len(k), sum(grams[w,] > 0 for w in k), size, sum(math.log10(p((w,))) for w in k), sum(math.log10(p(tuple(k[max(0, j - 2) : j + 1]))) for j in range(len(k))))
    return out


def test_ngram_trie(spark, odd, empty):
    rows = [(i, prose(i % 17, 25), "en", "a") for i in range(60)] + [(100, "never seen words", "en", "a"), (101, None, None, None), (102, "", "en", "a")]
    rows += [(200 + i, f"alpha beta w{i % 19} alpha beta x{i % 7} unseen{i}", "en", "a") for i in range(60)]
    text = lambda df: as_bytes(df.withColumn("held_out", crc_mod("doc_id", 10) == 0), "doc_id", "held_out")
    docs = text(table(spark, rows))
    want = exact_lm([r[:2] for r in rows])
    for size in (64 << 20, 2000, 300):  # one shard, several, and frequent words and pairs cut apart
        metas = op8.train(docs.where("not held_out").select("text"), size)
        assert size > 300 or all(m["cut_ids"] for m in metas[1:])
        got = op8.score(docs, metas).collect()
        for g in got:
            w = want[dict((a, b) for a, b, *_ in rows)[g.doc_id]]
            assert (g.n_tokens, g.n_known, g.train_tokens) == w[:3]
            assert math.isclose(g.base_score, w[3], abs_tol=1e-9) and abs(g.score - w[4]) <= 0.04 * g.n_tokens
    none = text(empty)
    assert op8.score(none, op8.train(none.select("text"))).count() == 0
    assert op8.score(text(odd), op8.train(none.select("text"))).count() == odd.count()


def test_ngram_trie_query_keeps_what_is_seen_once(spark, tmp_path):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    kept = [i for i in range(200) if i not in held]
    rows = [(i, f"{prose(i, 20)} left{i} middle{i} right{i} {prose(-i - 1, 5)}") for i in kept[:25]]
    # words and pairs of the first are all seen once; the second has the same words in another order
    rows += [(held[0], f"left{kept[0]} middle{kept[0]} right{kept[0]}"), (held[1], f"right{kept[0]} left{kept[0]} middle{kept[1]}"), (held[2], rows[0][1])]
    table(spark, [(*r, "en", "a") for r in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op8.query(spark, str(tmp_path)).collect()}
    want = exact_lm(rows)
    assert len(got) == len(rows)
    for i, t in rows:
        assert abs(got[i].score - want[t][4]) <= 0.04 * got[i].n_tokens
    assert got[held[0]].score > got[held[1]].score + 1


@pytest.mark.parametrize("top", [3, 300, 10**6, 2**63])
def test_runs_of_keys(top):
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, top, 500, np.uint64))
    n = rng.integers(1, 400, len(keys))
    back = op8.unpacked(op8.packed(keys, n))
    assert (back[0] == keys).all() and (back[1] == n).all()
    one = op8.unpacked(op8.packed(keys[:1], n[:1]))
    assert one[0].tolist() == keys[:1].tolist() and one[1].tolist() == n[:1].tolist()


def test_trie_without_a_common_mount(spark, monkeypatch):
    """Shards handed out by Spark, as on an object store."""
    rows = [(i, prose(i % 7, 15), "en", "a") for i in range(30)]
    docs = as_bytes(table(spark, rows).withColumn("held_out", crc_mod("doc_id", 10) == 0), "doc_id", "held_out")
    own = op8.shared_folder
    monkeypatch.setattr(op8, "shared_folder", lambda s, name: own(s, name) | {"mounted": False})
    got = op8.score(docs, op8.train(docs.where("not held_out").select("text"), 2000)).collect()
    want = exact_lm([r[:2] for r in rows])
    assert all(abs(g.score - want[dict((a, b) for a, b, *_ in rows)[g.doc_id]][4]) <= 0.04 * g.n_tokens for g in got)


def test_shards(spark, odd, empty):
    docs = table(spark, [(i, prose(i, i % 60), "en", "a") for i in range(500)]).unionByName(odd).withColumn("b", F.lit(1)).withColumn("shard", F.lit(9))
    out = op9.shuffle_shards(docs, bucket_bytes=20_000)
    got = op9.digest(out).collect()
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(str((r.doc_id, r.text)) for r in docs.collect())
    per = Counter(r.shard for r in got)
    assert set(per) <= set(range(24)) and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(per[s]))
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and r.size >= 8
    again = op9.digest(op9.shuffle_shards(docs.repartition(7), bucket_bytes=20_000)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert op9.shuffle_shards(empty).count() == 0


def test_shards_split_equal_rows(spark):
    """Half of all rows are equal; buckets stay small, and all rows are there."""
    rows = [(None, "the same text " * 20, "en", "a")] * 2000 + [(i, prose(i, 30), "en", "a") for i in range(2000)]
    docs = table(spark, rows).repartition(6)
    out = op9.shuffle_shards(docs.withColumn("_place", F.lit(1)).withColumn("b", F.lit(2)), bucket_bytes=20_000)
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, *_ in rows)
    per = Counter(r.shard for r in got)
    assert max(per.values()) - min(per.values()) <= 1
    same = Counter(r.shard for r in got if r.doc_id is None)
    assert min(same.values()) > 40  # spread over all shards, not in one
    again = op9.digest(op9.shuffle_shards(docs.repartition(3), bucket_bytes=20_000)).collect()
    assert Counter(op9.digest(out).collect()) == Counter(again)


def test_shards_against_brute_force(spark):
    """The order is that of buckets of hashes; within a bucket it is Spark's seeded shuffle of the rows in order."""
    rows = [(i, prose(i, i % 40), "en", "a") for i in range(300)]
    docs = table(spark, rows)
    out = op9.shuffle_shards(docs, shards=7, bucket_bytes=3_000)
    draw = F.xxhash64(F.lit(op9.SEED), F.col("doc_id"), F.crc32(F.col("text").cast("binary")))
    size = sum(len(t.encode()) + 8 for _, t, *_ in rows)
    buckets = math.ceil(size / 3_000)
    placed = {r.doc_id: (r.d % op9.LEAST_CELLS) * buckets // op9.LEAST_CELLS for r in docs.select("doc_id", draw.alias("d")).collect()}
    order = sorted(out.collect(), key=lambda r: (r.shard, r.slot))
    assert [placed[r.doc_id] for r in order] == sorted(placed.values())
    assert [r.shard for r in order] == [p * 7 // 300 for p in range(300)]
    inside = [[r.doc_id for r in order if placed[r.doc_id] == b] for b in range(buckets)]
    assert sum(x == sorted(x) for x in inside) < buckets / 2  # shuffled


def brute_lines(rows):
    key = lambda x: x.strip(b" \t\n\v\f\r").lower()
    holders: dict = {}
    for n, (i, t) in enumerate(rows):
        for line in set(map(key, (t or "").encode().split(b"\n"))):
            if len(line.decode()) >= 20:
                holders.setdefault(line, []).append((-math.inf if i is None else i, n))
    out = []
    for i, t in rows:
        lines = (t or "").encode().split(b"\n")
        own = -math.inf if i is None else i
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and own < max(holders[key(x)])[0])]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup(spark, odd, empty):
    r = random.Random(2)
    shared = [f"This line number {k} is shared é" for k in range(5)] + ["short line é"]
    rows = [(i, "\n".join(r.choice([*shared, prose(r.randrange(10**6), 6), " " + shared[0].upper() + "\t", ""]) for _ in range(8))) for i in range(80)]
    docs = table(spark, [(i, t, "en", "a") for i, t in rows]).unionByName(odd)
    got = op10.dedup_lines(docs).collect()
    want = brute_lines([(x.doc_id, x.text) for x in docs.collect()])
    assert sorted(((g.doc_id, g.n_lines, g.n_dropped, g.kept_sha256) for g in got), key=str) == want
    assert all(hashlib.sha256(bytes(g.kept_text)).hexdigest() == g.kept_sha256 for g in got)
    assert op10.dedup_lines(empty).count() == 0
    clashing = docs.withColumn("text_key", F.lit(1)).withColumn("batch", F.lit(2)).withColumn("gone", F.lit(3)).withColumn("hi", F.lit(4))
    assert sorted(map(str, op10.dedup_lines(clashing).collect())) == sorted(map(str, got))


def test_line_dedup_tells_rows_with_one_id_apart(spark):
    line = "a line that many documents share"
    rows = [(None, f"{line}\nfirst {i} of those without an id") for i in range(5)] + [(7, f"{line}\nx{i}") for i in range(3)] + [(3, line), (3, line), (3, "another line that stays here")]
    got = op10.dedup_lines(table(spark, [(i, t, "en", "a") for i, t in rows])).collect()
    assert sorted(((g.doc_id, g.n_lines, g.n_dropped, g.kept_sha256) for g in got), key=str) == brute_lines(rows)


@pytest.mark.parametrize("heavy", [1, 5, 60])
def test_line_dedup_sends_common_lines_to_their_rows(spark, monkeypatch, heavy):
    monkeypatch.setattr(op10, "HEAVY", heavy)
    r = random.Random(heavy)
    lines = ["the line on every second page", *(f"a line shared by some pages {k}" for k in range(12))]
    rows = [(i if i % 9 else None, "\n".join([lines[0]] * (i % 2) + [r.choice(lines) for _ in range(4)] + [f"own line of the page {i}"])) for i in range(60)]
    got = op10.dedup_lines(table(spark, [(i, t, "en", "a") for i, t in rows])).collect()
    assert sorted(((g.doc_id, g.n_lines, g.n_dropped, g.kept_sha256) for g in got), key=str) == brute_lines(rows)


def test_line_runs_keep_levels(spark):
    store = op10.LineRuns(spark, fanout=2)
    for b in range(5):
        store.add(spark.createDataFrame([(1, 1, b), (2, b, b)], "hi long, lo long, doc_id long"))
    assert [len(x) for x in store.levels] == [1, 0, 1]
    assert {(r.hi, r.lo): (r.n_docs, r.last_doc) for r in store.rows().collect()}[1, 1] == (5, 4)
    assert store.add(spark.createDataFrame([(1, 1, 9), (5, 5, 9), (6, 6, 9), (6, 6, 8)], "hi long, lo long, doc_id long")).orderBy("hi").collect() == [(1, 1), (6, 6)]


def test_line_runs_merge_without_an_exchange(spark):
    store = op10.LineRuns(spark, fanout=9)
    for b in range(2):
        store.add(spark.createDataFrame([(k, b, k) for k in range(50)], "hi long, lo long, doc_id long"))
    plan = store.rows()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "Exchange" not in plan
