"""The ten operators against brute force, round trips and held-out accuracy, and on awkward tables."""

import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellscope.llm import html_text, langid, mixing, packing, periodic, pii, quality_model, quality_rules, queries, simhash, substrings, topk, url_filters
from cellscope.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("size", "fp", "key", "n", "target", "__id", "__hash", "__n", "q_kept", "component_id", "spans", "score", "host", "__rate", "row", "copies")


def words(n, seed, k=40):
    r = random.Random(seed)
    return [r.choice("abcdefghij") + str(r.randrange(k)) + r.choice("xyz") for _ in range(n)]


def awkward_rows():
    long = " ".join(words(30_000, 1, 5000))
    text = " ".join(words(200, 2, 900)) + "."
    near = text.replace(text.split()[50], "changed", 1)
    rows = [(1, text), (2, text), (3, near), (4, None), (5, ""), (6, "  \n\t "), (7, long), (8, "one"), (8, "one"), (None, "null id text"), (9, "é" * 50_000), (10, "a b c " * 200)]
    return [(i, t, None if (i or 0) % 3 == 0 else "en", None if i in (2, 9) else f"s{(i or 0) % 2}", None) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


OPERATORS = {
    "simhash": simhash.simhash_components,
    "near_dedup": simhash.near_dedup,
    "mix_digest": mixing.mix_digest,
    "mix": mixing.mix,
    "judged": quality_rules.judged,
    "filtered": quality_rules.filtered,
    "pii": pii.find,
    "masked": pii.masked,
    "packing": lambda d: packing.pack(d, queries.tokenizer_path()),
    "langid": lambda d: langid.predict(d, None),
    "substrings": substrings.digest,
    "deduplicated": substrings.deduplicated,
    "periodic": periodic.periodic_runs,
    "collapse": periodic.collapse,
    "quality_model": lambda d: quality_model.predict(d, quality_model.SubwordClassifier()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_tables(name, docs, empty):
    """Nulls, empty and very long texts, repeats, clashing columns and empty tables have defined results."""
    run = OPERATORS[name]
    plain = run(docs)
    more = run(docs.withColumns({n: F.lit(1) for n in CLASHES})) if name not in ("judged",) else run(docs.withColumn("size", F.lit(1)))
    common = [c for c in plain.columns if c != "sequence_id" and c in more.columns]
    assert rows(plain.select(*common), *common) == rows(more.select(*common), *common)
    assert run(empty).count() == 0
    if name in ("near_dedup", "mix", "filtered", "masked"):
        assert plain.columns == docs.columns
        assert more.columns == [*docs.columns, *CLASHES]
    elif name != "packing":
        assert plain.count() == docs.count()


# --- 1 exact top-k


def brute_topk(vectors, k):
    best = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(64 * x) for x in v]
            best[i] = min(best.get(i, w), w)
    out = []
    for q in (i for i in best if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(best[q], best[i], strict=True)), i) for i in best if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_topk_equals_brute_force(spark, monkeypatch):
    r = random.Random(4)
    vectors = [(i, [round(r.uniform(-1, 1), 2) for _ in range(7)]) for i in range(150)]
    vectors += [(i, [0.5] * 7) for i in range(150, 220)]  # ties of one very common vector
    vectors += [(220, None), (221, [None] * 7), (222, [float("nan")] * 7), (223, [float("inf")] * 7), (None, [0.1] * 7), (3, [0.9] * 7)]
    for query, row, strip, sample in ((4096, 8192, 64, 4096), (4, 50, 2, 30)):
        monkeypatch.setattr(topk, "QUERY_BLOCK", query)
        monkeypatch.setattr(topk, "ROWS", row)
        monkeypatch.setattr(topk, "STRIP", strip)
        monkeypatch.setattr(topk, "SAMPLE_ROWS", sample)
        v = topk.integer_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("v", F.lit(0)))
        found = topk.topk(v.filter("vec_id % 20 = 0"), v, 20)
        assert rows(found, "query_id", "rank", "vec_id", "score") == sorted(brute_topk(vectors, 20), key=str)


def test_topk_small_and_empty(spark):
    kind = "vec_id long, embedding array<float>"
    v = topk.integer_vectors(spark.createDataFrame([(0, [1.0]), (20, [1.0]), (7, [-2.0])], kind))
    assert rows(topk.topk(v.filter("vec_id % 20 = 0"), v, 20), "query_id", "rank", "vec_id", "score") == [(0, 1, 20, 4096), (0, 2, 7, -8192), (20, 1, 0, 4096), (20, 2, 7, -8192)]
    v = topk.integer_vectors(spark.createDataFrame([], kind))
    assert topk.topk(v, v, 20).count() == 0


def test_topk_resolves_few_scores():
    """With a safe cutoff most pairs get no full score, and the answer is that of all pairs."""
    r = np.random.default_rng(3)
    rows_, ids = r.integers(-40, 41, (3000, 64)).astype(float), np.arange(3000)
    queries_, qid = rows_[::100], ids[::100]
    cut, best = np.full(30, -np.inf), topk.Best(20)
    best.add(topk.gathered(qid, queries_, ids[:600], rows_[:600], 20), cut)
    assert np.isfinite(cut).all()
    pairs = 0
    for i, j, exact in topk.resolved(qid, queries_, cut, ids, rows_):
        pairs += len(i)
        assert (exact == (queries_[i] * rows_[j]).sum(axis=1)).all()
    assert pairs < 0.1 * 30 * 3000
    found = topk.Best(20)
    found.add(topk.resolved(qid, queries_, cut, ids, rows_), cut.copy())
    for n in range(30):
        score = queries_[n] @ rows_.T
        expect = sorted((-score[i], i) for i in range(3000) if i != qid[n])[:20]
        mine = sorted((-s, i) for a, i, s in zip(found.at, found.row, found.score, strict=True) if a == n)
        assert mine == expect


def test_topk_holds_few_of_many_ties():
    """Rows that all tie with the cutoff pass k at a time, the smallest ids first."""
    rows_, ids = np.ones((4000, 8)), np.arange(4000)
    cut = np.full(300, 8.0)
    sizes = []
    best = topk.Best(20)
    for at, row, score in topk.resolved(ids[:300], rows_[:300], cut, ids, rows_, 20):
        sizes.append(len(at))
        best.add(iter([(at, row, score)]), cut)
    assert max(sizes) <= topk.STRIP * 20
    assert [r for a, r in zip(best.at.tolist(), best.row.tolist(), strict=True) if a == 5] == [i for i in range(21) if i != 5]


# --- ids stay out of Python

LARGE = 2**53


def id_rows(kind):
    texts = [" ".join(words(120, 300 + i, 900)) for i in range(3)]
    ids = [LARGE + 1, LARGE + 5, None] if kind == "long" else ["a", "b/é", None]
    return [(i, t, "en", "s", None) for i, t in zip(ids, texts, strict=True)]


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("name", [*(n for n in OPERATORS if n not in ("judged", "mix_digest")), "langid_model", "html"])
def test_ids_come_back_exact(spark, name, kind):
    """Large ids beside a null, and ids of text, are the same afterwards; unrelated documents all stay."""
    df = spark.createDataFrame(id_rows(kind), SCHEMA.replace("doc_id long", f"doc_id {kind}")).coalesce(1)
    if name == "html":
        found = html_text.extract(df.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"))).withColumnRenamed("page_id", "doc_id")
    elif name == "langid_model":
        found = langid.predict(df, langid.ByteGRU(["x", "y"]))
    else:
        found = OPERATORS[name](df)
    assert found.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    assert {r["doc_id"] for r in found.select("doc_id").collect()} == {r[0] for r in id_rows(kind)}


def test_training_takes_any_id_and_no_repeats(spark, monkeypatch):
    """Ids of text can be learned from, and a repeated id is one document of the bounded sample."""
    data = [("same", f"text number {i}", "en") for i in range(500)] + [(f"d{i}", "un autre texte", "fr") for i in range(9)]
    df = spark.createDataFrame(data, "doc_id string, text string, lang string")
    monkeypatch.setattr(langid, "DOCS_PER_LANGUAGE", 5)
    monkeypatch.setattr(langid, "STEPS", 2)
    assert langid.sample(df).groupby("lang").size().to_dict() == {"en": 1, "fr": 5}
    model = quality_model.train(df, df.select("doc_id", F.lit(1).alias("quality")))
    assert 0 <= quality_model.predict(df, model).first()["score"] <= 1


# --- 2 HTML


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain  text", "plain text"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n\n  - c"),
        ("<ol start=3><li>a</li><li>b</li></ol>", "3. a\n4. b"),
        ("<table><tr><th>name<th>n<tr><td>x<td>10<tr><td>longer<td>7</table>", "name    n\nx       10\nlonger  7"),
        ("<table><tr><td colspan=2>wide<td>c<tr><td>a<td>b<td>d</table>", "wide  c\na  b  d"),
        ("a<br>b", "a\nb"),
        ("<pre>\n x\n  y </pre>z", "x\n  y\n\nz".replace("x", " x", 1)),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("<p hidden>no</p><span style='display: none'>no</span>yes<script>var t='</p>'</script><!-- no -->", "yes"),
        ("<head><title>t</title></head><body>b", "b"),
        ("<details><summary>s</summary>closed</details><details open><summary>t</summary>open</details>", "s\nt\nopen"),
        ("a &amp; b &lt;c&gt; &eacute;", "a & b <c> é"),
        ("<a href='x>y'>link</a> 1 < 2", "link 1 < 2"),
        ("<b>bold<p>still</b> here", "bold\n\nstill here"),
        ("</div>stray<img alt='pic'>", "straypic"),
        ("<select><option>a<option>b</select>c", "a c"),
    ],
)
def test_html_cases(html, text):
    assert html_text.html_to_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><tbody><td>a<td>b</table>", "a  b"),
        ("<table><tbody>loose<tr><td>a</table>", "loose\na"),
        ("<table><tbody><form><tr><td>a</tr><td>b</form><tr><td>c</table>d", "a\nb\nc\n\nd"),
        ("<table><tbody><div>x</div><tr><td>a</table>", "x\na"),
        ("<table><colgroup><col><tr><td>a<td>b</table>", "a  b"),
        ("<table><colgroup><col>x<tbody><tr><td>a</table>", "x\na"),
        ("<table><caption>cap<td>a</table>", "cap\na"),
        ("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> b", "a x=2 b"),
        ("<svg><title>no</title><defs><text>no</text></defs><g><text>one</text><text>two</text></g></svg>", "one two"),
        ("<select><option>a<input value=c>b", "a c b"),
    ],
)
def test_html_keeps_visible_text(html, text):
    assert html_text.html_to_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><tr><td rowspan=2>A<td>b1<tr><td>b2<td>c2</table>", "A  b1\n   b2  c2"),
        ("<table><tr><td>a<td rowspan=3>B<td>c<tr><td>d<td>e<tr><td colspan=1>f<td>g</table>", "a  B  c\nd     e\nf     g"),
        ("<style>.no, p#x { display : none } .ghost{visibility:hidden} @media print { .paper { display:none } }</style><p class='a no'>n</p><p id=x>n</p><p class=ghost>n<b style='visibility:visible'>seen</b></p><p class=paper>paper", "seen\n\npaper"),
        ("<div style='visibility:hidden'>n<img alt=n><span style='visibility: visible'>yes</span></div>", "yes"),
        ("<style>.no{display:none}</style><p class=no style='display:block'>shown", "shown"),
        ("<style>p.no{display:none} .yes{display:block} /* .x{display:none} */</style><p class='no yes'>n<p class=x>x<div class=no>d", "x\n\nd"),
        (f"<table><tr><td>{'w' * 90}<td>b<tr><td>a<td>c</table>", f"{'w' * 90}  b\na  c"),
    ],
)
def test_html_layout_and_visibility(html, text):
    assert html_text.html_to_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("x<select><option>a<option selected>b<option selected>c</select>y", "x c y"),
        ("<select><option disabled>pick<option>b</select>", "b"),
        ("<select><optgroup label=g><option disabled>a<option>b</optgroup></select>", "b"),
        ("<select multiple><optgroup label=g><option>a<option>b</optgroup></select>", "g\na\nb"),
        ("p<select size=3><option>a<option>b</select>q", "p\na\nb\nq"),
        ("<select><option label=L>a</select>", "L"),
        ("<select><option style='display:none' selected>a<option>b</select>", "b"),
        ("<select hidden><option>a</select>b", "b"),
        ("<select></select>b", "b"),
        ("<pre>a <select><option>b</select></pre>", "a b"),
    ],
)
def test_html_selects(html, text):
    assert html_text.html_to_text(html) == text


def test_html_row_spans_equal_a_grid():
    """Cells stand where a grid of taken places puts them, and open spans cost no more with every row."""
    r = random.Random(9)
    for _ in range(300):
        rows_ = [[([], r.choice([1, 1, 1, 2, 3]), r.choice([1, 1, 2, 3, 9])) for _ in range(r.randrange(1, 5))] for _ in range(r.randrange(1, 9))]
        taken = set()
        for y, (cells, found) in enumerate(zip(rows_, html_text._placed(rows_), strict=True)):
            at = 0
            for (_, wide, high), (column, span, _) in zip(cells, found, strict=True):
                while (y, at) in taken:
                    at += 1
                assert (column, span) == (at, wide)
                taken |= {(y + i, at + j) for i in range(1, high) for j in range(wide)}
                at += wide
    cells = [[([], 1, 20_000), ([], 1, 1)]] * 30_000
    assert [c[0][0] for c in html_text._placed(cells)][:20_000] == list(range(20_000))


def test_html_layout_is_bounded():
    """No page makes much more text than it has: wide cells beside many rows, spans, lists and quotes in each other."""
    pages = [
        "<table><tr><td>" + "w" * 60_000 + "<td>b" + "<tr><td>a<td>b" * 4000, "<table><tr>" + ("<td>" + "c" * 50) * 1000 + "<tr><td colspan=999>a<td>b" * 2000,
        "<table>" + "<tr><td rowspan=65534 colspan=1000>a" * 2000, "<ul><li>a" * 3000, "<blockquote>a" * 4000, "<table><tr><td>a" * 2000, "<b>" * 4000 + "</i>" * 4000 + "x",
    ]
    for page in pages:
        text = html_text.html_to_text(page)
        assert len(text) < 10 * len(page) + 1000
        assert sum(map(text.count, "abcwx")) >= sum(re.sub("<[^>]*>", "", page).count(c) for c in "abcwx")


def test_html_round_trip():
    """A random tree, written as HTML with end tags left out at random, gives each word once and in order."""
    r = random.Random(9)
    for _ in range(150):
        seen = []

        def node(depth, r=r, seen=seen):
            kind = r.choice(["text", "p", "div", "ul", "table", "b", "hidden"]) if depth < 4 else "text"
            if kind == "text":
                seen.append(f"w{len(seen)}")
                return seen[-1] + " "
            inner = lambda n: "".join(node(depth + 1) for _ in range(n))
            if kind == "p":
                seen.append(f"w{len(seen)}")
                return f"<p>{seen[-1]} " + r.choice(["</p>", ""])
            if kind == "ul":
                return "<ul>" + "".join("<li>" + inner(1) + r.choice(["</li>", ""]) for _ in range(2)) + "</ul>"
            if kind == "table":
                out = "<table>"
                for _ in range(2):
                    out += "<tr>"
                    for _ in range(2):
                        seen.append(f"w{len(seen)}")
                        out += f"<td>{seen[-1]}" + r.choice(["</td>", ""])
                return out + "</table>"
            if kind == "hidden":
                return "<script>if (a < b) { no() }</script><p hidden>no</p>"
            return f"<{kind}>{inner(2)}</{kind}>"

        html = "".join(node(0) for _ in range(4))
        assert re.findall(r"w\d+", html_text.html_to_text(html)) == seen
        assert "no" not in html_text.html_to_text(html)


def test_html_words_equal_a_plain_reading(spark, sf):
    """Over all pages: the words outside head, scripts, styles and comments, each once and in order, by patterns alone."""
    from html import unescape

    found = {r["page_id"]: r["text"] for r in html_text.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        page = re.sub(r"(?is)<!--.*?-->|<head>.*?</head>|<(script|style)\b.*?</\1>", "", r["html"] or "")
        page = re.sub(r"(?i)</?(b|a|i|em)\b[^>]*>", "", page)
        expect = unescape(re.sub("<[^>]*>", " ", page)).split()
        text = re.sub(r"(?m)^- ", "", found[r["page_id"]])
        assert text.split() == expect


def test_html_deep_and_long():
    assert html_text.html_to_text("<div>" * 20_000 + "x") == "x"
    assert html_text.html_to_text("<b " * 30_000 + "x")[-1:] in ("x", "")
    assert len(html_text.html_to_text("<p>word" * 20_000).split()) == 20_000


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (None, None, None), (1, "u", "<p>a")], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    assert rows(html_text.extract(pages), "page_id", "text") == [(1, "a"), (1, "a"), (None, "")]
    assert html_text.extract(pages.limit(0)).count() == 0


# --- 3 SimHash


def brute_fingerprint(text):
    w = [] if text is None else re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(items, linked):
    parent = list(range(len(items)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(items))]


def test_simhash_equals_brute_force(spark, sf):
    base = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(120).collect()
    data = [(r["doc_id"], r["text"]) for r in base] + [(1000, None), (1001, ""), (1002, "A b"), (1003, "a B"), (1004, "Ä b"), (1005, "a\tb\n c d")]
    r = random.Random(3)
    for i in range(60):  # near copies of one text, in chains
        w = data[5][1].split()
        for _ in range(i % 4):
            w[r.randrange(len(w))] = "swap"
        data.append((2000 + i, " ".join(w)))
    found = {x["doc_id"]: x for x in simhash.simhash_components(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    fps = [brute_fingerprint(t) for _, t in data]
    comps = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    for (i, _), fp, c in zip(data, fps, comps, strict=True):
        assert int.from_bytes(found[i]["fp"]) == fp
        members = [data[j][0] for j in range(len(data)) if comps[j] == c]
        assert found[i]["component_id"] == min(members)


@pytest.mark.parametrize("frequent", [4096, 3])
def test_links_lose_nothing(spark, monkeypatch, frequent):
    """Random fingerprints in tight groups: the index links what all pairs would link, long lists included."""
    monkeypatch.setattr(simhash, "FREQUENT", frequent)
    r = random.Random(8)
    fps = {r.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:12]:
        for _ in range(60):
            g = f
            for _ in range(r.randrange(5)):
                g ^= 1 << r.randrange(64)
            fps.add(g)
    fps = sorted(fps)
    df = spark.createDataFrame([(f.to_bytes(8),) for f in fps], "fp binary")
    roots = {bytes(x["node"]): bytes(x["root"]) for x in connected_components(simhash.linked_fingerprints(df, 64, 2)).collect()}
    comps = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    for i, f in enumerate(fps):
        assert roots.get(f.to_bytes(8), f.to_bytes(8)) == min(fps[j].to_bytes(8) for j in range(len(fps)) if comps[j] == comps[i])


def test_tally_counts_shared_bytes():
    r = np.random.default_rng(2)
    a = r.integers(0, 256, (500, 8), np.uint8)
    b = np.where(r.random((500, 8)) < 0.7, a, r.integers(0, 256, (500, 8), np.uint8))
    for least, distance in ((6, 2), (4, 12), (0, 64)):
        expect = [(x == y).sum() >= least and sum((int(c) ^ int(d)).bit_count() for c, d in zip(x, y, strict=True)) <= distance for x, y in zip(a, b, strict=True)]
        assert simhash._near(a, b, least, distance).tolist() == expect


def jaccard(a, b, n=5):
    s = lambda t: {tuple(t.lower().split()[i : i + n]) for i in range(max(1, len(t.split()) - n + 1))}
    x, y = s(a), s(b)
    return len(x & y) / len(x | y)


def test_near_dedup_recall(spark, monkeypatch):
    """Copies of 0.85 and more go, texts of 0.6 and less stay; dealing long lists in tiles changes nothing."""
    r = random.Random(5)
    data, expect = [], []
    for i in range(80):
        t = words(250, 100 + i, 900)
        data.append((i, " ".join(t)))
        expect.append(i)
        for c in range(i % 4):
            u = list(t)
            for _ in range(1 + c):
                u[r.randrange(len(u))] = f"z{r.random()}"
            data.append((1000 + 10 * i + c, " ".join(u)))
            assert jaccard(data[-1][1], " ".join(t)) > 0.85
        u = t[:120] + words(130, 5000 + i, 900)
        data.append((5000 + i, " ".join(u)))
        expect.append(5000 + i)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], SCHEMA)
    kept = {x["doc_id"] for x in simhash.near_dedup(df).collect()}
    assert set(expect) <= kept
    assert len(kept) - len(expect) <= 2
    monkeypatch.setattr(simhash, "TILE", 1)
    assert {x["doc_id"] for x in simhash.near_dedup(df).collect()} == kept


def test_near_dedup_decides_on_shingles(spark):
    """Texts of 0.7 to 0.79 stay, whole groups of them too; a line that fills both texts makes no copies of them."""
    r = random.Random(9)
    data, base = [], [f"w{r.randrange(9000)}" for _ in range(300)]
    for i in range(60):  # all alike but for one block of their own
        data.append((i, " ".join(base[:270] + [f"own{i}x{k}" for k in range(36 + 4 * (i % 2))])))
        assert i == 0 or 0.7 <= jaccard(data[0][1], data[i][1]) < 0.8
    for i in range(2):
        data.append((100 + i, "the same seven words in a line\n" * 300 + " ".join(f"end{i}x{k}" for k in range(20))))
    for i in range(50):  # a large group of true copies
        u = [f"g{k}" for k in range(200)]
        u[i] = "swap"
        data.append((200 + i, " ".join(u)))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], SCHEMA)
    assert sorted(x["doc_id"] for x in simhash.near_dedup(df).collect()) == [*range(60), 100, 101, 200]


def test_near_dedup_compares_all_of_a_crowd(spark):
    """A pair of 0.81 is found although both its texts look as near to 80 others, which are at 0.796 only."""
    data, expect = [], []
    for g in range(0, 12_000, 1000):
        base, own = [f"g{g}w{k}" for k in range(250)], [f"own{g}x{k}" for k in range(28)]
        data += [(g + i, " ".join([*base[:249], f"last{g}x{i}"])) for i in range(80)]
        data += [(g + 100, " ".join(base[:222] + own)), (g + 101, " ".join(base[:222] + own[:3] + [f"other{g}x{k}" for k in range(25)]))]
        assert jaccard(data[-1][1], data[-2][1]) > 0.81 and max(jaccard(data[-i][1], data[-3][1]) for i in (1, 2)) < 0.8
        expect += [g, g + 100]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], SCHEMA)
    assert sorted(x["doc_id"] for x in simhash.near_dedup(df).collect()) == expect


def test_crowd_links_equal_all_pairs(spark, monkeypatch):
    """Variants of one text with more and more changes: all pairs of 0.8 and more with different labels, and only these."""
    r = random.Random(6)
    base = [f"w{r.randrange(9000)}" for _ in range(120)]
    data = []
    for i in range(90):
        u = list(base[: 120 - i % 5])
        for at in r.sample(range(len(u)), i % 7):
            u[at] = f"own{i}x{at}" if i % 2 else f"shared{at}"
        data.append((i, " ".join(u)))
    docs = spark.createDataFrame([*data, (200, None), (201, "a b"), (202, "A  b")], "doc_id long, text string")
    rows = simhash.fingerprints(docs, 5, 512, True)
    fps = {x["doc_id"]: bytes(x["fp"]) for x in rows.collect()}
    crowd = [(f, bytes([i % 3])) for i, f in enumerate(sorted(set(fps.values())))]
    label = dict(crowd)
    text = {fps[i]: t for i, t in data}
    expect = {(max(x, y), min(x, y)) for x in text for y in text if x != y and label[x] != label[y] and jaccard(text[x], text[y]) >= 0.8}
    for tile in (20_000, 7):
        monkeypatch.setattr(simhash, "TILE", tile)
        of = spark.createDataFrame(crowd, "fp binary, label binary")
        found = simhash.crowd_links(of, simhash.sets_of(of.select("fp"), rows, docs, 5), 0.8)
        assert {(bytes(x["u"]), bytes(x["v"])) for x in found.collect()} == expect and len(expect) > 100


def test_a_crowd_makes_few_pairs(spark):
    """Three hundred variants that are all about 0.7 alike: the prefixes' places rule nearly all pairs out before any is made."""
    r = random.Random(7)
    base = [f"w{k}" for k in range(150)]
    lists = []
    for i in range(300):
        u = list(base)
        for at in r.sample(range(150), 5):
            u[at] = f"own{i}x{at}"
        lists.append(simhash.shingle_hashes(" ".join(u), 5))
    often = {}
    for h in lists:
        for x in h.tolist():
            often[x] = often.get(x, 0) + 1
    rows_ = []
    for i, h in enumerate(lists):
        order = sorted(h.tolist(), key=lambda x: (often[x], x))
        rows_ += [(x.to_bytes(8), bytes([i // 256, i % 256]), bytes([i // 256, i % 256]), len(order), p + 1) for p, x in enumerate(order[: len(order) - math.ceil(0.8 * len(order)) + 1]) if often[x] > 1]
    frame = pd.DataFrame(sorted(rows_), columns=["key", "fp", "label", "n", "place"])
    pairs = sum(map(len, simhash.pairs_in_prefixes(iter([frame]), 0.8)))
    assert pairs < 300


def test_near_dedup_at_the_threshold(spark):
    """Lone pairs whose similarity is 0.80: none is missed."""
    data = []
    for i in range(300):
        t = [f"p{i}w{k}" for k in range(250)]
        data += [(i, " ".join(t)), (1000 + i, " ".join(t[:223] + [f"p{i}z{k}" for k in range(27)]))]
        assert 0.8 <= jaccard(data[-1][1], data[-2][1]) < 0.81
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], SCHEMA)
    assert sorted(x["doc_id"] for x in simhash.near_dedup(df).collect()) == [*range(300)]


def test_near_dedup_keeps_one_of_repeats(docs):
    kept = rows(simhash.near_dedup(docs), "doc_id", "text")
    assert sum(i == 8 for i, _ in kept) == 1
    assert {i for i, t in kept if t in (None, "", "  \n\t ")} == {4}
    assert not {2, 3} & {i for i, _ in kept}


# --- 4 mixing


def water_level(sizes):
    """Targets by giving the excess on, round after round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, capped = dict.fromkeys(names, 0.0), set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        total = sum(weight[s] for s in free)
        for s in names:
            target[s] = 3.0 * sizes[s] if s in capped else left * weight[s] / total
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("bound", [50_000, 0])
def test_mixing(spark, monkeypatch, bound):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", bound)
    r = random.Random(2)
    data = [(i, "w " * r.randrange(1, 30), "en", r.choice([None, "é", "z", "A", "big", "big", "big", "big"]), 0) for i in range(4000)] + [(9000 + i, None, "en", "none", 0) for i in range(3)]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    found = mixing.mix_digest(df).collect()
    sizes = {}
    for _, t, _, s, _ in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = water_level(sizes)
    taken = dict.fromkeys(sizes, 0)
    for x in found:
        assert x["source_size"] == sizes[x["source"]]
        assert x["target"] == pytest.approx(target[x["source"]])
        assert x["taken"] <= 3 * x["size"]
        taken[x["source"]] += x["taken"]
    for s in sizes:
        assert taken[s] == pytest.approx(target[s], rel=0.02, abs=30)
    again = mixing.mix_digest(df.repartition(2))
    assert rows(again, "doc_id", "taken") == sorted(((x["doc_id"], x["taken"]) for x in found), key=str)
    mixed = {x["doc_id"]: x["n"] for x in mixing.mix(df).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert mixed == {x["doc_id"]: x["copies"] for x in found if x["copies"]}


def test_mixing_meets_targets_on_few_documents(spark):
    """Fifty documents a source, of very different sizes: every source within 5 % of its target."""
    found = mixing.mix_digest(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(found) > 10
    assert all(abs(x["taken"] - x["target"]) < 0.05 * x["target"] for x in found)


# --- 5 quality rules


def brute_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    places = {i + d for i, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(places) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(places), failed


def test_quality_rules_equal_brute_force(spark):
    texts = [None, "", " ", "a", "a a a a", "a b c a b c x", "x\nx\n\n \nx \nx", "é#*$%&|<>\x0b1\x1fb", " ".join(words(300, 7, 3)), "\n".join(["same line here"] * 9), " ".join(words(120, 8, 900)), "a | b | c | d\n" * 8 + " ".join(words(60, 9, 900))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in quality_rules.digest(df).collect():
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == brute_quality(texts[x["doc_id"]]), texts[x["doc_id"]]
        assert not (x["base_failed"] and x["kept"])


def test_quality_lines(spark):
    prose = " ".join(words(200, 11, 900)) + "."
    mostly_bars = " ".join(words(60, 12, 900)) + ".\n" + " | ".join(words(200, 13, 900))
    texts = [prose, prose + "\nHome | News | About | Contact | Login", mostly_bars, "\n".join([prose, "All rights reserved."]), " ".join(w + "***" for w in words(100, 14, 900))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    kept = {x["doc_id"]: x for x in quality_rules.filtered(df).collect()}
    assert set(kept) == {0, 1, 3}
    assert all(x["text"] == prose and x["n_chars"] == len(prose) for x in kept.values())


# --- 6 language identification


def test_gru_gradient():
    """Backpropagation through time agrees with numeric differences."""
    m = langid.ByteGRU(["a", "b", "c"], hidden=3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, y = np.random.default_rng(0).integers(97, 103, (4, 5)).astype(np.uint8), np.array([0, 1, 2, 0])
    _, grad = m.gradients(x, y)
    for k, v in m.p.items():
        at = tuple(i // 2 for i in v.shape) if not k.startswith("W") else (int(x[0, 2]), 1)
        old, eps = v[at], 1e-4
        v[at] = old + eps
        up = m.gradients(x, y)[0]
        v[at] = old - eps
        down = m.gradients(x, y)[0]
        v[at] = old
        assert grad[k][at] == pytest.approx((up - down) / (2 * eps), rel=0.03, abs=2e-4), k


def test_language_id_held_out(spark, sf):
    found = queries.op6_language_id(spark, sf)
    df = found.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = df[df["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95
    assert df["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(df["doc_id"], df["held_out"], strict=True))


def test_language_id_without_letters(spark):
    m = langid.ByteGRU(["x", "y"])
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 .. 7"), (4, "é"), (5, "word " * 40_000), (6, "w" * 90_000), (7, "½ ² Ⅷ ①")], "doc_id long, text string")
    found = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.predict(df, m).collect()}
    assert [found[i] for i in (1, 2, 3, 7)] == [("und", 0.0)] * 4
    assert all(found[i][0] in ("x", "y") for i in (4, 5, 6))
    assert langid.train(df.withColumn("lang", F.lit(None).cast("string"))) is None


def test_language_windows_cover_whole_texts():
    """Every byte is an own position of one window, and windows give what reading the whole text gives, but for the warm-up."""
    m = langid.ByteGRU(["x", "y", "z"])
    r = np.random.default_rng(1)
    texts = [bytes(r.integers(97, 123, n).astype(np.uint8)) for n in (1, 5, 255, 256, 257, 2000)] + [b""]
    windows, owner, length = langid.windows_of(texts)
    own = [windows[i, langid.CONTEXT : langid.CONTEXT + length[i]].tobytes() for i in range(len(windows))]
    assert [b"".join(o for o, k in zip(own, owner, strict=True) if k == i) for i in range(len(texts))] == texts
    pooled = m.pooled(texts)
    for t, p in zip(texts[:-1], pooled, strict=False):
        padded = np.frombuffer(bytes(langid.CONTEXT) + t + bytes(langid.CONTEXT), np.uint8)[None, :]
        whole = m.positions(padded)[0, langid.CONTEXT : langid.CONTEXT + len(t)].mean(axis=0)
        assert p == pytest.approx(whole, abs=2e-3)
    assert pooled[-1].tolist() == [0, 0, 0]
    # A position's label depends on the words beside it.
    a, b = (m.positions(np.frombuffer(t, np.uint8)[None, :])[0, 6] for t in (b"aaaaa word bbbbb", b"zzzzz word yyyyy"))
    assert abs(a - b).max() > 1e-6


# --- 7 URL filters


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def test_url_rules(spark, sf):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q", "https://a.net/es/1#f", "https://net/fr/", "https://xnet/es/1", "https://a.org?x=/en/", "x://y://z.com/a", "https://example.com/en", "https://b.example.com/en/1", "https://É.NET/es/\n2"]
    data = list(enumerate(urls)) + [(1000 + r["page_id"], r["url"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    data += [(None, "https://a.net/de/7"), (3, "http://")]
    df = spark.createDataFrame([(i, u, "") for i, u in data], "page_id long, url string, html string").withColumns({"host": F.lit("x"), "n": F.lit(0), "raw": F.lit(1)})
    found = url_filters.filter_urls(df)
    assert found.count() == len(data)
    by_url = dict(data)
    for x in found.filter("page_id is not null").collect():
        host, path = brute_url(by_url[x["page_id"]])
        rule = brute_rule(host, path)
        assert (x["host"], x["path"], x["rule"]) == (host, path, rule[0] if rule else None)
        assert x["verdict"] == rule[1] if rule else x["verdict"] in ("allow", "block")
    assert url_filters.filter_urls(df.limit(0)).count() == 0


def test_url_templates_follow_labels(spark):
    """A template of a wildcard branch that is blocked throughout is rejected; without labels of its branch nothing is."""
    data = [(i, f"https://bad.net/{'es' if i % 2 else 'fr'}/{i}") for i in range(60)] + [(100, "https://bad.net/de/5"), (101, "https://new.org/de/5")]
    data += [(200 + i, f"https://m.example.com/{'en/' if i % 4 else 'x' * (i + 1) + '/'}{i}") for i in range(40)]
    found = {x["page_id"]: (x["verdict"], x["purity"]) for x in url_filters.filter_urls(spark.createDataFrame([(i, u) for i, u in data], "page_id long, url string")).collect()}
    assert found[100] == ("allow", None) and found[101] == ("allow", None)
    assert found[1][0] == "block" and found[1][1] > 0.9


def entropy(*n):
    return sum(x * math.log(x) for x in n if x > 0)


def plain_shape(x, y):
    """Do two counts of what is below spread alike?"""
    every = set(x) | set(y)
    pairs = [(x.get(e, 0), y.get(e, 0)) for e in every]
    n, m = sum(x.values()), sum(y.values())
    shape = 2 * (sum(entropy(p, q) - entropy(p + q) for p, q in pairs) + entropy(n + m) - entropy(n, m))
    d = len(every) - 1
    return d == 0 or shape <= (3.841 if d == 1 else d * (1 - 2 / (9 * d) + 1.645 * math.sqrt(2 / (9 * d))) ** 3)


def plain_merges(branches):
    """Child -> (child for all that merge, blocked, labelled) for the siblings under one parent."""
    groups = []
    for k in sorted((k for k, b in branches.items() if b["l"]), key=lambda k: (branches[k]["b"] / branches[k]["l"], k)):
        alike = False
        if groups:
            x, y = branches[groups[-1][-1]], branches[k]
            g = 2 * (entropy(x["b"], x["l"] - x["b"], y["b"], y["l"] - y["b"]) + entropy(x["l"] + y["l"]) - entropy(x["b"] + y["b"], x["l"] + y["l"] - x["b"] - y["b"]) - entropy(x["l"], y["l"]))
            alike = g <= 3.841 and plain_shape(x["below"], y["below"])
        groups[-1].append(k) if alike else groups.append([k])
    out, large = {}, []
    for names in groups:
        gb, gl = (sum(branches[k][c] for k in names) for c in "bl")
        out |= dict.fromkeys(names, (names[0], gb, gl))
        if gl >= url_filters.EVIDENCE:
            spread = {}
            for k in names:
                for e, m in branches[k]["below"].items():
                    spread[e] = spread.get(e, 0) + m
            large.append((spread, out[names[0]]))
    for k, b in branches.items():
        if b["l"] == 0 and b["n"] >= url_filters.EVIDENCE:
            chief = min(b["below"], key=lambda e: (-b["below"][e], e))
            having = [(-s[chief] / sum(s.values()), i) for i, (s, _) in enumerate(large) if chief in s]
            if having:
                spread, found = large[min(having)[1]]
                if plain_shape(b["below"], spread):
                    out[k] = found
    return out


def plain_tree(urls):
    """Verdicts without a rule, by a tree in plain Python: page -> (template, purity)."""
    form = lambda s: s
    labels = {}
    hosts = {}
    for i, u in urls:
        host, path = brute_url(u)
        rule = brute_rule(host, path)
        labels[i] = rule[1] if rule else None
        stems = []
        for s in (x for x in path.split("/") if x):
            m = re.fullmatch(r"(.*?)(\.[A-Za-z]{1,5})?", s, re.S)
            stem, end = m[1], m[2] or ""
            if re.fullmatch("[0-9]+", stem):
                stem = "{n}"
            elif re.fullmatch("[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?", stem):
                stem = "{date}"
            elif re.fullmatch("(?=.*[0-9])[0-9A-Fa-f-]{8,}", stem):
                stem = "{hex}"
            elif re.search("[0-9]", stem):
                stem = "{mixed}"
            stems.append(form(stem + end))
        hosts.setdefault(host, {})[i] = stems
    out = {}
    for own in hosts.values():
        for level in range(max(map(len, own.values()), default=0)):
            kids = {}
            for s in own.values():
                if len(s) > level:
                    kids.setdefault(tuple(s[:level]), set()).add(s[level])
            for s in own.values():
                if len(s) > level and len(kids[tuple(s[:level])]) > url_filters.VARIES:
                    s[level] = "*"
        plain = {i: list(s) for i, s in own.items()}
        for s in own.values():
            s[:] = s or [""]
        share = dict.fromkeys(own)
        for level in range(max(map(len, own.values()))):
            families = {}
            for i, s in own.items():
                if len(s) > level and (level == 0 or share[i] is not None):
                    b = families.setdefault(tuple(s[:level]), {}).setdefault(s[level], {"n": 0, "b": 0, "l": 0, "below": {}})
                    b["n"] += 1
                    b["b"] += labels[i] == "block"
                    b["l"] += labels[i] is not None
                    below = "/".join(s[level + 1 :])
                    b["below"][below] = b["below"].get(below, 0) + 1
            names = {(f, k): v for f, kids in families.items() if level == 0 or len(kids) > 1 for k, v in plain_merges(kids).items()}
            for i, s in own.items():
                name = names.get((tuple(s[:level]), s[level])) if len(s) > level else None
                if name is not None:
                    s[level], gb, gl = name
                    share[i] = (gb + 4 * (0.25 if level == 0 else share[i])) / (gl + 4)
        for i, s in plain.items():
            same = [j for j, t in plain.items() if t == s]
            tb, tl = sum(labels[j] == "block" for j in same), sum(labels[j] is not None for j in same)
            out[i] = ("/" + "/".join(s), None if share[i] is None else (tb + 4 * share[i]) / (tl + 4))
    return out, labels


def test_url_tree_equals_brute_force(spark, sf):
    """Templates at full depth, merges and purities as a plain tree gives them; a fourth segment decides a verdict."""
    r = random.Random(12)
    urls = [u["url"] for u in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    for host in ("a.net", "b.example.com", "www.example.com", "c.org", "d.net"):
        for _ in range(150):
            first = r.choice(["es", "fr", "en", "de", "", f"v{r.choice('abcdefgh')}{r.choice('abcdefgh')}", f"p{r.randrange(99)}"])
            urls.append(f"http://{host}/{first}/" + "/".join(r.choice(["x", "y", str(r.randrange(50)), "2020-01-02", "deadbeef01", "a.html", chr(97 + r.randrange(26)) * 3]) for _ in range(r.randrange(6))))
    urls += [f"https://deep.net/{c}{d}/s/t/{'fr' if c < 'q' else 'ad'}" for c in "abcdefghijklmnopqrstuvwxyz" for d in "xy"] + [f"https://deep.net//es/{i}/u/v/w{i}.php" for i in range(30)]
    data = list(enumerate(urls))
    expect, labels = plain_tree(data)
    for x in url_filters.filter_urls(spark.createDataFrame(data, "page_id long, url string").repartition(3)).collect():
        template, purity = expect[x["page_id"]]
        assert x["template"] == template
        assert x["purity"] == (None if purity is None else pytest.approx(purity))
        method = "block" if purity is not None and purity >= url_filters.THRESHOLD else "allow"
        assert x["verdict"] == (labels[x["page_id"]] or method)


def test_url_trees_reject_by_likeness(spark):
    """Urls without a rule are rejected on the labels of branches like theirs, at any depth; few urls or other shapes are not."""
    rules = (("block", "bad.net", "/es/"), ("block", "bad.net", "/fr/"), ("block", "deep.org", "/shop/pills/"), ("allow", "deep.org", "/shop/books/"))
    data = [f"https://bad.net/{c}/{i}/{'x' if i % 2 else 'y'}" for c in ("es", "fr", "de") for i in range(20)]
    data += [f"https://bad.net/few/{i}/x" for i in range(4)] + [f"https://bad.net/about/{c}/z" for c in "abcdefghijkl"]
    data += [f"https://deep.org/shop/{c}/item/{i}" for c in ("pills", "drugs") for i in range(30)] + [f"https://deep.org/shop/{c}/author/{i}" for c in ("books", "poems") for i in range(30)]
    df = spark.createDataFrame(list(enumerate(data)), "page_id long, url string")
    found = {x["path"]: x for x in url_filters.filter_urls(df, rules).collect()}
    assert found["/de/3/x"]["rule"] is None and found["/de/3/x"]["verdict"] == "block" and found["/de/3/x"]["purity"] > 0.9
    assert found["/few/3/x"]["verdict"] == found["/about/a/z"]["verdict"] == "allow" and found["/about/a/z"]["purity"] is None
    assert found["/shop/drugs/item/3"]["rule"] is None and found["/shop/drugs/item/3"]["verdict"] == "block"
    assert found["/shop/poems/author/3"]["verdict"] == "allow" and found["/shop/poems/author/3"]["purity"] < 0.2


# --- 8 quality model


def test_quality_model_held_out(spark, sf):
    found = queries.op8_quality_model(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").toPandas()
    held = found[found["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.8
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(found["doc_id"], found["held_out"], strict=True))


def test_quality_model_learns_and_sums():
    good, bad = [words(60, i, 30) for i in range(40)], [[w + "###" for w in words(60, 100 + i, 30)] for i in range(40)]
    enc = lambda t: [w.encode() for w in t]
    m = quality_model.SubwordClassifier()
    losses = m.fit([enc(t) for t in good[:30] + bad[:30]], [1] * 30 + [0] * 30)
    assert losses[-1] < losses[0]
    p = m.score(m.word_sums()([" ".join(t) for t in good[30:] + bad[30:]]))
    assert (p[:10] > 0.5).all() and (p[10:] < 0.5).all()
    texts = [" ".join(good[0]), None, "", "x x x"]
    whole = m.word_sums()(texts)
    flat = [f for w in texts[0].encode().split() for f in quality_model.features_of(w)]
    odds = m.vectors @ (m.weights[:, 1] - m.weights[:, 0])
    assert whole[0] == pytest.approx([odds[flat].sum(), len(flat)], rel=1e-5)


# --- 9 PII

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", m) for m in EMAIL.finditer(t)]
    out += [("ip", m) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and brute_luhn(digits(m))]
    out += [("phone", m) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab1204.@+-() \né%", max_size=40) | st.lists(st.sampled_from(["a.b@c.de", "4111 1111 1111 1111", "+1 (555) 010-9999", "10.0.0.255", "256.1.1.1", "1.2.3.4.5.6.7.8", "@", " ", ".", "x", "+", "1", "@@a.b"]), max_size=6).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_base_spans_on_long_runs():
    """No run of digits, dots or address characters takes time that grows with its square."""
    for t in ("1" * 200_000, "1." * 100_000, "a." * 100_000 + "@", "a@" * 100_000, "+1" + "-" * 200_000, "1 " * 100_000):
        pii.masked_text(t, frozenset())


def test_pii_query_and_mask(spark):
    key = "password=b7db7aa4a5fcc78305"
    data = [(1, "mail a.b@c.example.com or +1 (988) 555-2485 and 4111 1111 1111 1111 at 10.1.2.3"), (2, f"so {key} here"), (3, "nothing at all."), (4, None)]
    data += [(10 + i, f"w{i} token = \"{i:08x}b58b8af68854f0e01b4ad40cdbb6ae7f578ae\" x") for i in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    found = {x["doc_id"]: x for x in pii.find(df).collect()}
    assert (found[1]["n_email"], found[1]["n_ip"], found[1]["n_card"], found[1]["n_phone"]) == (1, 1, 1, 1)
    assert found[1]["spans"].startswith("email:5:22,ip:")
    assert "secret" in found[2]["spans"] and "secret" in found[12]["spans"]
    assert found[3]["spans"] == found[4]["spans"] == ""
    assert found[4]["base_sha256"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    masked = {x["doc_id"]: x["text"] for x in pii.masked(df).collect()}
    assert masked[1] == "mail <EMAIL> or <PHONE> and <CARD> at <IP>"
    assert masked[2] == "so password=<SECRET> here"
    assert masked[3] == "nothing at all." and masked[4] is None


def test_pii_leaves_no_part():
    """Long credentials and names go whole; of one around a base span what lies outside it goes too."""
    every = frozenset(range(3**pii.LABELERS * len(pii.ADDED) * 4))
    cases = [
        (f"token={'aB3.' * 300} end", "token=<SECRET> end"),
        (f"the {'0a' * 90} end", "the <SECRET> end"),
        ("Dr. Hans Peter Maria Schmidt came", "Dr. <NAME> came"),
        ("password=xy!bob@site.org!zz9 end", "password=<SECRET><EMAIL><SECRET> end"),
        ("secret=k9/10.1.2.3/q end", "secret=<SECRET><IP><SECRET> end"),
        ("tel 555-123-4567 and +1 555-123-4567", "tel <LOCALPHONE> and <PHONE>"),
    ]
    for text, masked in cases:
        assert pii.masked_text(text, every) == masked


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password=", "token: ", "a.b@c.de", "x" * 12, "k9" * 4, "10.1.2.3", " ", "\n", ". ", "Dr. ", "Ana Maria", "555-123-4567", "call ", "me [at] site [dot] org", "0a" * 20, "DE44 5001 0517 5407 3249 31", "4111 1111 1111 1111", "sha "]), max_size=9).map("".join))
def test_added_spans_equal_brute_force(text):
    """Candidates by a mask of taken characters: what no base span and no earlier candidate has, in runs that aren't blank."""
    base = pii.base_spans(text)
    free = [True] * len(text)
    for _, s, e in base:
        free[s:e] = [False] * (e - s)
    found = [(m.start(1), m.end(1), "secret") for m in pii._SECRET.finditer(text)]
    found += [(m.start(), m.end(), k) for p, k in ((pii._CLOUD_KEY, "secret"), (pii._HEX, "secret"), (pii._LOCAL_PHONE, "localphone"), (pii._ACCOUNT, "account"), (pii._SPELLED, "address")) for m in p.finditer(text)]
    found += [(n.start(), n.end(), "name") for t in pii._TITLES for m in re.finditer(re.escape(t), text) if (n := pii._NAME.match(text, m.end()))]
    expect = []
    for s, e, k in sorted(found, key=lambda f: (f[0], -f[1], f[2])):
        i = s
        while i < e:
            j = i
            while j < e and free[j]:
                j += 1
            if j > i and not text[i:j].isspace():
                expect.append((k, i, j))
            i = max(j, i + 1)
        free[s:e] = [False] * (e - s)
    assert [c[:3] for c in pii.candidates(text, base)] == expect


def test_context_has_no_reach():
    """A key word counts in its whole sentence and not beyond."""
    far = "the phone " + "of that office in the street behind " * 9 + "is "
    c = pii.Context(far + "555-123-4567. And 555-123-9999")
    assert c.has("phone", len(far)) and not c.has("phone", len(far) + 18)


def test_em_finds_reliable_labelers():
    r = np.random.default_rng(1)
    truth = r.random(4000) < 0.5
    votes = np.stack([np.where(r.random(4000) < a, truth, ~truth) * 2 - 1 for a in (0.95, 0.9, 0.6)], axis=1)
    post, accuracy = pii.reliabilities(votes, np.ones(4000))
    assert ((post > 0.5) == truth).mean() > 0.93
    assert accuracy[0] > accuracy[2]


# --- 10 packing


def test_packing_round_trip(spark, docs, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(70_000, "<|endoftext|> 日本語 ½ \x85 a\u00a0b"), (70_001, None), (70_002, "x " * 5000), (70_003, "\x1c\x1d y\u2028z")], "doc_id long, text string")
    data = real.unionByName(odd)
    found = packing.pack(data, queries.tokenizer_path()).collect()
    ids = {r["doc_id"]: np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for r in data.collect()}
    pieces, windows = {}, {}
    for x in found:
        pieces.setdefault(x["doc_id"], []).append(x)
        windows.setdefault(x["sequence_id"], []).append(x)
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        at = 0
        for x in sorted(own, key=lambda x: x["start"]):
            assert x["start"] == at and x["doc_tokens"] == len(ids[i])
            assert x["ids_crc32"] == zlib.crc32(ids[i][at : at + x["length"]].tobytes())
            at += x["length"]
        assert at == len(ids[i])
    for own in windows.values():
        at = 0
        for x in sorted(own, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= 2048
    full = sum(map(len, ids.values()))
    parts = max(1, data.rdd.getNumPartitions())
    assert len(windows) * 2048 - full <= 0.04 * full + 2048 * parts


def test_quick_ids_equal_the_library():
    """All Latin-1 characters between others, white space of all kinds, contractions and numbers."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    encode = packing.encoder(queries.tokenizer_path())
    r = random.Random(6)
    chars = [chr(c) for c in range(256)]
    texts = ["".join(r.choice(chars) for _ in range(60)) for _ in range(300)] + [f"a{c}b {c}{c} 1{c}" for c in chars] + ["it's  we'll\n\n  x\t", "12345 x²½ ª º µ", ""]
    for t, e in zip(texts, encode(texts), strict=True):
        assert e.tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1], repr(t)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 256), min_size=1, max_size=120), st.integers(256, 700))
def test_differencing(sizes, capacity):
    windows = packing.windows_of(sizes, capacity)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= capacity for w in windows)


def test_differencing_is_even():
    r = random.Random(1)
    sizes = [r.randrange(100, 257) for _ in range(800)]
    sums = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 80)]
    assert max(sums) - min(sums) < 80
