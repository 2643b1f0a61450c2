"""Operators on vectors, pages and labelled documents against plain versions of what they compute."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dealwright.llm import ann, grid_join, html_text, quality, queries, warc
from dealwright.llm.graph import components
from dealwright.session import fresh_path

VECTORS = "vec_id long, embedding array<float>, label int"
PAGES = "page_id long, url string, html string"
TABLES = ("documents", "embeddings", "pages", "labels", "benchmark")


def vectors(spark, rows):
    made = [(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows]
    clash = "n _h block width ids cell links rank score usable weights".split()
    return spark.createDataFrame(made, VECTORS).select("*", *(F.lit("x").alias(c) for c in clash))


def cosines(rows):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return ids, x @ x.T


ODD = [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [math.nan] + [1.0] * 15), (9005, [math.inf] + [1.0] * 15),
       (9006, [None] + [1.0] * 15), (9007, [1.0, 2.0]), (None, [1.0] * 16)]


def test_nearest_finds_what_a_full_search_finds(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16))
    rows = [(i, centres[i % 12] * rng.choice([0.5, 1, 3]) + rng.standard_normal(16) * 0.6) for i in range(3000)]
    rows += [(3000 + i, rows[i][1]) for i in range(40)]
    df = vectors(spark, rows + ODD).repartition(3)
    asked = df.where(F.col("vec_id") % 50 == 0)
    found = ann.nearest(asked, ann.index(df, block=700), k=5, queries=25).collect()
    ids, near = cosines(rows)
    np.fill_diagonal(near, -2)
    hits = total = 0
    for q in range(0, len(rows), 50):
        got = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == [1, 2, 3, 4, 5]
        assert [(-r["score"], r["vec_id"]) for r in got] == sorted((-r["score"], r["vec_id"]) for r in got)
        assert all(r["score"] == pytest.approx(near[q, r["vec_id"]], abs=1e-9) for r in got)
        want = ids[np.lexsort((ids, -np.round(near[q], 12)))][:5]
        hits += len(set(want) & {r["vec_id"] for r in got})
        total += 5
    assert hits >= 0.97 * total
    assert {r["query_id"] for r in found} == set(range(0, len(rows), 50))


def test_nearest_recall_on_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = ann.nearest(df.where(F.col("vec_id") % 50 == 0), ann.index(df)).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in df.orderBy("vec_id").collect()]
    ids, near = cosines(rows)
    np.fill_diagonal(near, -2)
    want = {(int(q), int(v)) for i, q in enumerate(ids) if q % 50 == 0 for v in ids[np.argsort(-near[i])][:5]}
    assert len(want & {(r["query_id"], r["vec_id"]) for r in found}) >= 0.95 * len(want)


def test_nearest_skips_vectors_that_are_far_apart():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 64))
    x[:30] = x[0] + 0.05 * rng.standard_normal((30, 64))
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    projected = (units @ ann._lines(64).T).T
    order = np.argsort(projected, axis=1)
    places = np.take_along_axis(projected, order, axis=1)
    rows, cols, verified = ann.search_block(np.array([0]), units[:1], np.arange(2000), units, order, places, 5)
    assert len(cols) == 5 and max(cols) < 30 and verified < 200


def test_nearest_small_cases(spark):
    few = vectors(spark, [(0, [1, 0]), (1, [2, 0]), (1, [2, 0]), (50, [0, 1]), (7, [-1, 0]), *ODD[:6]])
    found = ann.nearest(few.where(F.col("vec_id") % 50 == 0), ann.index(few)).collect()
    assert [(r["vec_id"], round(r["score"], 9)) for r in found if r["query_id"] == 0] == [(1, 1.0), (50, 0.0), (7, -1.0)]
    assert ann.nearest(few.limit(0), ann.index(few)).count() == 0
    assert ann.nearest(few, ann.index(few.limit(0))).count() == 0


def plain_groups(ids, links):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("block, leaf", [(4096, 256), (40, 8)])
def test_near_vectors_against_all_pairs(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(grid_join, "LEAF", leaf)
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16)) for i in range(300)]
    for i in range(300, 600):
        near = rows[int(rng.integers(0, 20))][1]
        rows.append((i, near * rng.choice([1, 2]) + rng.standard_normal(16) * rng.choice([0, 0.1, 0.25, 0.3])))
    order = rng.permutation(len(rows))
    rows = [(int(order[i]), np.float32(v)) for i, v in rows]
    found = {r["vec_id"]: r for r in grid_join.near_vectors(vectors(spark, rows + ODD).repartition(4), block=block).collect()}
    assert len(found) == len(rows) + len(ODD)
    ids, near = cosines(rows)
    a, b = np.nonzero(np.triu(near >= 0.95, 1))
    links = list(zip(ids[a].tolist(), ids[b].tolist(), strict=True))
    label = plain_groups(ids.tolist(), links)
    degree = dict.fromkeys(ids.tolist(), 0)
    for u, v in links:
        degree[u] += 1
        degree[v] += 1
    for i in ids.tolist():
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (degree[i], label[i], label[i] == i)
    for i, _ in ODD:
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (0, i, True)


def test_near_vectors_small_cases(spark):
    same = vectors(spark, [(5, [1, 0]), (3, [1, 0]), (5, [1, 0]), (4, [2, 0.0]), (6, [0, 1]), (8, [-0.0, 1])])
    rows = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in grid_join.near_vectors(same).collect())
    assert rows == [(3, 3, 3, True), (4, 3, 3, False), (5, 3, 3, False), (5, 3, 3, False), (6, 1, 6, True), (8, 1, 6, False)]
    assert grid_join.near_vectors(same.limit(0)).count() == 0
    assert grid_join.near_vectors(vectors(spark, ODD[:3])).count() == 3


def test_components_of_chains_stars_and_nothing(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5, 5), (None, 7), (7, None)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges + edges[:50], "u long, v long")).collect()}
    real = [(u, v) for u, v in edges if u is not None and v is not None and u != v]
    want = plain_groups({x for e in real for x in e}, real)
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def html_pages():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        body = " ".join(rng.choices(words, k=60))
        rows.append((i, f"https://WWW.a{i % 3}.example.org/p/{i}?q=1#x", f"<html><body><nav>menu</nav><p>{body} é</p>\r\n\r\nWARC/1.1\r\n</body></html>"))
    rows += [(100, rows[0][1], rows[0][2]), (101, None, rows[0][2]), (102, "no scheme / \n here", None), (103, "http://x", ""), (104, "http://x", "short"),
             (105, "http://x", "short"), (None, "http://x", "z" * 200), (None, "http://y", "z" * 200), (106, "http://y", "z" * 200), (7, rows[7][1], rows[7][2])]
    return rows


def test_warc_round_trip_through_index_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_CAPTURES", 7)
    rows = html_pages()
    df = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit(1)).withColumn("bytes", F.lit("x"))
    path = fresh_path(spark, "warc-test")
    got = sorted((tuple(r)[:5] for r in warc.archived(df.repartition(4), path).collect()), key=str)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        later = len(raw) >= 100 and h in first and i != first[h]
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if later else "response", first[h] if later else None))
    assert got == sorted(want, key=str)
    found = warc.captures(spark, f"{path}/warc")
    texts = {(r["page_id"], bytes(r["payload"]).decode()) for r in warc.read_payloads(spark, f"{path}/warc", found).collect()}
    assert texts == {(i, h or "") for (i, _, h), w in zip(rows, want, strict=True) if w[3] == "response"}
    keys = spark.createDataFrame([("org,example,a1,www)/p/4?q=1#x",), ("x)",), ("none",), ("-",), (None,)], "key string")
    assert sorted((r["key"], r["page_id"] or 0) for r in warc.lookup(spark, f"{path}/index", keys).collect()) == [
        ("-", 101), ("org,example,a1,www)/p/4?q=1#x", 4), ("x)", 0), ("x)", 103), ("x)", 104), ("x)", 105)]


def test_warc_index_over_many_parts(spark):
    rows = [(i, f"http://h{i % 5}.org/{'same' if i % 2 else i}", f"text {i}") for i in range(400)]
    df = spark.createDataFrame(rows, PAGES)
    path = fresh_path(spark, "warc-test")
    warc.write_archives(df, f"{path}/warc", file_bytes=4000)
    assert len(spark.read.text(f"{path}/warc").inputFiles()) > 10
    found = warc.captures(spark, f"{path}/warc")
    warc.build_index(found, f"{path}/index", size=6)
    keys = found.select("key").distinct()
    got = sorted((r["key"], r["page_id"]) for r in warc.lookup(spark, f"{path}/index", keys).collect())
    assert got == sorted((r["key"], r["page_id"]) for r in found.collect())
    assert got[0][0].startswith("org,h0)/")


def test_warc_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], PAGES), fresh_path(spark, "warc-test")).count() == 0


CASES = [
    ("<p>a &amp; b<b>c</b>\n d<p>e<br>f<ul><li>1<li>2</ul>", "a & bc d\n\ne f\n\n1\n\n2"),
    ("<article><header><h1>T</h1></header><p>x</p><section id='comments'><p>c</p></section></article><footer>f</footer>", "T\n\nx"),
    ("<body><header>h</header><div class='cookie-notice'>n</div><aside>s</aside><main><p>m</p><form>f</form></main>", "m"),
    ("<article><p>a</p><div class=\"ad\">x</div><script>'</p>'</script><style>p{}</style><p>b<!-- <p>c</p> --></article>", "a\n\nb"),
    ("<article><p>1 &lt; 2 &#233; &nbsp; z<p>unclosed <a href='x>y'>link</a>", "1 < 2 é z\n\nunclosed link"),
    ("<article><div><div><p>deep</p>tail</div></div><table><tr><td>1<td>2</table></article>", "deep\n\ntail\n\n1\n\n2"),
    ("plain text", "plain text"),
    ("<", "<"),
    ("<p hidden>h</p><p title='hidden'>t</p><noscript>n</noscript>", "t"),
    ("<article>" + "<div>" * 5000 + "x", "x"),
    ("<a href=\"x>y <p>t", "y\n\nt"),
    ("<article><p>one</p></article><article><p>two</p><article><p>in</p></article></article>", "one\n\ntwo\n\nin"),
    ("<title>t</title><textarea>a</textarea><p>&copy; 2</p><nav>n</nav>", "© 2"),
    ("<script>never closed <p>x</p>", ""),
    ("<p>a &<b>lt;</b>b &am<!-- x -->p; &lt<i>c</i></p>", "a &lt;b &amp; <c"),
]


@pytest.mark.parametrize("html, text", CASES)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_templates_of_sites_go_and_articles_stay(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    rows, want = [], {}
    for i in range(40):
        text = " ".join(rng.choices(words, k=30))
        shared = "the same paragraph in every article"
        rows.append((i, f"http://site/{i}", f"<div><div id=x{i}>Top {i % 2}</div><div>Welcome to <b>Site</b></div><p>{text}</p><p>All rights</p></div>"))
        want[i] = f"Top {i % 2}\n\n{text}" if i > 99 else text
        rows.append((100 + i, f"http://other/{i}", f"<article><p>{text}</p><p>{shared}</p><div>Read <a href=/>more</a></div></article><div>x</div>"))
        want[100 + i] = f"{text}\n\n{shared}"
        rows.append((200 + i, f"http://copies/{i}", "<p>stored many times</p>"))
        want[200 + i] = "stored many times"
    for i in range(40):
        want[i] = f"Top {i % 2}\n\n{want[i]}"
    rows += [(300, None, None), (301, "", ""), (302, "http://site/1", rows[0][2])]
    want |= {300: "", 301: "", 302: want[0]}
    df = spark.createDataFrame(rows, PAGES).withColumn("host", F.lit(1)).withColumn("text", F.lit("x"))
    got = html_text.extract(df).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got) and got[0]["url"] is not None
    assert html_text.extract(df.limit(0)).count() == 0


def test_template_of_a_section_goes_however_large_the_host_is(spark):
    rows = [(i, f"http://big/{i}", f"<div><p>own text {i}</p>{'<div>Section menu</div>' if i < 6 else ''}{'<div>rare</div>' if i < 4 else ''}</div>") for i in range(200)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"own text {i}" + ("\n\nrare" if i < 4 else "") for i in range(200)}


@pytest.mark.parametrize("html, text", [
    ("<article><h2 id='related-work'>Related work</h2><p>a</p></article>", "Related work\n\na"),
    ("<article><section id='social-policy'><p>a</p></section></article>", "a"),
    ("<article><div class='reply-to-critics'><p>a</p></div></article>", "a"),
    ("<article><p>a</p><div class='share-buttons'>x</div><div id=comments>y</div><div class='post-2 related'>z</div></article>", "a"),
    ("<div class='reply-to-critics'>x</div><p>a</p>", "a"),
    ("<article><p>a</p><div class='reader-comments'><p>one two three</p></div><ol id='user-comments'><li>b</ol></article>", "a"),
    ("<article><p>a b c</p><div class='latest-comments'><p>one</p></div><li class='user-comment'>d</li></article>", "a b c"),
    ("<article><div class='editor-comments'><p>a b c</p></div><p>d</p></article>", "a b c\n\nd"),
    ("<article><p>a b c</p><section id='closing-comments'><p>d</p></section></article>", "a b c\n\nd"),
    ("<article><p>a b c</p><p class='comments-on-the-text'>d</p><p class='user-guide'>e</p></article>", "a b c\n\nd\n\ne"),
])
def test_slugs_within_an_article_are_its_text(html, text):
    assert html_text.main_text(html) == text


def test_text_of_the_given_pages(spark):
    import re
    from html import unescape

    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r["page_id"]: r["html"] for r in df.collect()}
    for r in html_text.extract(df).collect():
        article = re.search(r"<article>(.*?)</article>", html[r["page_id"]], re.S)[1]
        parts = [re.sub(r"<[^>]+>", "", p.replace("<br>", " ")) for p in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(" ".join(unescape(p).split()) for p in parts if p.strip())


def documents(spark):
    return (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))


def test_quality_keeps_good_documents_and_finds_bad_ones(spark):
    docs, labels = documents(spark)
    rows = {r["doc_id"]: r for r in quality.classify(docs.withColumn("ce", F.lit(1)).withColumn("n", F.lit("x")), labels).collect()}
    assert len(rows) == docs.count()
    told = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
    good = [i for i, (q, t) in told.items() if q == 1 and t == 0]
    bad = [i for i, (q, _) in told.items() if q == 0]
    assert sum(rows[i]["kept"] for i in good) >= 0.99 * len(good)
    assert sum(not rows[i]["kept"] for i in bad) >= 0.8 * len(bad)


def test_quality_shards_agree(spark):
    docs, labels = documents(spark)
    some = docs.unionByName(docs.where("doc_id < 20"))
    one = sorted((r["doc_id"], round(r["perplexity"], 6), r["kept"]) for r in quality.classify(some, labels).collect())
    many = sorted((r["doc_id"], round(r["perplexity"], 6), r["kept"]) for r in quality.classify(some, labels, shard_ngrams=8000).collect())
    assert one == many and len(one) == some.count()


def test_quality_model_is_a_distribution():
    texts = ["abra cadabra", "bar  abracadabra!", "a b c"]
    codes = np.concatenate([c for t in texts for c in quality.codes_of(t, 3)])
    counts, levels = np.unique(codes, return_counts=True), []
    for order in range(quality.ORDER, 0, -1):
        levels.append(quality.Level.of(*counts, np.array([0.0, 0.6, 1.1, 1.4])))
        counts = np.unique(quality._masked(counts[0], order - 1), return_counts=True)
    for context in {*(codes[:6] >> quality.BITS).tolist(), (3 << quality.BITS * 4) | 77}:
        every = (np.int64(context) << quality.BITS) | np.arange(quality.SYMBOLS)
        assert quality.probabilities(levels, every).sum() == pytest.approx(1)


def test_quality_odd_rows(spark):
    good = "some plain words that make up a sentence of text "
    rows = [(i, good * 3 + str(i), "en") for i in range(30)]
    rows += [(40, None, "en"), (41, "", None), (42, " \n", "xx"), (None, good, None), (43, good, None), (43, good, None), (44, "$%&*" * 60, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 1, 0), (21, 1, None), (20, 0, 0), (20, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    kept = {r["doc_id"]: r for r in got}
    assert all(kept[i]["kept"] for i in range(20)) and kept[43]["kept"] is not None and not kept[44]["kept"]
    assert all(kept[i]["perplexity"] is None and not kept[i]["kept"] for i in (40, 41, 42))
    assert not any(r["kept"] for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("name", list(queries.CHECKS))
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_queries_against_their_sql(spark, name, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf{sf}/{t}.parquet'")
    cursor = con.execute(queries.CHECKS[name])
    columns = sorted(d[0] for d in cursor.description)
    place = [[d[0] for d in cursor.description].index(c) for c in columns]
    want = [tuple(r[i] for i in place) for r in cursor.fetchall()]
    df = queries.QUERIES[name](spark, f"/root/testdata/sf{sf}")
    assert sorted(df.columns) == columns
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(columns).collect())
