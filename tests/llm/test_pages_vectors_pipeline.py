"""Pages, urls, vectors, registered queries and the pipeline."""

import html as entities
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from compare import same
from pyspark.sql import functions as F

import corpus_pipeline
from tabloom.llm import ann, html, queries, urls
from tabloom.llm.common import table


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    inner = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1)\b[^>]*>", "\n", inner)))
    return "\n".join(x for x in (" ".join(entities.unescape(line).split()) for line in inner.split("\n")) if x)


def test_extraction_gives_the_article(spark, sf):
    pages = table(spark, sf, "pages")
    got = {r["page_id"]: r for r in html.extract(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == article(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


LINES = ["It was the best of times and it was the worst of times for all of the people that were in the city on that day.", "Short one.", "And so it was that they had to go to the river and to the hill and to the sea, for there was no other way to be in the house."]
BAD = """<header><div class="logo">Site</div><nav><a href=x>Home</a></nav></header><div class="cookie-banner">We use cookies on this site and you have to accept it with all of it.</div>"""
END = """<ul class="related"><li><a href=1>More of the same that you may like</a></li></ul><aside>Side text that is long and has a lot of the words of and to the point of it all.</aside>
<section id="comments"><p>I like it a lot and so do all of the people that I know of in the town of the hills.</p></section><form><input><label>Email</label></form><footer>&copy; me</footer>"""


def test_densities_and_neighbours_decide(spark, sf):
    """Inside the articles of the pages, text is decided by the first pass or by neighbours, not by the element."""
    seen = {}
    for r in table(spark, sf, "pages").collect():
        for b in html.blocks_of(r["html"]):
            kind = "name" if b.bad == 2 else html.first_pass(b)
            seen[(bool(b.main), kind)] = seen.get((bool(b.main), kind), 0) + 1
    assert seen[(True, "good")] > 100 and seen[(True, "short")] > 100 and (True, "name") not in seen
    links = "".join(f"<a href={i}>{w}</a> " for i, w in enumerate(LINES[0].split()))
    assert html.main_text(f"<article><p>{LINES[0]}</p><div>{links}</div><p>{LINES[2]}</p></article>") == f"{LINES[0]}\n{LINES[2]}"
    lost = "<p>" + "</p><p>".join([LINES[0], "zzz qqq " * 20, LINES[2]]) + "</p>"  # no stop words, but between text
    assert html.main_text(f"<article>{lost}</article>").count("\n") == 2


def test_names_of_whole_pages_and_long_markup():
    for name in ("has-sidebar", "content-with-sidebar", "side-by-side", "legal", "comments-open", "no-comments", "search-results-story", "article-share-wrap"):
        for page in ("<div class='{}'><article><p>{}</p></article></div>", "<article><div class='{}'><p>{}</p></div></article>", "<body><div class='{}'><p>{}</p></div></body>"):
            assert html.main_text(page.format(name, LINES[0])) == LINES[0], (name, page)
    notice = f"<div class='notice'><p>{LINES[2]}</p></div>"
    assert html.main_text(f"{notice}<article><p>{LINES[0]}</p></article>") == LINES[0]  # text of its own only without an article
    assert html.main_text("<article><p title='x>b</p><p>c</p></article>") == "b\nc"
    for part in ("<div></b>", "<div>", "</div>", "<p title='x>"):
        began = time.perf_counter()
        html.main_text(part * 100_000)
        assert time.perf_counter() - began < 5, part


def test_block_rules_without_an_article_element():
    body = "".join(f"<p>{x}</p>" for x in LINES)
    page = f"<html><head><title>T</title><script>if (a < b) '<p>x</p>'</script></head><body>{BAD}<div id=content><h2>A story</h2>{body}</div>{END}</body></html>"
    assert html.main_text(page) == "\n".join(["A story", *LINES])
    assert html.main_text(page.replace("<div id=content>", "<main>").replace("</div>" + END, "</main>" + END)) == "\n".join(["A story", *LINES])


def test_names_of_parts():
    text = "It was the best of times and it was the worst of times for all of the people that were in the city."
    for bad in ("site-header", "header", "left_sidebar", "adsbygoogle", "cookie-notice", "main-menu", "comments-area", "newsletter-signup", "promo"):
        assert html.main_text(f"<body><div class='{bad}'><p>{text}</p></div><main><p>x</p></main></body>") == "x", bad
    for good in ("entry-header", "content", "gadget", "shadow", "article-body", "adverb"):
        assert html.main_text(f"<body><div class='{good}'><p>{text}</p></div></body>") == text, good
    assert html.main_text("<article><div class='header'><h1>Title</h1></div><p>x <span class='ad'>buy</span> y</p></article>") == "Title\nx\ny"


def test_subjects_in_an_article_are_text():
    text = LINES[0]
    for part in ("section id='social-impact'", "div id='related-work'", "h2 id='legal-status'", "section id='search'", "div class='legal-history'", "div class='notice'", "div aria-label='Related work'"):
        assert html.main_text(f"<article><{part}>{text}</{part.split()[0]}></article>") == text, part
    for part in ("div class='post-end share-buttons'", "div class='related_posts'", "section class='comments'", "div id='disqus_thread'", "div class='x ad'", "div role='navigation'"):
        assert html.main_text(f"<article><p>x</p><{part}>{text}</{part.split()[0]}></article>") == "x", part


def test_markup_edges():
    assert html.main_text(None) == html.main_text("") == html.main_text("<p>") == ""
    assert html.main_text("<article><p>a&nbsp;&lt;b&gt;  c<b>d</b><br>e<!-- x --><p>f &#8364; &unknown; < g</article>") == "a <b> cd e\nf € &unknown; < g"
    assert html.main_text("<div class='ad'>buy<article><p>text</p></article>") == "text"
    assert html.main_text("<article><p>x</p><div class='ad-box'>buy</div><p>y</p></article><footer>z") == "x\ny"
    assert html.main_text("<article>" + "<p>long text</p>" * 20_000 + "</article>").count("\n") == 19_999
    assert html.main_text("<" * 50_000) is not None and html.main_text("<a " * 20_000) is not None


def test_articles_of_readers_and_short_pages():
    text, other = LINES[0], LINES[2]
    for wrong in (f'<section class="comments"><article class="comment"><p>{other}</p></article></section>', f'<article class="comment-body" id="comment-4"><p>{other}</p></article>', f'<div class="related"><article><p>{other}</p></article></div>'):
        assert html.main_text(f"<body><article><p>{text}</p></article>{wrong}</body>") == text, wrong
    assert html.main_text(f'<article class="post no-comments"><p>{text}</p></article>') == text
    assert html.main_text("<nav><a href=x>Home</a></nav><h1>Title</h1><p>One line.</p><footer>me</footer>") == "Title\nOne line."


def test_extraction_rows(spark):
    rows = [(1, None, None, 5), (None, "u", "<article>x</article>", 6), (2, "v", "", 7), (2, "v", "", 7)]
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in out.collect()) == [("1", "", 0), ("2", "", 0), ("2", "", 0), ("None", "x", 1)]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def judged(spark, rows, outcomes=()):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(rows)], "page_id long, url string, host string")
    good = spark.createDataFrame(list(outcomes), "page_id long, good int")
    return [r for r in urls.judge(pages, good).orderBy("page_id").collect()]


def test_url_rules(spark):
    rows = ["http://A.example.NET/en/x?q#f", "http://example.net/de/", "https://example.com/de/1", "https://sub.example.com/dex", "http://x.org/fr/a", "http://x.net", "http://notexample.net.example/", None, "mailto:x", "http://x.net?/a", "ftp://U@net:80/x"]
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in judged(spark, rows)]
    assert got == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/de/", "net/", "block"), ("example.com", "/de/1", "example.com/de/", "block"),
        ("sub.example.com", "/dex", None, "allow"), ("x.org", "/fr/a", "org/fr/", "allow"), ("x.net", "", None, "allow"), ("notexample.net.example", "/", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("x.net", "", None, "allow"), ("u@net:80", "/x", None, "allow"),
    ]


def test_reputation_shrinks_and_blocks(spark):
    rows = [f"http://good{i % 10}.example.com/{i}" for i in range(60)] + [f"http://bad.example.com/{i}" for i in range(20)] + ["http://few.example.com/1", "http://new.example.org/1"]
    outcomes = [(i, 1) for i in range(60)] + [(60 + i, int(i % 4 == 0)) for i in range(20)] + [(80, 0), (80, None), (None, 1), (3, 9)]
    by = {r["host"]: r for r in judged(spark, rows, outcomes)}
    assert by["bad.example.com"]["verdict"] == "block" and by["good3.example.com"]["verdict"] == "allow"
    assert by["few.example.com"]["verdict"] == "allow" and by["few.example.com"]["upper_bound"] > 0.3  # one bad page proves little
    assert by["new.example.org"]["n_labelled"] == 0 and by["new.example.org"]["upper_bound"] is None
    assert judged(spark, []) == []


def test_unlabelled_hosts_inherit(spark):
    """A new host is judged by its domain, one of a new domain by its suffix."""
    rows = [f"http://a{i % 5}.fine.com/{i}" for i in range(100)] + [f"http://b{i % 5}.bad.org/{i}" for i in range(100)] + [f"http://c{i}.worse.xyz/{i}" for i in range(60)]
    new = ["http://new.fine.com/", "http://new.bad.org/", "http://other.xyz/", "http://other.com/"]
    outcomes = [(i, 1) for i in range(100)] + [(100 + i, 0) for i in range(160)]
    by = {r["host"]: r for r in judged(spark, rows + new, outcomes)}
    assert [by[h]["verdict"] for h in ("new.fine.com", "new.bad.org", "other.xyz", "other.com")] == ["allow", "block", "block", "allow"]
    assert all(by[h.split("/")[2]]["upper_bound"] is None for h in new)
    assert {r["verdict"] for r in judged(spark, rows)} == {"allow"}


def test_url_sql_on_repeated_null_and_shared_rows(spark, tmp_path):
    """Each labelled row counts once, however often its page stands, and many pages may share a document's number."""
    import duckdb

    pages = [(1, "http://a.com/x/1"), *[(2, "http://a.com/x/2")] * 5, (2, "http://b.com/x/2"), *[(10 + i, f"http://c{i % 7}.org/p/3.html") for i in range(60)], (None, "http://a.com/x/1"), (3, None), (4, "no url"), (5, "http://d.net/q/99"), (6, "http://e.com/9/4/"), (6, "http://e.com/9/4/")]
    labels = [(1, 1, 0), (2, 0, 0), (3, 1, 0), (3, 0, 1), (4, None, 1), (None, 1, 1), (5, 1, 0)]
    spark.createDataFrame(pages, "page_id long, url string").withColumn("good", F.lit("x")).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.op5_url_filter(spark, str(tmp_path)).where("page_id IS NOT NULL")
    same(got, con, f"SELECT * FROM ({urls.SQL}) WHERE page_id IS NOT NULL")
    by = {r["host"]: r["n_labelled"] for r in got.collect()}
    assert by["a.com"] == 7 and by["b.com"] == 1 and sum(by[f"c{i}.org"] for i in range(7)) == 60 and by["e.com"] == 0
    assert got.where("upper_bound > 1").count() == 0


def test_outcomes_count_once_for_repeated_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/1")] * 5 + [(2, "http://a.com/2")], "page_id long, url string")
    good = spark.createDataFrame([(1, 0), (2, 1)], "page_id long, good int")
    assert {r["n_labelled"] for r in urls.judge(pages, good).collect()} == {2}


def test_registered_domains(spark):
    want = {
        "shop.co.uk": ("shop.co.uk", "co.uk"), "www.other.co.uk": ("other.co.uk", "co.uk"), "x.com:8080": ("x.com", "com"), "u@w.x.org.": ("x.org", "org"),
        "10.0.0.1": ("10.0.0.1", "address"), "10.0.0.1:80": ("10.0.0.1", "address"), "[::1]": ("[::1]", "address"), "localhost": ("localhost", "localhost"), "": ("", ""), "co.uk": ("co.uk", "co.uk"),
    }
    df = spark.createDataFrame([(h,) for h in want], "h string").select("h", urls.site_of(F.col("h")).alias("s"))
    assert {r["h"]: (r["s"]["domain"], r["s"]["suffix"]) for r in df.collect()} == want


def test_search_against_brute_force(spark):
    v = table(spark, "/root/testdata/sf0.1", "embeddings")
    x = v.toPandas()
    m, ids = np.stack(x["embedding"]).astype(float), x["vec_id"].to_numpy()
    got = {}
    for r in ann.search(v).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    recall = []
    for q, found in got.items():
        s = (m * m[ids == q][0]).sum(1)
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(f[2] - s[ids == f[1]][0]) < 1e-12 for f in found)
        recall.append(len({f[1] for f in found} & set(best)) / 20)
    assert np.mean(recall) >= 0.9


@pytest.mark.parametrize("k", [200, 1500])
def test_all_lists_within_the_ratio_are_visited(k, monkeypatch):
    monkeypatch.setattr(ann, "FIRST_LISTS", 50)  # the walk, not all distances
    rng = np.random.default_rng(3)
    c, q = rng.normal(size=(k, 32)).astype(np.float32), rng.normal(size=(20, 32)).astype(np.float32)
    row, which = ann.visited(q, c, ann.graph_of(c), np.full(k, 50), 84)
    d = ((q[:, None] - c[None]).astype(float) ** 2).sum(2)
    near = {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= d.min(1)[:, None] * ann.PROBE_RATIO**2), strict=True)}
    got = set(zip(row.tolist(), which.tolist(), strict=True))
    assert len(got) == len(row) and len(near & got) >= 0.99 * len(near)
    assert np.bincount([i for i, _ in near]).max() > 36


def clustered(n, clusters, spread, seed):
    r = np.random.default_rng(seed)
    c = r.normal(size=(clusters, 32))
    share = r.dirichlet(np.full(clusters, 0.3))
    x = c[r.choice(clusters, n, p=share)] + spread * r.normal(size=(n, 32))
    return (x * r.uniform(0.5, 1.5, (n, 1))).astype(np.float32)


@pytest.mark.parametrize("n", [4000, 20_000])
def test_lists_are_balanced_and_few_are_scanned(spark, n, monkeypatch):
    seen = {}
    visited = ann.ratio_for
    monkeypatch.setattr(ann, "ratio_for", lambda q, c, rows, enough, lists: seen.update(rows=rows, c=c, ratio=visited(q, c, rows, enough, lists)) or seen["ratio"])
    x = clustered(n, 60, 0.5, 1)
    x[: n // 3] = x[0] + 1e-3 * x[: n // 3]  # a group of near copies
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    got = ann.search(frame, k=10).toPandas()
    rows, c = seen["rows"], seen["c"]
    assert rows.max() <= 4 * rows.mean()
    m, recall, asked = x.astype(float), [], np.arange(0, n, 20)[:200]
    by = {q: set(g["vec_id"]) for q, g in got.groupby("query_id")}
    for q in asked:
        s = m @ m[q]
        s[q] = -np.inf
        recall.append(len(by[q] & set(np.argpartition(-s, 10)[:10])) / 10)
    n2 = (m**2).sum(1)
    query, which = ann.visited(ann.as_queries(x[asked], n2[asked], n2.max()), c, ann.graph_of(c), rows, ann.ENOUGH * 10, seen["ratio"])
    scanned = rows[which].sum() / (len(asked) * n)
    assert np.mean(recall) >= 0.9 and min(recall) >= 0.5 and scanned < 0.2, (np.mean(recall), min(recall), scanned)


def test_full_lists_keep_their_closest(spark):
    """Ranked by parts as if ranked at once: rooms of none, some, more than there are; equal distances."""
    r = np.random.default_rng(4)
    rooms = {0: 0, 1: 7, 2: 300, 3: 10_000}
    rows = [(int(i), rep, float(far), rooms[int(i)]) for rep, (i, far) in enumerate(zip(r.integers(0, 4, 4000), r.integers(0, 50, 4000), strict=True))]
    want = {x[:2] for i, room in rooms.items() for x in sorted((x for x in rows if x[0] == i), key=lambda x: (x[2], x[1]))[:room]}
    got = ann.within_room(spark.createDataFrame(rows, "list int, rep long, far double, room int"))
    assert got.columns == ["list", "rep", "far", "room"]
    assert sorted((x["list"], x["rep"]) for x in got.collect()) == sorted(want)


def test_search_of_equal_vectors_and_repeated_ids(spark):
    """Copies of a vector are one entry and come out by id; rows with one id are one candidate."""
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(40, 4)), 1).astype(np.float32)
    rows = [(int(i), x[r.integers(0, 40)].tolist()) for i in r.integers(0, 300, 500)]
    got = {}
    for g in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=7).collect():
        got.setdefault(g["query_id"], []).append((g["rank"], g["vec_id"], round(g["score"], 9)))
    want = {}
    for q in {i for i, _ in rows if i % 20 == 0}:
        best = {}
        for _, a in (z for z in rows if z[0] == q):
            for i, b in rows:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), float(np.dot(np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float))))
        want[q] = [(n + 1, i, round(s, 9)) for n, (i, s) in enumerate(sorted(best.items(), key=lambda z: (-z[1], z[0]))[:7])]
    assert {q: sorted(f) for q, f in got.items()} == want


def test_search_ties_edges_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [2.0, 1.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (5, [5.0, 5.0]), (6, [0.0, 0.0]), (7, None), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [1.0]), (11, [None, 1.0]), (None, [1.0, 1.0]), (40, [0.0, 0.0]), (5, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("list", "block", "v", "score", "rank")})
    got = {}
    for r in ann.search(df, k=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(f) for q, f in got.items()} == {0: [(1, 5, 5.0), (2, 20, 2.0), (3, 2, 1.0)], 20: [(1, 5, 15.0), (2, 0, 2.0), (3, 2, 2.0)]}
    assert ann.search(df.where("false")).count() == 0
    assert ann.search(df.where("vec_id = 0")).count() == 0
    hot = spark.range(6000).selectExpr("id AS vec_id", "array(CAST(1 AS FLOAT), CAST(2 AS FLOAT)) AS embedding")
    first = ann.search(hot, k=5).where("query_id = 20").orderBy("rank").collect()
    assert [r["vec_id"] for r in first] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, duck, name):
    same(queries.QUERIES[name](spark, sf), duck, queries.ORACLES[name])


CONTRACTS = {
    "op1_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_minhash_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op4_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op5_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op6_nearest_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op8_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_contract_columns(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).columns[: len(CONTRACTS[name])] == CONTRACTS[name]


def test_pipeline_stages(spark, sf, tmp_path):
    """Each stage keeps the columns and decides as its operator does; nothing else changes."""
    docs = table(spark, sf, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name not in ("pii", "packing"):
            assert docs.exceptAll(before).count() == 0
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4]
    assert corpus_pipeline.run(spark, sf).count() == counts[5]


def test_pipeline_stages_take_edge_rows(spark, sf):
    schema = table(spark, sf, "documents").schema
    rows = [(1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", None, 0), (3, "x " * 50_000, "en", "s", 1), (3, "x " * 50_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit(c) for c in ("component_id", "score", "bucket", "_bad", "_dropped", "_held", "__found", "__between", "n", "rep", "hub", "copies")})
    for some in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, sf)
            assert out.count() >= some.count() if name == "packing" else out.columns == some.columns
            assert name == "packing" or out.count() == some.count()
