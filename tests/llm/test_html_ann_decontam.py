import numpy as np

from tidemill.llm import ann, decontam, html

PAGES = "page_id bigint, url string, html string"


def test_article_and_furniture():
    page = '<!DOCTYPE html><html><head><title>t</title><style>x</style><script>var a="</p>";</script></head><body><nav><p>menu</p></nav><div class="ad">buy</div><article><h1>T &amp; x</h1><p><b>one<br>two <b>b</b>old<p>  three\n four</p><div id="comments"><p>reader</p></div><aside>side</aside><form>f</form><div class="cookie-notice">c</div></article><footer>f</footer></body></html>'
    assert html.lines(page) == [(1, "T & x"), (1, "one two bold"), (1, "three four")]
    assert html.lines("a < b &lt; c <nav>unclosed<p>t") == [(0, "a < b < c"), (0, "unclosed"), (0, "t")]
    assert html.lines("") == [] and html.lines("<p hidden>x</p><p>y") == [(0, "y")]


def test_urls_and_alignment():
    assert html.split_url("https://u@Host.X/a/b?q=1#z") == ("host.x", "/a/b?q=1") and html.split_url("nothing") == ("", "nothing")
    assert html.shared_lines([1, 2, 3, 4, 5], [1, 9, 3, 5]) == [0, 2, 4] and html.shared_lines([], [1]) == []
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 4, 12).tolist(), rng.integers(0, 4, 9).tolist()
        best = [[0] * 10 for _ in range(13)]
        for i in range(12):
            for j in range(9):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(html.shared_lines(a, b)) == best[12][9]


def test_differencing(spark):
    rows = [(1, "http://h/a/1", "<p>site</p><p>first</p><p>end</p>"), (2, "http://h/a/2", "<p>site</p><p>second</p><p>end</p>"), (3, "http://h/z", "<p>other</p>"), (4, "http://k/", "<p>site</p><p>alone</p>"), (5, "http://h/a/3", "<p>site</p><article><p>site</p><p>third</p></article>"), (6, None, None), (7, "http://e/1", "<p>same</p>"), (7, "http://e/1", "<p>same</p>")]
    for parts in (1, 4):
        df = spark.createDataFrame([(*r, "x") for r in rows], PAGES + ", path string").repartition(parts)
        got = sorted(((r["page_id"], r["text"]) for r in html.extract(df).collect()), key=repr)
        assert got == sorted([(1, "first"), (2, "second"), (3, "other"), (4, "site\n\nalone"), (5, "site\n\nthird"), (6, ""), (7, "same"), (7, "same")], key=repr)
    assert html.extract(spark.createDataFrame([], PAGES)).count() == 0


def exact(vectors, every, top):
    out = set()
    for q, v in vectors.items():
        if q % every == 0:
            scored = sorted((-float((np.array(v) * np.array(x)).sum()), i) for i, x in vectors.items() if i != q)
            out |= {(q, i) for _, i in scored[:top]}
    return out


def test_nearest(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in df.collect()}
    got = ann.search(df).collect()
    found, want = {(r["query_id"], r["vec_id"]) for r in got}, exact(vectors, 20, 20)
    assert len(got) == len(found) == len(want) and len(found & want) / len(want) >= 0.9
    for q in {r["query_id"] for r in got}:
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)


def test_clusters_are_searched(spark, monkeypatch):
    """Many lists, with a hot vector, unequal lengths and all kinds of rows that take no part."""
    monkeypatch.setattr(ann, "ROWS_PER_LIST", 40)
    monkeypatch.setattr(ann, "PART", 100)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 3
    x = {i: (centres[i % 12] + rng.normal(size=8)).tolist() for i in range(1200)}
    x |= {2000 + i: [3 * v for v in x[0]] for i in range(400)}
    odd = [(5000, None), (5020, [0.0] * 8), (5040, [float("nan")] * 8), (5060, [None] + [1.0] * 7), (5080, [1.0] * 3), (5100, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in [*x.items(), *odd]], "vec_id bigint, embedding array<double>, list string, rank int")
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(df, every=50, top=10).collect()}
    want = exact(x, 50, 10)
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9
    assert {v for q, v in got if q == 0} == {2000 + i for i in range(10)}
    assert ann.search(df.limit(0)).count() == 0
    assert sorted((r["query_id"], r["vec_id"]) for r in ann.search(df.filter("vec_id in (0, 1, 2)"), every=20).collect()) == [(0, 1), (0, 2)]


ITEM = "A train leaves Paris at 40 km per hour. After 3 hours Anna meets Bob near Rome and they walk 12 km to the old station together."


def test_leaks(spark):
    benchmark = spark.createDataFrame([(1, ITEM), (2, "short one"), (3, None), (4, ""), (None, ITEM)], "item_id bigint, text string")
    other = ITEM.replace("40", "75").replace("Anna", "Maria").replace("Rome", "Berlin").replace("km", "miles")
    rows = [(1, "Some words first. " + ITEM + " And after."), (2, "Then. " + other), (3, "A train leaves the town and nothing else happens here today at all."), (4, None), (5, ""), (6, "filler " * 30000 + ". " + ITEM), (7, ITEM[:60]), (1, "clean"), (8, ITEM.replace("Bob", "Anna"))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, item_id int")
    want = {(1, 1), (2, 1), (6, 1), (8, 1)}
    held = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, benchmark).collect()}
    assert held - {(8, 1)} == want - {(8, 1)}
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, benchmark, held=1).collect()} == held
    assert decontam.contaminated(df.limit(0), benchmark).count() == 0 and decontam.contaminated(df, benchmark.limit(0)).count() == 0


def test_slots_must_agree():
    index = decontam.Index([(1, " ".join(f"we saw {c} near {c} and took" for c in ["10", "10", "20", "20", "10", "20"]))])
    raw = " ".join(f"we saw {c} near {c} and took" for c in ["5", "6", "7", "8", "9", "4"]).encode()
    assert index.find(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])) == []


def test_leaks_in_tables(spark, sf):
    docs, benchmark = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = {(d["doc_id"], b["item_id"]) for b in benchmark.collect() for d in docs.collect() if b["text"] in (d["text"] or "")}
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, benchmark).collect()} >= want
