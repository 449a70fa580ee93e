from tidemill.llm import html


def test_main_parts_are_differenced_at_their_edges(spark):
    page = "<p>outside {0}</p><main><p>site notice</p><p>first {0}</p><p>shared</p><p>last {0}</p><p>share this</p></main>"
    rows = [(i, f"http://h/a/{i}", page.format(i)) for i in (1, 2)]
    rows += [(3, "http://k/", page.format(3)), (4, "http://m/1", "<div role='main'><p>all</p></div><p>x</p>"), (5, "http://m/2", "<div role='main'><p>all</p></div><p>y</p>")]
    rows += [(6, "http://n/1", "<main><p>top</p><article><p>top</p><p>text</p></article></main>"), (7, "http://n/2", "<main><p>top</p><p>own</p></main>")]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    own = {i: f"first {i}\n\nshared\n\nlast {i}" for i in (1, 2)}
    assert got == own | {3: "site notice\n\nfirst 3\n\nshared\n\nlast 3\n\nshare this", 4: "all", 5: "all", 6: "top\n\ntext", 7: "own"}


def test_edges():
    assert html.at_edges([1, 3, 5], [1, 2, 3, 4, 5]) == [1, 5] and html.at_edges([1, 2], [1, 2]) == [] and html.at_edges([], [4]) == []
