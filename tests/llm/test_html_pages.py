"""Differencing and structure of whole pages against plain references."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemill.llm import html

PAGES = "page_id bigint, url string, html string"


def texts(spark, rows, parts=2):
    df = spark.createDataFrame(rows, PAGES).repartition(parts)
    return {r["page_id"]: r["text"] for r in html.extract(df).collect()}


def test_offsets_after_letters_that_grow_when_folded(spark):
    page = "<article><p>" + "İ" * 40 + "</p><SCRIPT>var a = 1;</SCRIPT><p>second</p><p>third</p></article>"
    assert texts(spark, [(1, "http://h/1", page)]) == {1: "İ" * 40 + "\n\nsecond\n\nthird"}


def test_hints_are_decided_by_the_nearest_page(spark):
    page = lambda n, unique: f'<body><div class="site-header">head {n}</div><div class="share-price">{unique}</div><div class="comment-policy">be kind</div><article><h1>t{n}</h1><p>text {n}</p></article><div>outside</div></body>'
    got = texts(spark, [(n, f"http://h/{n}", page(n, f"price {n}")) for n in (1, 2, 3)])
    assert got == {n: f"t{n}\n\ntext {n}" for n in (1, 2, 3)}
    open_page = lambda n: f'<body><div class="site-header">head {n}</div><div class="share-price">price {n}</div><div class="comment-policy">be kind</div><p>text {n}</p></body>'
    got = texts(spark, [(n, f"http://h/{n}", open_page(n)) for n in (1, 2, 3)])
    assert got == {n: f"price {n}\n\ntext {n}" for n in (1, 2, 3)}
    assert texts(spark, [(1, "http://h/1", open_page(1))]) == {1: "price 1\n\nbe kind\n\ntext 1"}


def test_furniture_inside_articles(spark):
    """Loose blocks at an article's edges go where the nearest page has them too; paragraphs never."""
    page = lambda n: "<article><div>Follow us</div><h1>Same title</h1><p>shared</p><div>inner</div>" + "".join(f"<p>{w} {n}</p>" for w in "abcdefg") + "<ul><li>Print</li><li>Send</li></ul></article>"
    got = texts(spark, [(n, f"http://h/a/{n}", page(n)) for n in (1, 2)] + [(3, "http://k/", page(3))])
    own = lambda n: "Same title\n\nshared\n\ninner\n\n" + "\n\n".join(f"{w} {n}" for w in "abcdefg")
    assert got == {1: own(1), 2: own(2), 3: "Follow us\n\n" + own(3) + "\n\nPrint\n\nSend"}
    short = "<article><div>Follow us</div><h1>T{0}</h1><p>a {0}</p><p>b {0}</p><p>c {0}</p><ul><li>Print</li></ul></article>"
    got = texts(spark, [(n, f"http://h/a/{n}", short.format(n)) for n in (1, 2)])
    assert got == {n: f"T{n}\n\na {n}\n\nb {n}\n\nc {n}" for n in (1, 2)}
    # Copies of an article keep everything.
    copy = "<article><div>Follow us</div><p>a</p><p>b</p><p>c {0}</p></article>"
    assert texts(spark, [(n, f"http://h/{n}", copy.format(n)) for n in (1, 2)])[1] == "Follow us\n\na\n\nb\n\nc 1"


def reference(rows):
    """Pairs by sorted URL, a quadratic alignment, and every shared line deleted."""
    def lcs(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    pages = sorted((html.split_url(u), i, re.findall(r"<p>(.*?)</p>", h)) for i, u, h in rows)
    out = {}
    for k, ((host, path), i, mine) in enumerate(pages):
        sides = [pages[j] for j in (k - 1, k + 1) if 0 <= j < len(pages) and pages[j][0][0] == host]
        common = lambda p: next((n for n, (x, y) in enumerate(zip(p, path)) if x != y), min(len(p), len(path)))  # noqa: E731, B023
        nearest = max(sides, key=lambda s: common(s[0][1]))[2] if sides else None
        out[i] = len(mine) - (lcs(mine, nearest) if nearest is not None and nearest != mine else 0)
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_open_pages_against_reference(spark, parts):
    rng = random.Random(4)
    rows = [(i, f"http://h{rng.randrange(4)}.x/{rng.choice('ab')}/{rng.randrange(1000)}", "".join(f"<p>w{rng.randrange(6)}</p>" for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    got = texts(spark, rows, parts)
    assert {i: len(t.split("\n\n")) if t else 0 for i, t in got.items()} == reference(rows)


def test_long_pages_and_alignment(spark):
    """20,000 lines a page, and lengths of alignments against the quadratic table."""
    long = lambda own: "".join(f"<p>{own if i % 2 else 's'} {i}</p>" for i in range(20_000))
    got = texts(spark, [(1, "http://h/1", long("a")), (2, "http://h/2", long("b"))])
    assert got[1].split("\n\n") == [f"a {i}" for i in range(1, 20_000, 2)]
    rng = random.Random(2)
    for _ in range(100):
        a, b = [rng.randrange(5) for _ in range(rng.randrange(14))], [rng.randrange(5) for _ in range(rng.randrange(14))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        at = html.shared_lines(a, b)
        assert len(at) == best[-1][-1] and at == sorted(at)
        it = iter(b)
        assert all(a[i] in it for i in at)


def test_unclosed_markup(spark):
    rows = [(1, "http://a/", "<article><p>one<nav><p>two"), (2, "http://b/", "<article><h1>x</h1><script>never closed <p>y</p>"), (3, "http://c/", "<article><p>x<!-- open <p>z</p>")]
    got = texts(spark, rows)
    assert got[1] == "one\n\ntwo" and got[2] == "x" and got[3].startswith("x")


def test_pages_against_plain_extraction(spark, sf):
    """Every test page holds one explicit article: its blocks, by a plain reading of the markup."""
    import html as entities

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract(pages.withColumn("host", F.lit(1))).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"</?b>", "", re.sub(r"<br ?/?>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)
