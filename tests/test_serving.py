import pytest

from tidemill.plans import serving


def test_fetch_and_frame(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    df.createOrReplaceTempView("served")
    assert [tuple(r) for r in serving.fetch(spark, "SELECT * FROM served ORDER BY id")] == [(1, "a"), (2, None)]
    table = serving.frame(spark, df.orderBy("id"))
    assert list(table.columns) == ["id", "name"] and table["id"].tolist() == [1, 2]
    for get in (serving.fetch, serving.frame):
        assert len(get(spark, df, most=2)) == 2
        with pytest.raises(serving.TooManyRows):
            get(spark, df, most=1)


def test_cache_keeps_results_for_their_time():
    now, built = [0.0], []
    cache = serving.ResultCache(ttl=300, entries=2, clock=lambda: now[0])

    def build(name):
        def run():
            built.append(name)
            return [name]

        return run

    first = cache.get("a", build("a"))
    now[0] = 299.9
    assert cache.get("a", build("a")) is first and built == ["a"]
    now[0] = 300.0
    assert cache.get("a", build("a")) is not first and built == ["a", "a"]
    cache.clear()
    assert len(cache) == 0 and cache.get("a", build("a")) == ["a"] and built == ["a"] * 3
    cache.get("b", build("b"))
    cache.get("a", build("a"))
    cache.get("c", build("c"))  # b is the longest unused one
    cache.get("a", build("a"))
    assert len(cache) == 2 and built == ["a"] * 3 + ["b", "c"]

    def fails():
        raise RuntimeError("away")

    with pytest.raises(RuntimeError):
        cache.get("d", fails)
    assert len(cache) == 2
