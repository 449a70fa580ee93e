import datetime as dt
import math
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions import padded_id
from tidemill.sources import generator, landing
from tidemill.sources.schemas import TABLES, column_types, schema, sql_type
from tidemill.sources.versioned import Store


def test_types(spark):
    assert column_types(spark.createDataFrame([], schema("orders"))) == {"order_id": "varchar", "customer_id": "varchar", "order_date": "date", "order_status": "varchar", "channel": "varchar", "total_amount": "double"}
    with pytest.raises(ValueError):
        sql_type(T.ArrayType(T.StringType()))


def test_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    with pytest.raises(KeyError):
        store.read("silver.t")
    for n in (1, 2, 3, 4):
        assert store.write("silver.t", spark.range(n)) == n
    assert store.read("silver.t").count() == 4 and store.read("silver.t", version=2).count() == 2
    assert [v.number for v in store.versions("silver.t")] == [1, 2, 3, 4] and store.tables("silver") == ["silver.t"]
    assert store.read("silver.t", as_of=time.time() + 60).count() == 4
    with pytest.raises(KeyError):
        store.read("silver.t", as_of=0)
    assert store.expire("silver.t", 3600) == []
    assert store.expire("silver.t", 0, now=time.time() + 60) == [1, 2, 3]
    assert store.read("silver.t").count() == 4 and store.expire("silver.t", 0, now=time.time() + 60) == []
    assert store.compact("silver.t") == 5 and store.read("silver.t").count() == 4


def test_readers_of_the_old_version_go_on(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.write("gold.t", spark.range(3))
    old = store.read("gold.t")
    store.write("gold.t", old.union(old))
    assert old.count() == 3 and store.read("gold.t").count() == 6


def test_orphans(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.write("gold.t", spark.range(3))
    left = tmp_path / "gold" / "t" / "v=9"
    left.mkdir()
    (left / "part-0.parquet").write_bytes(b"half")
    assert store.remove_orphans("gold.t", 3600) == {"files": 0, "bytes": 0}
    assert store.remove_orphans("gold.t", 0, now=time.time() + 60) == {"files": 1, "bytes": 4}
    assert store.read("gold.t").count() == 3


def test_landing(spark, tmp_path):
    root = f"file://{tmp_path}"
    with pytest.raises(landing.SourceMissing):
        landing.scan(spark, f"{root}/nothing")
    path = landing.land(spark.range(5), root, "t")
    landing.external_table(spark, "raw_test", "t", path)
    landing.external_table(spark, "raw_test", "t", path)
    assert spark.table("raw_test.t").count() == 5
    assert [tuple(r) for r in landing.catalog_tables(spark, "raw_test").collect()] == [("raw_test", "t", "id", "bigint")]
    assert landing.list_objects(spark, path).count() >= 2 and landing.purge(spark, path) >= 2
    assert landing.round_trip(spark, root)[0] == (1, "a", 1.5)
    spark.sql("DROP DATABASE raw_test CASCADE")


SMALL = generator.Config(customers=100, products=24, orders=400, web_events=300, support_tickets=40)


def test_generator(spark, tmp_path):
    g = {t: generator.Generator(spark, SMALL).table(t).cache() for t in TABLES}
    for t, df in g.items():
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schema(t)], t
        key = df.columns[0]
        assert df.select(key).distinct().count() == df.count(), t
    assert g["orders"].join(g["customers"], "customer_id", "left_anti").count() == 0
    assert g["order_items"].join(g["products"], "product_id", "left_anti").count() == 0
    both = g["orders"].join(g["payments"], "order_id")
    assert both.filter("(order_status = 'cancelled') <> (payment_status = 'failed')").count() == 0 and both.count() == SMALL.orders
    refunds = g["refunds"].join(g["orders"], ["order_id", "customer_id"])
    assert refunds.filter("order_status <> 'returned' or datediff(refund_date, order_date) not between 3 and 45 or refund_amount > total_amount").count() == 0
    assert 0.5 < g["web_events"].filter("customer_id is not null").count() / SMALL.web_events < 0.9
    linked = g["support_tickets"].filter("order_id is not null")
    assert linked.count() > 0 and linked.join(g["orders"], ["order_id", "customer_id"], "left_anti").count() == 0
    totals = g["order_items"].groupBy("order_id").agg({"line_total": "sum"}).join(g["orders"], "order_id")
    assert totals.filter("abs(`sum(line_total)` - total_amount) > 0.005").count() == 0


def test_same_seed_same_rows(spark, tmp_path):
    digest = lambda seed: generator.table_digest(generator.Generator(spark, generator.Config(seed=seed, orders=200)).orders())
    assert digest(1) == digest(1) != digest(2)


def test_manifest_and_ingest(spark, tmp_path):
    root = f"file://{tmp_path}"
    made = generator.write_dataset(spark, f"{root}/raw", SMALL)
    assert generator.read_manifest(spark, f"{root}/raw") == made
    store = Store(spark, f"{root}/lake")
    counts = landing.ingest_all(spark, f"{root}/raw", f"{root}/landing", store)
    assert counts == {t: x["rows"] for t, x in made["tables"].items()}
    assert generator.seasonal_day and made["date_range"] == [dt.date(2024, 1, 1).isoformat(), dt.date(2024, 12, 31).isoformat()]


def test_written_tables_are_made_once(spark, tmp_path, monkeypatch):
    """Orders, payments, refunds and tickets are made from written items and orders, with the rows that they have alone."""
    calls = []
    for name in ("order_items", "orders"):
        monkeypatch.setattr(generator.Generator, name, lambda self, f=getattr(generator.Generator, name), n=name: calls.append(n) or f(self))
    made = generator.write_dataset(spark, f"file://{tmp_path}/raw", SMALL)
    assert calls == ["order_items", "orders"] and list(made["tables"]) == list(TABLES)
    for t, m in made["tables"].items():
        alone = generator.Generator(spark, SMALL).table(t)
        assert (alone.count(), generator.table_digest(alone)) == (m["rows"], m["sha256"]), t


def test_items_need_no_table_of_products(spark):
    items = generator.Generator(spark, SMALL).order_items()
    assert "Join" not in items._jdf.queryExecution().optimizedPlan().toString()
    assert generator.Generator(spark, replace(SMALL, products=0)).order_items().count() == 0


def test_seasonal_day_counts_ends(spark):
    for start, end in ((dt.date(2024, 5, 5), dt.date(2024, 5, 5)), (dt.date(2023, 10, 30), dt.date(2024, 1, 2)), (dt.date(2020, 1, 1), dt.date(2023, 12, 31))):
        days = [start + dt.timedelta(i) for i in range((end - start).days + 1)]
        weights = [generator.MONTH_WEIGHTS.get(d.month, 1.0) for d in days]
        sums = []
        for w in weights:
            sums.append((sums[-1] if sums else 0.0) + w / sum(weights))
        us = [x for e in [1e-15, *sums[:-1], *[i / 4096 for i in range(1, 4096)]] for x in (e, math.nextafter(e, 0), math.nextafter(e, 1))]
        day = generator.seasonal_day(F.col("u"), start, end)
        assert "lambda" not in str(day)
        got = dict(spark.createDataFrame([(u,) for u in us], "u double").select("u", day.alias("d")).collect())
        assert got == {u: start + dt.timedelta(sum(e <= u for e in sums[:-1])) for u in us}


def test_padded_id_keeps_every_digit(spark):
    ids = spark.range(1).select(*[padded_id("C", F.lit(n), 3) for n in (7, 999, 1234567)]).first()
    assert tuple(ids) == ("C-007", "C-999", "C-1234567")
