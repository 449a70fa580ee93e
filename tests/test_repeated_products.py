"""Several products with one id, and orders with one id: queries that count and sum items against their SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F
from test_catalog import INPUTS, plain

from tidemill.plans import catalog, catalog_fresh, catalog_ops, gold, quality, silver, verify  # noqa: F401
from tidemill.plans.context import TIMES, driver_context

NAMES = ["j07_not_exists_or", "v04_verify_gold", "v04_gold_figures", "v01_verify_silver", "v02_gmv_across_layers", "g03_revenue_by_category", "dq23_revenue_invariant", "dq_report", "dq_report_behind", "s05_fct_order_items", "u04_incremental_order_items"]


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """The smallest tables; part keys grow beyond the five digits that their ids keep, so that up to 11 parts share an id."""
    sf, root = "/root/testdata/sf0.001", str(tmp_path_factory.mktemp("repeated"))
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    moved = "CASE WHEN {k} < 20 THEN {k} + 10000 ELSE 100000 + {k} END AS {k}"
    for t in INPUTS:
        replaced = {"part": f" REPLACE ({moved.format(k='p_partkey')})", "lineitem": f" REPLACE ({moved.format(k='l_partkey')})"}.get(t, "")
        con.execute(f"COPY (SELECT *{replaced} FROM '{sf}/{t}.parquet') TO '{root}/{t}.parquet' (FORMAT parquet)")
    return root


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, repeated, name):
    con = duckdb.connect()
    for t in INPUTS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{repeated}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, repeated)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*sorted(df.columns)).collect())
    cur = con.execute(catalog.ORACLE[name])
    names = [x[0] for x in cur.description]
    order = [names.index(x) for x in sorted(names)]
    assert got == sorted(repr([plain(r[i]) for i in order]) for r in cur.fetchall())


def test_joined_rows_are_not_written(spark, repeated):
    ctx = driver_context(spark, repeated, materialise=True)
    items, fact = ctx.weighted("silver.fct_order_items"), ctx("silver.fct_order_items")
    assert items.count() < fact.count() == items.agg(F.sum(TIMES)).first()[0] == silver.fct_order_items(driver_context(spark, repeated)).count()
    assert not any("silver.fct_order_items/" in f for f in fact.inputFiles())
    assert ctx.weighted("silver.fct_order_items") is items


def test_only_checks_asked_for_are_probed(spark, repeated):
    ctx = driver_context(spark, repeated)
    catalog_ops.check_report(ctx, only=("manifest", "kafka_lag"))
    assert not any(t.startswith(("silver.", "gold.")) for t in ctx.tables)


def test_items_lie_without_their_products(spark, repeated):
    """The incremental fact keeps a row for each item, and has the joined rows when it is read."""
    tables, _ = catalog_fresh.refreshed(spark, repeated)
    stored = spark.read.parquet(f"{tables.root}/fct_order_items")
    assert "product_name" not in stored.columns and stored.count() < tables.table("fct_order_items").count()
    assert not catalog_fresh.refreshed(spark, repeated, items=False)[0]._known("fct_order_items")


def test_categories_unfold_for_ids_and_not_for_items(spark, repeated):
    """Gross revenue is summed by product id before the categories of an id unfold."""
    ctx = driver_context(spark, repeated)
    narrow = ctx.narrow("gold.revenue_by_category", ("month", "category", "gross_revenue"))
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" not in plan and "Generate" not in plan
    assert sorted(map(repr, narrow.collect())) == sorted(map(repr, ctx("gold.revenue_by_category").select(*narrow.columns).collect()))


@pytest.mark.parametrize("name", ["m10_category_mix", "rollup_m10_category_mix_filtered"])
def test_category_mix_equals_sql(spark, repeated, name):
    test_query_equals_sql(spark, repeated, name)


def test_gross_beyond_twelve_digits(spark):
    """A hundred products of one id: a month's gross revenue is more than DECIMAL(14,2) holds."""
    from shop import customer, order, shop

    from tidemill.plans import marts, rollup

    ctx = shop(spark, customers=[customer(1)], orders=[order(1, 1)], products=[("P1", "n", "x", "b", 1.0)] * 120, order_items=[("I1", "ORD-0000001", "P1", 1, 9e9, 9e9)])
    for df in (marts.mart(ctx, "category_mix"), rollup.mart(rollup.build(ctx, ("categories",)), ctx, "category_mix")):
        assert [(r["category"], int(r["gross_revenue"])) for r in df.collect()] == [("x", 1_080_000_000_000)]


@pytest.fixture
def large_sums(spark):
    """A hundred products of one id in a written context: more than DECIMAL(14,2) holds in one month and category."""
    from shop import customer, order, shop

    ctx = shop(spark, customers=[customer(1)], orders=[order(1, 1)], products=[("P1", "n", "x", "b", 1.0)] * 120, order_items=[("I1", "ORD-0000001", "P1", 1, 9e9, 9e9)])
    ctx.materialise = True
    return ctx


def test_verify_gold_beyond_twelve_digits(large_sums):
    found = {name: (passed, detail) for name, passed, detail in verify.gold(large_sums)}
    assert found["gross by category"] == (True, "1080000000000.00 and 1080000000000.00")


def test_verify_serving_beyond_twelve_digits(large_sums):
    assert ("mart category_mix", True, "has rows") in verify.serving(large_sums)


def test_checks_beyond_twelve_digits(large_sums):
    checks = [s for s in quality.build_checks() if s.key in ("gold.revenue_by_category.not_empty", "gold.revenue_by_category.key_unique")]
    assert [r.passed for _, r in quality.run_checks(large_sums, checks)] == [True, True]


def test_join_with_products_broadcasts_none_and_keeps_its_tasks(spark):
    """However small the files are: a join that gives many rows for each that it reads."""
    items = spark.range(40).selectExpr("concat('I', id) AS order_item_id", "'O' AS order_id", "concat('P', id % 20) AS product_id", "1 AS quantity", "1.0 AS unit_price", "1.0 AS line_total", "false AS line_total_mismatch")
    products = spark.range(60).selectExpr("concat('P', id % 20) AS product_id", "concat('N', id) AS product_name", "'c' AS category", "'b' AS brand", "1.0 AS unit_price")
    fact = silver.describe_items(items, products)
    assert fact.count() == 120
    plan = fact._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert fact.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
