"""The merge by touched blocks against a full one."""

import re

import pytest
from pyspark.sql import functions as F
from shop import customer, order, shop

from tidemill.plans import incremental, silver
from tidemill.sources.schemas import schema


def item(i, o, product="P1"):
    return (f"OI-{i}", f"ORD-{o:07d}", product, 1, 2.0, 2.0)


def payment(i, o, status="succeeded"):
    return (f"PAY-{i:04d}", f"ORD-{o:07d}", "card", status, None, 10.0)


@pytest.fixture
def both(spark, tmp_path):
    """A shop of 400 orders and its tables in blocks of 100 order numbers; three of four orders have been seen."""
    n = range(1, 401)
    ctx = shop(
        spark, products=[(f"P{i}", f"Name {i}", "Toys", "Brand", 2.0) for i in (1, 2)], customers=[customer(i) for i in range(1, 21)], orders=[order(i, 1 + i % 22) for i in n if i % 2], stream_orders=[order(i, 1 + i % 22, status="cancelled") for i in n if i % 3 == 0],
        order_items=[item(i, i) for i in n if i % 2], stream_order_items=[item(i, i, "P2") for i in n if i % 3 == 0] + [item(1000 + i, i) for i in n if i % 9 == 0],
        payments=[payment(i, i) for i in n if i % 2], stream_payments=[payment(5000 - i, i, "failed") for i in n if i % 3 == 0],
    )
    return ctx, incremental.OrderTables(spark, f"file://{tmp_path}/inc", f"inc_{tmp_path.name.replace('-', '_')}", block=100, buckets=3)


def pick(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same(tables, ctx):
    return pick(tables.table("fct_orders").drop("block")) == pick(silver.fct_orders(ctx)) and pick(tables.table("fct_payments").drop("block")) == pick(silver.fct_payments(ctx)) and pick(tables.table("fct_order_items").drop("block")) == pick(silver.fct_order_items(ctx))


def test_equals_a_full_merge(spark, both):
    ctx, tables = both
    late = F.col("order_id") > "ORD-0000305"
    streams = {t: ctx(f"bronze.stream_{t}") for t in incremental.RAW}
    assert incremental.start(tables, ctx, {t: s.filter(~late) for t, s in streams.items()}) == {"blocks": 4, "of": 4, "everything": True}
    untouched = {f for f, _, _ in tables.files.listing(f"{tables.root}/fct_orders") if "block=3" not in f and "block=4" not in f and f.endswith(".parquet")}
    for t, s in streams.items():
        tables.append(t, s.filter(late), 2)
    assert tables.touched() == [3]
    assert tables.refresh(ctx("bronze.customers"), ctx("silver.dim_products")) == {"blocks": 1, "of": 4, "everything": False} and same(tables, ctx)
    assert untouched <= {f for f, _, _ in tables.files.listing(f"{tables.root}/fct_orders")}  # the same files as before
    # Nothing new; rows that come again; an order id of another form.
    assert tables.refresh(ctx("bronze.customers"), ctx("silver.dim_products"))["blocks"] == 0
    tables.append("orders", streams["orders"].filter("order_id = 'ORD-0000009'"), 2)
    tables.append("payments", ctx("bronze.payments").limit(0), 1)
    assert tables.refresh(ctx("bronze.customers"), ctx("silver.dim_products"))["blocks"] == 1 and same(tables, ctx)
    odd = spark.createDataFrame([("no number", "C1", None, "completed", "web", 1.0), (None, "C1", None, "completed", "web", 1.0)], schema("orders"))
    tables.append("orders", odd, 2)
    ctx.tables["bronze.stream_orders"] = streams["orders"].union(odd)
    assert tables.touched() == [-1] and tables.refresh(ctx("bronze.customers"), ctx("silver.dim_products"))["of"] == 5 and same(tables, ctx)


def test_customers_decide_for_all_blocks(spark, both):
    ctx, tables = both
    incremental.start(tables, ctx)
    ctx.tables["bronze.customers"] = ctx("bronze.customers").union(ctx("bronze.customers")).filter("customer_id <> 'C3'")  # repeated rows do not multiply orders
    assert tables.refresh(ctx("bronze.customers"), ctx("silver.dim_products"))["everything"] and same(tables, ctx)


def test_products_decide_for_all_items(spark, both):
    ctx, tables = both
    incremental.start(tables, ctx)
    kept = {t: {f for f, _, _ in tables.files.listing(f"{tables.root}/{t}")} for t in ("fct_orders", "fct_order_items")}
    renamed = ctx("bronze.products").withColumn("product_name", F.lit("Other")).filter("product_id <> 'P2'")
    del ctx.tables["silver.dim_products"]
    ctx.tables["bronze.products"] = renamed
    done = tables.refresh(ctx("bronze.customers"), ctx("silver.dim_products"))
    assert done == {"blocks": 0, "of": 4, "everything": False} and same(tables, ctx)
    assert tables.table("fct_order_items").select("product_name").distinct().collect() == [("Other",)]
    now = {t: {f for f, _, _ in tables.files.listing(f"{tables.root}/{t}")} for t in kept}
    assert now["fct_orders"] == kept["fct_orders"] and now["fct_order_items"] != kept["fct_order_items"]


def test_plan_has_no_exchange_by_order_and_reads_touched_blocks(spark, both):
    ctx, tables = both
    incremental.start(tables, ctx)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a small table would hide an exchange
    try:
        for df in [*tables.build(ctx("bronze.customers"), [2]).values(), tables.build_items(ctx("silver.dim_products"), [2])]:
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(order_id" not in plan and plan.count("hashpartitioning") <= 2  # by customer, both sides
            filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
            scanned = re.findall(r"block=(\d+)", " ".join(df.inputFiles()))
            assert sum("block" in f for f in filters) >= 2 and {*scanned} == {"2"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_another_session_goes_on(spark, both):
    ctx, tables = both
    incremental.start(tables, ctx)
    later = incremental.OrderTables(spark, tables.root, tables.database + "_later", tables.block, tables.buckets)
    later.attach()
    assert later.refreshes() == 1 and same(later, ctx)
    later.append("orders", spark.createDataFrame([order(7, 1), order(9_000_000, 2)], schema("orders")), 2)
    assert later.touched() == [0, 90_000] and later.refresh(ctx("bronze.customers"), ctx("silver.dim_products"))["blocks"] == 2
    ctx.tables["bronze.stream_orders"] = ctx("bronze.stream_orders").union(spark.createDataFrame([order(9_000_000, 2)], schema("orders")))
    assert same(later, ctx)


def test_a_refresh_that_failed_is_done_again(spark, both, monkeypatch):
    ctx, tables = both
    streams = {t: ctx(f"bronze.stream_{t}") for t in incremental.RAW}
    incremental.start(tables, ctx, {t: s.filter("false") for t, s in streams.items()})
    for t, s in streams.items():
        tables.append(t, s, 2)
    replace = incremental.OrderTables._replace

    def fails(self, table, rows, blocks):
        if table == "fct_payments":
            raise OSError("lost")
        replace(self, table, rows, blocks)

    monkeypatch.setattr(incremental.OrderTables, "_replace", fails)
    with pytest.raises(OSError):
        tables.refresh(ctx("bronze.customers"), ctx("silver.dim_products"))
    monkeypatch.undo()
    assert tables.touched() == [0, 1, 2, 3] and tables.refresh(ctx("bronze.customers"), ctx("silver.dim_products"))["blocks"] == 4 and same(tables, ctx)


def test_empty(spark, tmp_path):
    ctx = shop(spark)
    tables = incremental.OrderTables(spark, f"file://{tmp_path}/inc", "inc_empty")
    assert incremental.start(tables, ctx)["of"] == 0 and same(tables, ctx)


def test_buckets_follow_orders(spark, sf, monkeypatch):
    """A bucket is a task, so more orders make more buckets, with the same rows."""
    from tidemill.plans import catalog_fresh
    from tidemill.plans.context import driver_context

    assert [incremental.buckets_for(n) for n in (0, 400_000, 400_001, 10**9)] == [4, 4, 5, incremental.MOST]
    monkeypatch.setattr(incremental, "BUCKET_ORDERS", 200)
    tables, _ = catalog_fresh.refreshed(spark, sf)
    orders = driver_context(spark, sf)("bronze.orders").count()
    assert orders > 1000 and tables.buckets == -(-orders // 200)
    assert tables.build_items(driver_context(spark, sf)("silver.dim_products"))._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(order_id") == 0
    assert pick(tables.table("fct_order_items").drop("block")) == pick(driver_context(spark, sf)("silver.fct_order_items"))


def test_first_load_notes_no_blocks(spark, both):
    """The first refresh computes every block, so blocks are not looked for before it."""
    ctx, tables = both
    tables.append("orders", ctx("bronze.orders"), 1)
    assert not tables.files.exists(f"{tables.root}/changes")
    assert tables.refresh(ctx("bronze.customers"), ctx("silver.dim_products"))["everything"]
    tables.append("orders", ctx("bronze.orders").filter("order_id = 'ORD-0000101'"), 1)
    assert tables.touched() == [1]
