"""Marts from grouping sets against marts from the tables, for every combination of filters."""

import itertools

import pytest

from tidemill.plans import gold, marts, rollup
from tidemill.plans.context import driver_context


@pytest.fixture(scope="module")
def both(spark):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    ctx = driver_context(spark, sf, materialise=True)
    return ctx, rollup.build(ctx)


def values(df):
    return sorted(([None if v is None else str(float(v)) if not isinstance(v, str) and hasattr(v, "__float__") else str(v) for v in r] for r in df.select(*sorted(df.columns)).collect()), key=repr)


ACQ, RISKS, CHANNELS, MONTHS = ([], ["building"], ["building", "machinery", "nowhere"]), ([], ["low", "high"]), ([], ["web"], ["web", "pos"]), (None, ("1996-01-01", "1997-06-01"), ("2050-01-01", "2050-02-01"))


@pytest.mark.parametrize("name", sorted(marts.MARTS))
def test_all_combinations(both, name):
    ctx, cubes = both
    customers = name in ("kpi_customers", "ltv_distribution", "churn_risk_mix", "rfm_segment_mix", "customer_sample")
    for a, b in itertools.product(ACQ, RISKS) if customers else itertools.product(CHANNELS, MONTHS):
        filters = {"acq_channels": a, "churn_risks": b} if customers else {"channels": a, "months": b}
        got, want = rollup.mart(cubes, ctx, name, filters), marts.mart(ctx, name, filters)
        assert values(got) == values(want), filters
    assert values(rollup.mart(cubes, ctx, name, {"search": "user.1", "churn_risks": ["low"]})) == values(marts.mart(ctx, name, {"search": "user.1", "churn_risks": ["low"]}))


def test_what_is_read(both):
    ctx, cubes = both
    read = lambda *a: cubes.read(*a).count()
    assert read("customers", (), []) == 1 and read("revenue", ("channel",), []) == 3
    assert cubes.cubes["customers"].count() < ctx("gold.customer_360").count() * 3
    scanned = " ".join(rollup.mart(cubes, ctx, "ltv_distribution", {"churn_risks": ["low"]}).inputFiles())
    assert "cube-customers" in scanned and "customer_360" not in scanned
    with pytest.raises(KeyError):
        rollup.mart(cubes, ctx, "nothing")


def test_only_the_cube_that_a_mart_reads_is_built(both):
    ctx, cubes = both
    for name in set(marts.MARTS) - {"customer_sample"}:
        own = driver_context(ctx.spark, "/root/testdata/sf0.001")
        own.tables |= ctx.tables
        made = rollup.build(own, rollup.cubes_of(name), keep=lambda df, _: df)
        assert len(made.cubes) == 1 and values(rollup.mart(made, own, name)) == values(rollup.mart(cubes, ctx, name))
    fresh = driver_context(ctx.spark, "/root/testdata/sf0.001")
    rollup.build(fresh, rollup.cubes_of("kpi_gmv"), keep=lambda df, _: df)
    assert not {"gold.customer_360", "gold.revenue_by_category"} & set(fresh.tables)


def test_customers_are_built_without_what_no_cube_reads(both, monkeypatch):
    """The base that is written for the cube has no items, tickets or events, and one pass over the orders serves all that is told of them."""
    written, keep = {}, gold.materialised
    monkeypatch.setattr(gold, "materialised", lambda df, name: written.setdefault(name, df) and keep(df, name))
    ctx, cubes = both
    fresh = driver_context(ctx.spark, "/root/testdata/sf0.001")
    made = rollup.build(fresh, ("customers",), keep=lambda df, _: df)
    base = written["customer-base"]
    assert not {"total_tickets", "total_web_events", "items_purchased", "email"} & set(base.columns)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in written.values()]
    assert not any(c in p for p in plans for c in ("event_type", "order_item_id", "payment_id", "ticket_id"))
    assert sum("src_rank" in p for p in plans) == 1
    assert values(made.cubes["customers"]) == values(cubes.cubes["customers"])


def test_some_columns_of_customers(both):
    ctx, _ = both
    for columns in (("customer_id", "country"), ("churn_risk",), ("m_score", "aov"), ("total_tickets", "rfm_segment"), ("items_purchased", "frequency", "last_event_date")):
        narrow = driver_context(ctx.spark, "/root/testdata/sf0.001").narrow("gold.customer_360", columns)
        assert narrow.columns == list(columns) and values(narrow) == values(ctx("gold.customer_360").select(*columns))


def test_given_tables_are_read_as_they_are(spark):
    from shop import customer, order, shop

    ctx = shop(spark, customers=[customer(1)], orders=[order(1, 1)])
    ctx.tables["gold.customer_360"] = spark.createDataFrame([("C9", "low")], "customer_id string, churn_risk string")
    assert [tuple(r) for r in ctx.narrow("gold.customer_360", ("churn_risk",)).collect()] == [("low",)]


def test_days_without_a_date_are_no_gap(spark):
    from shop import customer, d, order, shop

    rows = [order(1, 1, "2024-01-01"), order(2, 1, "2024-01-01"), order(3, 1, "2024-01-04"), order(4, 1, "2024-01-31"), (*order(5, 1)[:2], None, *order(5, 1)[3:]), order(6, 2, "2024-02-01")]
    found = {r["customer_id"]: r for r in gold.customer_orders(shop(spark, customers=[customer(1), customer(2)], orders=rows)).collect()}
    assert found["C1"]["own_gap"] == 15.0 and found["C2"]["own_gap"] is None and found["C1"]["orders"] == 5 and found["C1"]["last_order_date"] == d("2024-01-31")


@pytest.mark.parametrize("name", ["kpi_aov", "revenue_trend", "channel_mix"])
def test_revenue_is_summed_without_payments_and_items(spark, sf, name):
    cube = rollup.build(driver_context(spark, sf), rollup.cubes_of(name), keep=lambda df, _: df).cubes["revenue"]
    plan = cube._jdf.queryExecution().optimizedPlan().toString()
    assert "payment_id" not in plan and "order_item_id" not in plan and "src_rank" in plan
