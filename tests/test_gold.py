from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from shop import customer, d, order, rows, shop

from tidemill.functions import bucket_revenue
from tidemill.operators import selection
from tidemill.plans import gold, marts


@pytest.fixture(scope="module")
def ctx(spark):
    orders = [order(1, 1, "2024-01-01"), order(2, 1, "2024-01-11"), order(3, 1, "2024-01-31"), order(4, 2, "2024-02-10", "cancelled"), order(5, 2, "2024-02-11", "cancelled"), order(6, 3, "2024-02-20", total=5.0), order(7, 3, "2024-02-20", total=5.0)]
    return shop(spark, customers=[customer(i) for i in (1, 2, 3, 4)], orders=orders, refunds=[("REF-1", "ORD-0000001", "C1", d("2024-02-01"), 4.0, "other")])


def test_gaps(ctx):
    assert rows(gold.order_gaps(ctx), "customer_id", "own_gap") == [("C1", 15.0), ("C2", 1.0)]


def test_customers(ctx):
    c = {r["customer_id"]: r for r in gold.customer_360(ctx).collect()}
    assert (c["C1"]["gross_revenue"], c["C1"]["net_revenue"], c["C1"]["aov"]) == (Decimal("30.00"), Decimal("26.00"), Decimal("10.00"))
    assert c["C1"]["recency_days"] == 20 and c["C1"]["churn_ratio"] == round(20 / 15, 6) and c["C1"]["churn_risk"] == "low"
    assert (c["C2"]["total_orders"], c["C2"]["frequency"], c["C2"]["gross_revenue"], c["C2"]["aov"]) == (2, 0, Decimal("0.00"), None)
    assert None not in (c["C2"]["r_score"], c["C2"]["f_score"], c["C2"]["m_score"])
    assert c["C3"]["avg_order_gap_days"] == 8.0  # one date only: the mean of the others
    assert (c["C4"]["rfm_segment"], c["C4"]["churn_risk"], c["C4"]["churn_ratio"], c["C4"]["r_score"], c["C4"]["avg_order_gap_days"]) == ("no_orders", "none", None, None, 8.0)
    # C2 and C4 share the partition without valid orders; the null recency of C4 comes last.
    scored = {r["customer_id"]: r for r in gold.scored(ctx).collect()}
    assert scored["C2"]["r"] == 5 and scored["C4"]["r"] == 4


def test_churn_edges(spark):
    df = spark.createDataFrame([(1.4999, 1), (1.5, 1), (2.4999, 1), (2.5, 1), (None, 0)], "churn double, total_orders int")
    assert [r[0] for r in df.select(F.expr(gold.ladder(gold.RISK_RULES, gold.RISK_ELSE))).collect()] == ["low", "medium", "medium", "high", "none"]


def test_segments(spark):
    cases = [(5, 4, "champion"), (5, 5, "champion"), (3, 4, "loyal"), (4, 1, "new_or_returning"), (2, 2, "lost"), (2, 4, "hibernating"), (3, 3, "potential_loyalist"), (3, 2, "needs_attention")]
    df = spark.createDataFrame([(r, f, 1) for r, f, _ in cases], "r int, f int, total_orders int")
    assert [x[0] for x in df.select(F.expr(gold.ladder(gold.SEGMENT_RULES, gold.SEGMENT_ELSE))).collect()] == [c[2] for c in cases]


def test_refund_month_without_orders_is_left_out(spark):
    ctx = shop(spark, customers=[customer(1)], orders=[order(1, 1, "2024-01-10")], refunds=[("R", "ORD-0000001", "C1", d("2024-02-01"), 10.0, "x")])
    assert rows(gold.revenue_by_channel(ctx), "month", "refunds") == [(d("2024-01-01"), Decimal("0.00"))]


def test_share_of_month(spark):
    ctx = shop(spark, customers=[customer(1)], products=[("P1", "a", "x", "b", 30.0), ("P2", "a", "y", "b", 70.0)], orders=[order(1, 1)], order_items=[("I1", "ORD-0000001", "P1", 1, 30.0, 30.0), ("I2", "ORD-0000001", "P2", 1, 70.0, 70.0)])
    assert rows(gold.revenue_by_category(ctx), "category", "revenue_share_pct") == [("x", 30.0), ("y", 70.0)]


def test_new_and_returning(spark):
    ctx = shop(spark, customers=[customer(1), customer(2)], orders=[order(1, 1, "2024-01-10"), order(2, 1, "2024-02-10"), order(3, 2, "2024-02-11")])
    assert rows(gold.monthly_kpis(ctx), "month", "new_customers", "returning_customers") == [(d("2024-01-01"), 1, 0), (d("2024-02-01"), 1, 1)]


def test_buckets(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 49.99, 50.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0)], "x double")
    assert [r[0][0] for r in df.select(bucket_revenue(F.col("x"))).collect()] == list("01234567")


def test_filters(ctx):
    n = lambda **f: marts.mart(ctx, "kpi_customers", f).first()["value"]
    assert n() == n(acq_channels=[], churn_risks=None, search="") == 4
    assert n(search="U1@X") == 1 and n(search="O'Brien") == 0 and n(search="100%") == 0 and n(search="_") == 0
    assert n(acq_channels=["email"]) == 4 and n(churn_risks=["none"]) == 1
    assert marts.mart(ctx, "kpi_orders", {"months": ("2024-02-01", "2024-02-01")}).first()["value"] == 4
    with pytest.raises(KeyError):
        marts.mart(ctx, "nothing")


@pytest.mark.parametrize("limits", [{}, {"numbered": 9, "splitters": 3}])
def test_quintiles_against_ntile(spark, limits):
    """The same tiles as one ordered window gives, with ties, nulls, few rows and none; found at once and by dividing intervals."""
    from pyspark.sql.window import Window

    for n in (0, 1, 3, 7, 203):
        rows_ = [(f"C{i:04d}", None if i % 11 == 0 else i % 13, 0 if i % 4 == 0 else 1 + i % 3, Decimal(i * 7 % 50)) for i in range(n)]
        base = spark.createDataFrame(rows_, "customer_id string, recency_days bigint, valid_orders bigint, net_revenue decimal(14,2)").repartition(3)
        want = base
        for s, c in gold.SCORED.items():
            want = want.withColumn(s, F.ntile(5).over(Window.partitionBy(F.col("valid_orders") > 0).orderBy(F.col(c).asc_nulls_last(), "customer_id")).cast("long"))
        pick = lambda df: sorted(tuple(r) for r in df.select("customer_id", "r", "f", "m").collect())
        assert pick(base.withColumns(gold.score_tiles(base, **limits))) == pick(want)


def test_no_task_orders_customers(ctx):
    """The plan of the scored customers has no window, and no shuffle for the scores."""
    plan = gold.scored(ctx)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_keys_at_places(spark):
    """Order statistics of several groups with a key that most rows of one share, against sorted lists."""
    values = {"a": [i * 37 % 101 for i in range(400)], "b": [5] * 300 + list(range(40)), "c": [9], "d": [7] * 500 + [1, 9, 3]}
    rows_ = [(g, v, i) for g, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows_, "g string, k int, id int").repartition(4)
    places = {("a",): [1, 200, 400], ("b",): [1, 3, 170, 310, 340], ("c",): [1], ("d",): [1, 2, 3, 502, 503]}
    counts = {(g,): len(vs) for g, vs in values.items()}
    for limits in ({}, {"numbered": 5, "splitters": 4}):
        found = selection.keys_at(df, ["g"], "k", places, counts, ["id"], **limits)
        assert found == {g: {p: sorted(values[g[0]])[p - 1] for p in ps} for g, ps in places.items()}
    assert selection.keys_at(df, ["g"], "k", {}, {}, ["id"]) == {}
