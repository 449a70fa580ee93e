import datetime as dt

import pytest
from shop import customer, order, shop

from tidemill.plans.quality import GATE, CheckSpec, Period, build_checks, evaluate, rows
from tidemill.plans.runner import FAILED, OK, SKIPPED, Runner, ordered
from tidemill.plans.specs import SPECS, TableSpec
from tidemill.sources.versioned import Store

P = Period(dt.date(2024, 1, 1), dt.date(2024, 12, 31))
D = dt.date.fromisoformat
R = {"period": P}
CASES = [
    ("zero", (0,), {}, True), ("zero", (3,), {}, False), ("positive", (5000,), {}, True), ("positive", (0,), {}, False),
    ("range_cover", (D("2024-01-01"), D("2024-12-31")), R | {"kind": "full"}, True), ("range_cover", (D("2024-01-01"), D("2024-06-30")), R | {"kind": "full"}, False),
    ("range_cover", (D("2024-01-06"), D("2025-02-14")), R | {"kind": "refunds"}, True), ("range_cover", (D("2023-12-01"), D("2025-02-14")), R | {"kind": "refunds"}, False),
    ("range_cover", (D("2024-01-01"), D("2024-12-28")), R | {"kind": "fresh", "days": 7}, True), ("range_cover", (D("2024-01-01"), D("2024-12-01")), R | {"kind": "fresh", "days": 7}, False),
    ("boolean_true", (True,), {}, True), ("boolean_true", (False,), {}, False), ("gmv_spread", (100.0,) * 5, {}, True), ("gmv_spread", (100.0, 100.0, 99.5, 100.0, 100.0), {}, False),
    ("z_lt_3", (1.7,), {}, True), ("z_lt_3", (3.4,), {}, False), ("max_month", (D("2024-12-01"),), R, True), ("max_month", (D("2024-01-01"),), R, False),
    ("range_cover", (D("2024-01-01"), D("2025-02-14")), R | {"kind": "stream"}, True), ("range_cover", (D("2024-01-01"), D("2024-06-30")), R | {"kind": "stream"}, False), ("range_cover", (None, None), R | {"kind": "stream"}, False),
    ("info", (4999,), {}, True), *[("kafka_lag", (n,), {"end": 50000, "tolerance": 1000}, ok) for n, ok in ((50000, True), (49800, True), (48000, False), (52000, False))], ("kafka_lag", (50000,), {"end": None}, False),
    ("manifest", (7,), {"rows": 7}, True), ("manifest", (7,), {"rows": 8}, False), ("manifest", (7,), {"rows": None}, False),
]


@pytest.mark.parametrize(("condition", "row", "params", "passed"), CASES)
def test_conditions(condition, row, params, passed):
    assert evaluate(condition, row, params).passed is passed


def test_unknown_condition_and_range():
    with pytest.raises(ValueError):
        evaluate("nothing", (1,))
    with pytest.raises(ValueError):
        evaluate("range_cover", (D("2024-01-01"), D("2024-01-02")), R | {"kind": "nothing"})


def test_check_counts():
    checks = build_checks()
    assert len(checks) == 109
    assert [sum(c.layer == x for c in checks) for x in ("bronze", "silver", "gold")] == [49, 44, 16]
    assert len({c.key for c in checks}) == 109


def test_order_of_tables():
    names = [s.name for s in ordered(SPECS.values())]
    assert all(names.index(d) < names.index(s.name) for s in SPECS.values() for d in s.deps if d in names)
    with pytest.raises(ValueError):
        ordered([TableSpec("silver.a", ("silver.b",), None, ""), TableSpec("silver.b", ("silver.a",), None, "")])


def _runner(spark, tmp_path, checks=(), **tables):
    source = shop(spark, **tables)
    return Runner(spark, Store(spark, f"file://{tmp_path}"), lambda n: source.tables.get(n), checks)


def test_refresh_and_blocking(spark, tmp_path):
    data = {"customers": [customer(1)], "orders": [order(1, 1)], "products": [("P1", "a", "c", "b", 5.0)]}
    good = _runner(spark, tmp_path / "a", **data).refresh(with_stats=True)
    assert good.ok and good.rows["gold.customer_360"] == 1
    assert good.stats["silver.fct_orders"]["bronze_rows"] == 1 and good.stats["silver.fct_orders"]["orders_without_payment"] == 1

    failing = CheckSpec("x", "silver", "dim_customers", "never", rows("silver.fct_refunds"), "positive", blocking=True)
    bad = _runner(spark, tmp_path / "b", [failing], **data).refresh()
    assert bad.states["silver.dim_customers"] == FAILED and bad.states[f"silver.{GATE}"] == SKIPPED
    assert bad.states["gold.customer_360"] == SKIPPED and bad.states["gold.monthly_kpis"] == SKIPPED and bad.states["silver.fct_orders"] == OK

    soft = CheckSpec("x", "silver", "dim_customers", "never", rows("silver.fct_refunds"), "positive")
    report = _runner(spark, tmp_path / "c", [soft], **data).refresh()
    assert report.ok and not report.checks["silver.dim_customers.never"].passed


def test_unreadable_source_stops_only_dependants(spark, tmp_path):
    source = shop(spark, customers=[customer(1)], orders=[order(1, 1)])

    def read(name):
        if name == "bronze.payments":
            raise FileNotFoundError("no payments")
        return source.tables.get(name)

    report = Runner(spark, Store(spark, f"file://{tmp_path}"), read).refresh()
    assert report.states["bronze.payments"] == FAILED and report.states["silver.fct_orders"] == SKIPPED
