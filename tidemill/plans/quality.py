"""Declarative data-quality checks: a one-row probe and a condition on that row."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import month_of
from ..operators.relational import duplicate_keys, orphans, times, total_rows
from ..sources.schemas import DATES, KEYS, STREAMS
from .context import Context

GATE = "gate"
LAG_TOLERANCE = 1_000
FRESH_DAYS = 7
SPREAD = 0.05
Z_LIMIT = 3.0


@dataclass(frozen=True)
class Period:
    """The days that the data should cover; the environment may set others."""

    start: dt.date = dt.date.fromisoformat(os.environ.get("DATA_START_DATE", "2024-01-01"))
    end: dt.date = dt.date.fromisoformat(os.environ.get("DATA_END_DATE", "2024-12-31"))


@dataclass(frozen=True)
class CheckSpec:
    """table: the table that the check hangs on, or ``gate`` if it reads several of the layer."""

    family: str
    layer: str
    table: str
    name: str
    probe: Callable[[Context], DataFrame]
    condition: str
    blocking: bool = False
    params: dict[str, Any] = field(default_factory=dict)

    @property
    def key(self) -> str:
        return f"{self.layer}.{self.table}.{self.name}"


@dataclass(frozen=True)
class Result:
    passed: bool
    detail: str


def _range_cover(row: tuple, params: dict[str, Any]) -> Result:
    low, high = row
    if low is None or high is None:
        return Result(False, "no rows")
    period: Period = params.get("period", Period())
    kind = params["kind"]
    if kind == "full":
        passed = low <= period.start and high >= period.end
    elif kind in ("refunds", "stream"):
        passed = low >= period.start and high >= period.end
    elif kind == "fresh":
        passed = high >= period.end - dt.timedelta(days=params.get("days", FRESH_DAYS))
    else:
        raise ValueError(f"no kind of range {kind!r}")
    return Result(passed, f"{low} to {high}, {kind} of {period.start} to {period.end}")


def _lag(row: tuple, params: dict[str, Any]) -> Result:
    end, tolerance = params.get("end"), params.get("tolerance", LAG_TOLERANCE)
    end = end() if callable(end) else end
    if end is None:
        return Result(False, "the end of the stream is not known")
    return Result(abs(end - row[0]) <= tolerance, f"{row[0]} of {end} rows, tolerance {tolerance}")


def _manifest(row: tuple, params: dict[str, Any]) -> Result:
    rows = params.get("rows")
    rows = rows() if callable(rows) else rows
    return Result(rows is not None and row[0] == rows, f"{row[0]} rows, the manifest has {rows}")


def _max_month(row: tuple, params: dict[str, Any]) -> Result:
    last = params.get("period", Period()).end.replace(day=1)
    return Result(row[0] is not None and row[0] >= last, f"last month {row[0]}, expected {last}")


CONDITIONS: dict[str, Callable[[tuple, dict[str, Any]], Result]] = {
    "zero": lambda row, _: Result(row[0] == 0, f"{row[0]} violations"),
    "positive": lambda row, _: Result((row[0] or 0) > 0, f"{row[0]} rows"),
    "manifest": _manifest,
    "range_cover": _range_cover,
    "info": lambda row, _: Result(True, f"{row[0]} (for information)"),
    "kafka_lag": _lag,
    "boolean_true": lambda row, _: Result(bool(row[0]), str(row[0])),
    "gmv_spread": lambda row, _: Result(None not in row and float(max(row) - min(row)) < SPREAD, f"from {min(x for x in row if x is not None) if any(x is not None for x in row) else None}"),
    "z_lt_3": lambda row, _: Result(row[0] is not None and float(row[0]) < Z_LIMIT, f"largest z {row[0]}"),
    "max_month": _max_month,
}


def evaluate(condition: str, row: Iterable[Any], params: dict[str, Any] | None = None) -> Result:
    if condition not in CONDITIONS:
        raise ValueError(f"no condition {condition!r}")
    return CONDITIONS[condition](tuple(row), params or {})


# --- probes -------------------------------------------------------------------------


def _n(df: DataFrame) -> DataFrame:
    return total_rows(df)


def rows(table: str) -> Callable[[Context], DataFrame]:
    return lambda ctx: _n(ctx.weighted(table))


def repeated(table: str, *keys: str) -> Callable[[Context], DataFrame]:
    return lambda ctx: _n(duplicate_keys(ctx.weighted(table), keys))


def having(table: str, p: Column | str) -> Callable[[Context], DataFrame]:
    return lambda ctx: _n(ctx.weighted(table).filter(p))


def span(table: str, column: str) -> Callable[[Context], DataFrame]:
    return lambda ctx: ctx(table).agg(F.min(column).alias("mn"), F.max(column).alias("mx"))


def without_parent(child: str, key: str, parent: str, nullable: bool = False) -> Callable[[Context], DataFrame]:
    return lambda ctx: _n(orphans(ctx.weighted(child), ctx(parent), key, nullable))


def in_both(table: str) -> Callable[[Context], DataFrame]:
    key = KEYS[table]
    return lambda ctx: _n(ctx(f"bronze.{table}").select(key).intersect(ctx(f"bronze.stream_{table}").select(key)))


def reconciles(table: str, fact: str) -> Callable[[Context], DataFrame]:
    """Whether the fact has a row for each distinct key of both sources, less those without parents."""
    key = KEYS[table]

    def probe(ctx: Context) -> DataFrame:
        keys = ctx(f"bronze.{table}").select(key).union(ctx(f"bronze.stream_{table}").select(key)).distinct()
        return _n(keys).crossJoin(total_rows(ctx.weighted(f"silver.{fact}"), "f")).select((F.col("n") == F.col("f")).alias("ok"))

    return probe


def revenue_views(ctx: Context) -> DataFrame:
    """Gross revenue as five tables have it."""
    total = lambda df, column, name: df.agg(F.sum(column).cast("decimal(18,2)").alias(name))
    orders = ctx("silver.fct_orders").filter("not is_cancelled")
    items = ctx.weighted("silver.fct_order_items").join(orders.select("order_id"), "order_id", "left_semi")
    parts = [total(orders, "total_amount", "orders"), total(items, times(items, "line_total"), "items"), total(ctx("gold.customer_360"), "gross_revenue", "customers"), total(ctx("gold.revenue_by_channel"), "gross_revenue", "channels"), total(ctx("gold.monthly_kpis"), "gross_revenue", "months")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


def one_row_per_customer(ctx: Context) -> DataFrame:
    a = ctx("gold.customer_360").agg(F.count(F.lit(1)).alias("a"))
    return a.crossJoin(ctx("silver.dim_customers").agg(F.count(F.lit(1)).alias("b"))).select((F.col("a") == F.col("b")).alias("ok"))


def orders_reconcile(ctx: Context) -> DataFrame:
    a = ctx("gold.monthly_kpis").agg(F.sum("orders").alias("a"))
    return a.crossJoin(ctx("silver.fct_orders").agg(F.count(F.lit(1)).alias("b"))).select((F.col("a") == F.col("b")).alias("ok"))


def new_customers_reconcile(ctx: Context) -> DataFrame:
    a = ctx("gold.monthly_kpis").agg(F.sum("new_customers").alias("a"))
    return a.crossJoin(ctx("silver.fct_orders").agg(F.countDistinct("customer_id").alias("b"))).select((F.col("a") == F.col("b")).alias("ok"))


def monthly_z(period: Period) -> Callable[[Context], DataFrame]:
    """Largest |z| of monthly gross revenue over the months of the period; 0 without spread."""

    def probe(ctx: Context) -> DataFrame:
        m = ctx("gold.monthly_kpis").filter(F.col("month") <= F.lit(period.end)).select(F.col("gross_revenue").cast("double").alias("g"))
        s = m.agg(F.avg("g").alias("mean"), F.stddev("g").alias("sd"))
        z = F.coalesce(F.try_divide(F.abs(F.col("g") - F.col("mean")), F.col("sd")), F.lit(0.0))
        return m.crossJoin(F.broadcast(s)).agg(F.round(F.max(z), 6).alias("z"))

    return probe


SEGMENTS = ("champion", "loyal", "new_or_returning", "potential_loyalist", "needs_attention", "hibernating", "lost", "no_orders")
RISKS = ("none", "low", "medium", "high")
SILVER = ("dim_customers", "dim_products", "dim_order_dates", "fct_orders", "fct_order_items", "fct_payments", "fct_refunds", "fct_web_events", "fct_support_tickets")
GOLD = ("customer_360", "revenue_by_channel", "revenue_by_category", "monthly_kpis")
SILVER_KEYS = {"dim_customers": "email", "dim_products": "product_id", "dim_order_dates": "order_date", "fct_orders": "order_id", "fct_order_items": "order_item_id", "fct_payments": "order_id", "fct_refunds": "refund_id", "fct_web_events": "event_id", "fct_support_tickets": "ticket_id"}
NOT_NULL = {"dim_customers": "email", "dim_products": "unit_price", "fct_orders": "customer_id", "fct_order_items": "product_id", "fct_payments": "customer_id", "fct_refunds": "order_id"}
RAW_PARENTS = (("orders", "customer_id", "customers"), ("order_items", "order_id", "orders"), ("order_items", "product_id", "products"), ("payments", "order_id", "orders"), ("refunds", "order_id", "orders"))
FACT_PARENTS = (("fct_orders", "customer_id", "dim_customers"), ("fct_order_items", "order_id", "fct_orders"), ("fct_order_items", "product_id", "dim_products"), ("fct_payments", "order_id", "fct_orders"), ("fct_refunds", "order_id", "fct_orders"))
RULES = (
    ("fct_orders", "cancelled_means_failed_payment", "payment_status_conflict"),
    ("fct_order_items", "line_total_is_quantity_times_price", "line_total_mismatch"),
    ("fct_payments", "amount_is_order_total", "amount_mismatch"),
    ("fct_refunds", "refund_not_above_order_total", "refund_amount > order_total"),
    ("fct_support_tickets", "linked_order_is_own", "has_linked_order and not linked_order_valid"),
)
MERGED = {"web_events": "fct_web_events", "orders": "fct_orders", "order_items": "fct_order_items", "payments": "fct_payments"}


def build_checks(period: Period | None = None, manifest: Callable[[str], int | None] | None = None, stream_end: Callable[[str], int | None] | None = None) -> list[CheckSpec]:
    """All checks; ``manifest`` and ``stream_end`` give the expected rows of a table and of a stream."""
    period = period or Period()
    manifest = manifest or (lambda _: None)
    stream_end = stream_end or (lambda _: None)
    out: list[CheckSpec] = []

    def check(family: str, table: str, name: str, probe: Callable[[Context], DataFrame], condition: str, blocking: bool = False, **params: Any) -> None:
        layer, _, short = table.partition(".")
        out.append(CheckSpec(family, layer, short, name, probe, condition, blocking, params))

    ranged = {"period": period}
    for t in KEYS:
        check("dq01", f"bronze.{t}", "not_empty", rows(f"bronze.{t}"), "positive")
        check("dq02", f"bronze.{t}", "key_unique", repeated(f"bronze.{t}", KEYS[t]), "zero", True)
        check("dq03", f"bronze.{t}", "manifest_rows", rows(f"bronze.{t}"), "manifest", True, rows=lambda t=t: manifest(t))
    for t, kind in (("orders", "full"), ("payments", "full"), ("web_events", "full"), ("refunds", "refunds"), ("support_tickets", "fresh")):
        check("dq04", f"bronze.{t}", "date_range", span(f"bronze.{t}", DATES[t]), "range_cover", kind=kind, **ranged)
    for child, key, parent in RAW_PARENTS:
        check("dq05", f"bronze.{GATE}", f"{child}_{key}_known", without_parent(f"bronze.{child}", key, f"bronze.{parent}"), "zero", True)
    for t in STREAMS:
        check("dq06", f"bronze.stream_{t}", "key_unique", repeated(f"bronze.stream_{t}", KEYS[t]), "zero")
        check("dq07", f"bronze.stream_{t}", "consumer_lag", rows(f"bronze.stream_{t}"), "kafka_lag", end=lambda t=t: stream_end(t))
        if t in DATES:
            check("dq08", f"bronze.stream_{t}", "date_range", span(f"bronze.stream_{t}", DATES[t]), "range_cover", kind="stream", **ranged)
        check("dq09", f"bronze.{GATE}", f"{t}_in_both_sources", in_both(t), "info")
    for t in SILVER:
        check("dq10", f"silver.{t}", "not_empty", rows(f"silver.{t}"), "positive", True)
        check("dq11", f"silver.{t}", "key_unique", repeated(f"silver.{t}", SILVER_KEYS[t]), "zero", True)
    for t, column in NOT_NULL.items():
        check("dq12", f"silver.{t}", f"{column}_not_null", having(f"silver.{t}", f"{column} is null"), "zero")
    for child, key, parent in FACT_PARENTS:
        check("dq13", f"silver.{GATE}", f"{child}_{key}_known", without_parent(f"silver.{child}", key, f"silver.{parent}"), "zero", True)
    for t, name, violation in RULES:
        check("dq14", f"silver.{t}", name, having(f"silver.{t}", violation), "zero")
    for t, column in (("fct_orders", "order_date"), ("fct_web_events", "event_date"), ("fct_payments", "payment_date")):
        check("dq15", f"silver.{t}", "date_range", span(f"silver.{t}", column), "range_cover", kind="stream", **ranged)
    check("dq16", f"silver.{GATE}", "stream_web_events_customer_known", without_parent("bronze.stream_web_events", "customer_id", "bronze.customers", nullable=True), "zero")
    check("dq16", f"silver.{GATE}", "stream_orders_customer_known", without_parent("bronze.stream_orders", "customer_id", "bronze.customers"), "zero")
    check("dq16", f"silver.{GATE}", "stream_order_items_product_known", without_parent("bronze.stream_order_items", "product_id", "bronze.products"), "zero")
    for t, fact in MERGED.items():
        check("dq17", f"silver.{GATE}", f"{fact}_reconciles", reconciles(t, fact), "boolean_true")
    for t in GOLD:
        check("dq18", f"gold.{t}", "not_empty", rows(f"gold.{t}"), "positive", True)
    c360 = "gold.customer_360"
    check("dq19", c360, "customer_unique", repeated(c360, "customer_id"), "zero", True)
    check("dq20", f"gold.{GATE}", "one_row_per_customer", one_row_per_customer, "boolean_true", True)
    check("dq21", c360, "score_range", having(c360, " or ".join(f"{s}_score not between 1 and 5" for s in "rfm")), "zero")
    check("dq22", c360, "segment_domain", having(c360, f"rfm_segment not in {SEGMENTS}"), "zero")
    check("dq22", c360, "churn_domain", having(c360, f"churn_risk not in {RISKS}"), "zero")
    check("dq23", f"gold.{GATE}", "revenue_invariant", revenue_views, "gmv_spread", True)
    check("dq24", "gold.monthly_kpis", "freshness", lambda ctx: ctx("gold.monthly_kpis").agg(F.max("month").alias("mx")), "max_month", **ranged)
    check("dq25", f"gold.{GATE}", "orders_reconcile", orders_reconcile, "boolean_true")
    check("dq25", f"gold.{GATE}", "new_customers_reconcile", new_customers_reconcile, "boolean_true")
    check("dq26", "gold.monthly_kpis", "monthly_anomaly", monthly_z(period), "z_lt_3")
    check("dq27", "gold.revenue_by_channel", "key_unique", repeated("gold.revenue_by_channel", "month", "channel"), "zero")
    check("dq27", "gold.revenue_by_category", "key_unique", repeated("gold.revenue_by_category", "month", "category"), "zero")
    return out


def run_check(ctx: Context, spec: CheckSpec) -> Result:
    return evaluate(spec.condition, spec.probe(ctx).first(), spec.params)


def run_checks(ctx: Context, specs: Iterable[CheckSpec]) -> list[tuple[CheckSpec, Result]]:
    """All checks; the probes of a family run as one job, each of whose branches gives one row."""
    families: dict[str, list[CheckSpec]] = {}
    for spec in specs:
        families.setdefault(spec.family, []).append(spec)
    out = []
    for own in families.values():
        probes = None
        for i, spec in enumerate(own):
            one = spec.probe(ctx)
            one = one.select(F.lit(i).alias("check"), F.struct(*one.columns).alias("row"))
            probes = one if probes is None else probes.union(one)
        rows = {r["check"]: tuple(r["row"]) for r in probes.collect()}  # one row for each check
        out += [(spec, evaluate(spec.condition, rows[i], spec.params)) for i, spec in enumerate(own)]
    return out


def probe_values(ctx: Context, family: str, period: Period | None = None) -> DataFrame:
    """(check_key, measure, value) rows of a family's probes, values as text."""
    out = None
    for spec in build_checks(period):
        if spec.family == family:
            df = spec.probe(ctx)
            long = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "measure", "value")
            long = long.select(F.lit(spec.key).alias("check_key"), "measure", "value")
            out = long if out is None else out.unionByName(long)
    return out


def data_period(ctx: Context) -> Period:
    """The period that the batch orders cover, for data from other years."""
    a, z = ctx("bronze.orders").agg(F.min("order_date"), F.max("order_date")).first()
    return Period(a, z)


__all__ = ["CONDITIONS", "CheckSpec", "Period", "Result", "build_checks", "data_period", "evaluate", "month_of", "probe_values", "run_check"]
