"""Table definitions: dependencies, transformation, statistics before and after."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import total_rows
from . import gold, silver
from .context import Context

ROWS = "count(1)"


@dataclass(frozen=True)
class TableSpec:
    """One table.

    Statistics are (label, table, aggregate as SQL): those over one table are computed in one
    pass.  A table may also be a function of the context for a derived input.
    """

    name: str
    deps: tuple[str, ...]
    transform: Callable[[Context], DataFrame]
    description: str
    pre: tuple[tuple[str, str | Callable[[Context], DataFrame], str], ...] = ()
    post: tuple[tuple[str, str | Callable[[Context], DataFrame], str], ...] = field(default=())
    #: The main part of a table that is a join, and the join of it with the others.
    parts: Callable[[Context], DataFrame] | None = None
    joined: Callable[[Context], DataFrame] | None = None
    #: The table with some of its columns at least, without the work for the others.
    narrow: Callable[[Context, Sequence[str]], DataFrame] | None = None

    @property
    def layer(self) -> str:
        return self.name.split(".")[0]


def _where(p: str) -> str:
    return f"count_if({p})"


def _both(table: str, columns: list[str]) -> Callable[[Context], DataFrame]:
    return lambda ctx: ctx(f"bronze.{table}").select(*columns).union(ctx(f"bronze.stream_{table}").select(*columns))


def _orphan_orders(ctx: Context) -> DataFrame:
    return _both("orders", ["customer_id"])(ctx).join(ctx("bronze.customers").select("customer_id").distinct(), "customer_id", "left_anti")


def _orphan_items(ctx: Context) -> DataFrame:
    items = _both("order_items", ["order_id", "product_id"])(ctx)
    orders = _both("orders", ["order_id"])(ctx).distinct().withColumn("has_order", F.lit(True))
    products = ctx("bronze.products").select("product_id").distinct().withColumn("has_product", F.lit(True))
    return items.join(orders, "order_id", "left").join(products, "product_id", "left").filter("has_order is null or has_product is null")


def _dropped(table: str, fact: str) -> tuple[str, Callable[[Context], DataFrame], str]:
    def rows(ctx: Context) -> DataFrame:
        count = lambda t, name: total_rows(ctx.weighted(t), name)
        return count(f"bronze.{table}", "a").crossJoin(count(f"bronze.stream_{table}", "b")).crossJoin(count(f"silver.{fact}", "c"))

    return ("duplicates_dropped", rows, "max(a + b - c)")


def _raw(table: str, stream: bool = False) -> tuple:
    rows = (("bronze_rows", f"bronze.{table}", ROWS),)
    return (*rows, ("stream_rows", f"bronze.stream_{table}", ROWS)) if stream else rows


def _deps(*names: str) -> tuple[str, ...]:
    return tuple(n if "." in n else f"bronze.{n}" for n in names)


_ALL = (
    TableSpec("silver.dim_customers", _deps("customers"), silver.dim_customers, "Customers, one for each email", (*_raw("customers"), ("duplicate_emails", "bronze.customers", r"count(1) - count(distinct lower(regexp_replace(email, '^\\s+|\\s+$', '')))")), (("email_collisions_after", "silver.dim_customers", "count(1) - count(distinct email)"), ("null_emails", "silver.dim_customers", _where("email is null")))),
    TableSpec("silver.dim_products", _deps("products"), silver.dim_products, "Products with a positive price", (*_raw("products"), ("non_positive_prices", "bronze.products", _where("unit_price <= 0")))),
    TableSpec("silver.dim_order_dates", _deps("orders"), silver.dim_order_dates, "Calendar over the batch orders", (("expected_days", "bronze.orders", "datediff(max(order_date), min(order_date)) + 1"),), (("calendar_days", "silver.dim_order_dates", ROWS),)),
    TableSpec("silver.fct_orders", _deps("orders", "customers", "order_items", "payments", "stream_orders", "stream_order_items", "stream_payments"), silver.fct_orders, "Orders of known customers, batch and stream", (*_raw("orders", True), ("orphan_orders", _orphan_orders, ROWS)), (("payment_conflicts", "silver.fct_orders", _where("payment_status_conflict")), ("orders_without_payment", "silver.fct_orders", _where("not has_payment")), _dropped("orders", "fct_orders"))),
    TableSpec("silver.fct_order_items", _deps("order_items", "orders", "stream_order_items", "stream_orders", "silver.dim_products"), silver.fct_order_items, "Items of known orders and products", (*_raw("order_items", True), ("orphan_items", _orphan_items, ROWS)), (("line_total_mismatches", "silver.fct_order_items", _where("line_total_mismatch")), _dropped("order_items", "fct_order_items")), silver.known_items, silver.described_items),
    TableSpec("silver.fct_payments", _deps("payments", "orders", "stream_payments", "stream_orders"), silver.fct_payments, "One payment for each order", (*_raw("payments", True), ("duplicate_payments", _both("payments", ["order_id"]), "count(1) - count(distinct order_id)")), (_dropped("payments", "fct_payments"), ("amount_mismatches", "silver.fct_payments", _where("amount_mismatch")), *[(s, "silver.fct_payments", _where(f"is_{s}")) for s in ("succeeded", "failed", "pending")])),
    TableSpec("silver.fct_refunds", _deps("refunds", "orders"), silver.fct_refunds, "Refunds of batch orders", _raw("refunds"), (("full_refunds", "silver.fct_refunds", _where("is_full_refund")), ("min_refund_lag_days", "silver.fct_refunds", "coalesce(min(refund_lag_days), 0)"), ("max_refund_lag_days", "silver.fct_refunds", "coalesce(max(refund_lag_days), 0)"))),
    TableSpec("silver.fct_web_events", _deps("web_events", "stream_web_events"), silver.fct_web_events, "Web events, batch and stream", (*_raw("web_events", True), ("anonymous_rows", "bronze.web_events", _where("customer_id is null"))), (("anonymous_after", "silver.fct_web_events", _where("is_anonymous")), _dropped("web_events", "fct_web_events"))),
    TableSpec("silver.fct_support_tickets", _deps("support_tickets", "orders"), silver.fct_support_tickets, "Tickets with checked order links", (*_raw("support_tickets"), ("linked_rows", "bronze.support_tickets", _where("order_id is not null"))), (("invalid_linked_orders", "silver.fct_support_tickets", _where("has_linked_order and not linked_order_valid")),)),
    TableSpec("gold.customer_360", ("silver.dim_customers", "silver.fct_orders", "silver.fct_refunds", "silver.fct_support_tickets", "silver.fct_web_events"), gold.customer_360, "Customers with value, scores and risk", (("silver_customer_rows", "silver.dim_customers", ROWS),), (("customers_with_orders", "gold.customer_360", _where("total_orders > 0")), ("champions", "gold.customer_360", _where("rfm_segment = 'champion'")), ("churn_high", "gold.customer_360", _where("churn_risk = 'high'"))), narrow=gold.customer_360),
    TableSpec("gold.revenue_by_channel", ("silver.fct_orders", "silver.fct_refunds"), gold.revenue_by_channel, "Revenue by month and channel", (), (("channels", "gold.revenue_by_channel", "count(distinct channel)"), ("months", "gold.revenue_by_channel", "count(distinct month)"))),
    TableSpec("gold.revenue_by_category", ("silver.fct_order_items", "silver.fct_orders"), gold.revenue_by_category, "Revenue by month and category", (), (("categories", "gold.revenue_by_category", "count(distinct category)"),), narrow=gold.category_gross),
    TableSpec("gold.monthly_kpis", ("silver.fct_orders", "silver.fct_refunds"), gold.monthly_kpis, "Figures of each month", (), (("months", "gold.monthly_kpis", "count(distinct month)"),)),
)
SPECS: dict[str, TableSpec] = {s.name: s for s in _ALL}


def stats(ctx: Context, spec: TableSpec, phase: str) -> DataFrame:
    """(table, phase, label, value) of a table's statistics; one pass for each input."""
    groups: dict[object, list[tuple[str, str]]] = {}
    for label, source, aggregate in getattr(spec, phase):
        groups.setdefault(source, []).append((label, aggregate))
    out = None
    for source, parts in groups.items():
        df = ctx(source) if isinstance(source, str) else source(ctx)
        row = df.agg(*[F.coalesce(F.expr(a).cast("long"), F.lit(0).cast("long")).alias(label) for label, a in parts])
        long = row.unpivot([], [label for label, _ in parts], "label", "value")
        long = long.select(F.lit(spec.name).alias("table_name"), F.lit(phase).alias("phase"), "label", "value")
        out = long if out is None else out.unionByName(long)
    return out if out is not None else ctx.spark.createDataFrame([], "table_name string, phase string, label string, value bigint")
