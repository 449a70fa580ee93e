"""Customer and revenue marts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import days_between, money, month_of, per_unit, ratio
from ..operators.relational import count_where, sum_where, with_scalar
from ..operators.selection import tile_columns
from ..sources.scratch import materialised
from .context import TIMES, Context
from .silver import merged_items


def _valid() -> Column:
    return ~F.col("is_cancelled")


def _status_counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("orders"), *[count_where(F.col(f"is_{s}")).alias(f"{s}_orders") for s in ("completed", "returned", "cancelled")], count_where(_valid()).alias("valid_orders")]


def _revenue_columns() -> list[Column]:
    gross, refunds, n = F.col("gross"), F.coalesce("refunds", F.lit(0)), F.col("orders")
    return [
        "orders", "completed_orders", "returned_orders", "cancelled_orders", "valid_orders", money(gross, 14).alias("gross_revenue"), money(refunds, 14).alias("refunds"), money(gross - refunds, 14).alias("net_revenue"),
        per_unit(gross, F.col("valid_orders")).alias("aov"), ratio(F.col("returned_orders"), n).alias("return_rate"), ratio(F.col("cancelled_orders"), n).alias("cancel_rate"),
    ]


def as_of(ctx: Context) -> DataFrame:
    """The day of the last order, from which recency is counted."""
    return ctx("silver.fct_orders").agg(F.max("order_date").alias("as_of"))


def order_gaps(ctx: Context) -> DataFrame:
    """Mean days between the distinct order dates of a customer; without two dates there is no row."""
    days = ctx("silver.fct_orders").select("customer_id", "order_date").distinct()
    before = F.lag("order_date").over(Window.partitionBy("customer_id").orderBy("order_date"))
    return days.withColumn("before", before).filter("before is not null").groupBy("customer_id").agg(F.avg(days_between("before", "order_date")).alias("own_gap"))


def customer_orders(ctx: Context) -> DataFrame:
    """Each customer's orders in one pass, with the mean days between their distinct days (that of the first and last, divided; null without two)."""
    counts = ("orders", *[f"{s}_orders" for s in ("completed", "returned", "cancelled", "valid")])
    days = ctx("silver.fct_orders").groupBy("customer_id", "order_date").agg(*_status_counts(), sum_where(_valid(), F.col("total_amount")).alias("gross"), sum_where(_valid(), F.col("item_count")).alias("items"))
    gaps = F.count("order_date") - 1
    mean = days_between(F.min("order_date"), F.max("order_date")).cast("double") / gaps
    return days.groupBy("customer_id").agg(
        *[F.sum(c).alias(c) for c in (*counts, "gross", "items")], F.min("order_date").alias("first_order_date"), F.max("order_date").alias("last_order_date"), F.when(gaps > 0, mean).alias("own_gap"),
    )


#: Columns of the customer base that scores, segments and risks are derived from.
_MEASURES = ("customer_id", "total_orders", "valid_orders", "gross_revenue", "net_revenue", "recency_days", "gap")


def customer_base(ctx: Context, columns: Sequence[str] | None = None) -> DataFrame:
    """Each customer with all aggregates, or with the measures and ``columns`` only; every input is brought to customer grain before it is joined."""
    orders = customer_orders(ctx)
    if columns is not None and "items_purchased" not in columns:
        orders = orders.withColumn("items", F.lit(0))  # so items are not counted
    orders = materialised(orders, "customer-orders")  # read for the customers, and for the last day and the usual gap
    refunds = ctx("silver.fct_refunds").groupBy("customer_id").agg(F.sum("refund_amount").alias("refunded"))
    tickets = ctx("silver.fct_support_tickets").groupBy("customer_id").agg(F.count(F.lit(1)).alias("tickets"), count_where(F.col("status") == "open").alias("open"))
    events = ctx("silver.fct_web_events").filter("customer_id is not null").groupBy("customer_id").agg(F.count(F.lit(1)).alias("events"), count_where(F.col("event_type") == "add_to_cart").alias("carts"), F.max("event_date").alias("last_event_date"))
    c = ctx("silver.dim_customers")
    for part in (orders, refunds, tickets, events):
        c = c.join(part, "customer_id", "left")
    c = with_scalar(c, orders.agg(F.max("last_order_date").alias("as_of"), F.coalesce(F.avg("own_gap"), F.lit(1.0)).alias("usual_gap")))
    n = lambda name: F.coalesce(name, F.lit(0)).cast("long")
    gross, refunded = F.coalesce("gross", F.lit(0)), F.coalesce("refunded", F.lit(0))
    base = c.select(
        *ctx("silver.dim_customers").columns, n("orders").alias("total_orders"), *[n(f"{s}_orders").alias(f"{s}_orders") for s in ("completed", "returned", "cancelled", "valid")],
        "first_order_date", "last_order_date", money(gross, 14).alias("gross_revenue"), money(refunded, 14).alias("total_refunded"), money(gross - refunded, 14).alias("net_revenue"), n("items").alias("items_purchased"),
        days_between("last_order_date", "as_of").alias("recency_days"), F.coalesce("own_gap", "usual_gap").alias("gap"),
        n("tickets").alias("total_tickets"), n("open").alias("open_tickets"), n("events").alias("total_web_events"), n("carts").alias("cart_adds"), "last_event_date",
    )
    return base if columns is None else base.select(*[x for x in base.columns if x in _MEASURES or x in columns])


SCORED = {"r": "recency_days", "f": "valid_orders", "m": "net_revenue"}


def score_tiles(base: DataFrame, scores: Sequence[str] = tuple(SCORED), **limits: int) -> dict[str, Column]:
    """r, f and m as expressions: ntile(5) of customers with and of those without valid orders, by each of three measures.

    Ties go by customer_id and nulls last.  Only the last keys of the tiles are searched
    for, so no task sees a whole order and nothing is shuffled for the scores.
    """
    return tile_columns(base, 5, F.col("valid_orders") > 0, {s: F.col(SCORED[s]).cast("decimal(20,2)") for s in scores}, "customer_id", **limits)


# The segments and the risks, first match wins; the same texts define them in SQL.
SEGMENT_RULES = (
    ("total_orders = 0", "no_orders"),
    ("r = 5 AND f >= 4", "champion"),
    ("f >= 4 AND r >= 3", "loyal"),
    ("r >= 4", "new_or_returning"),
    ("r <= 2 AND f <= 2", "lost"),
    ("r <= 2", "hibernating"),
    ("f >= 3", "potential_loyalist"),
)
SEGMENT_ELSE = "needs_attention"
RISK_RULES = (("total_orders = 0", "none"), ("churn < 1.5", "low"), ("churn < 2.5", "medium"))
RISK_ELSE = "high"


def ladder(rules: tuple[tuple[str, str], ...], otherwise: str) -> str:
    """A CASE expression of rules."""
    return "CASE " + " ".join(f"WHEN {when} THEN '{label}'" for when, label in rules) + f" ELSE '{otherwise}' END"


def scored(ctx: Context, columns: Sequence[str] | None = None, scores: Sequence[str] = tuple(SCORED), **limits: int) -> DataFrame:
    """The customer base, or ``columns`` of it, with the scores r, f and m, or those asked for."""
    base = customer_base(ctx, columns)
    if not scores:
        return base
    base = materialised(base, "customer-base")  # read by the search for tiles and by the table
    tiles = score_tiles(base, scores, **limits)
    return base.withColumns(tiles | ({"r": 6 - tiles["r"]} if "r" in tiles else {}))


def customer_360(ctx: Context, columns: Sequence[str] | None = None) -> DataFrame:
    """One row for each customer, or ``columns`` of it without the work that only others need."""
    asked = lambda x: columns is None or x in columns
    c = ctx("silver.dim_customers")
    if columns is not None and set(columns) <= set(c.columns):
        return c.select(*columns)
    b = scored(ctx, columns, [s for s in SCORED if asked(f"{s}_score") or (s in "rf" and asked("rfm_segment"))])
    ever = F.col("total_orders") > 0
    b = b.withColumn("churn", F.when(ever, F.try_divide(F.col("recency_days").cast("double"), F.col("gap"))))
    derived = {
        "aov": per_unit(F.col("gross_revenue"), F.col("valid_orders")), "frequency": F.col("valid_orders"), "monetary": F.col("net_revenue"), **{f"{s}_score": F.when(ever, F.col(s)) for s in SCORED}, "rfm_segment": F.expr(ladder(SEGMENT_RULES, SEGMENT_ELSE)),
        "avg_order_gap_days": F.round("gap", 6), "churn_ratio": F.round("churn", 6), "churn_risk": F.expr(ladder(RISK_RULES, RISK_ELSE)),
    }
    names = (
        "customer_id", "first_name", "last_name", "email", "country", "city", "marketing_channel", "age", "signup_date", "total_orders", "completed_orders", "returned_orders", "cancelled_orders",
        "first_order_date", "last_order_date", "gross_revenue", "total_refunded", "net_revenue", "aov", "items_purchased", "recency_days", "frequency", "monetary", *[f"{s}_score" for s in SCORED], "rfm_segment",
        "avg_order_gap_days", "churn_ratio", "churn_risk", "total_tickets", "open_tickets", "total_web_events", "cart_adds", "last_event_date",
    )
    return b.select(*[derived.get(n, F.col(n)).alias(n) for n in names if asked(n)])


def revenue_by_channel(ctx: Context) -> DataFrame:
    """Month and channel of the order; refunds fall in the month of the refund."""
    o = ctx("silver.fct_orders")
    by = o.groupBy(month_of("order_date").alias("month"), "channel").agg(*_status_counts(), sum_where(_valid(), F.col("total_amount")).alias("gross"))
    refunds = ctx("silver.fct_refunds").join(o.select("order_id", "channel"), "order_id").groupBy(month_of("refund_date").alias("month"), "channel").agg(F.sum("refund_amount").alias("refunds"))
    return by.join(refunds, ["month", "channel"], "left").select("month", "channel", *_revenue_columns())


def revenue_by_category(ctx: Context) -> DataFrame:
    """Month and category of the order's items; an item of an id that several products have counts for each of them.

    So a month's gross revenue may be more than DECIMAL(14,2) holds, and is wider than that.
    """
    o = ctx("silver.fct_orders").filter(_valid()).select("order_id", month_of("order_date").alias("month"))
    items = ctx.weighted("silver.fct_order_items")
    if TIMES in items.columns:
        # The categories of a product id are listed once and unfold when items lie by order, so no shuffle sees the joined rows.
        kinds = ctx("silver.dim_products").groupBy("product_id", "category").agg(F.count(F.lit(1)).alias(TIMES)).groupBy("product_id").agg(F.collect_list(F.struct("category", TIMES)).alias("kinds"))
        items = items.select("order_id", "product_id", "quantity", "line_total").join(kinds, "product_id").join(o, "order_id").select("order_id", "month", "quantity", "line_total", F.inline("kinds"))
    else:
        items = items.join(o, "order_id").withColumn(TIMES, F.lit(1))
    times = F.col(TIMES).cast("decimal(10,0)")
    by_order = items.groupBy("order_id", "month", "category").agg(F.sum(F.col("quantity") * F.col(TIMES)).alias("units"), F.sum(F.col("line_total") * times).alias("gross"))
    g = by_order.groupBy("month", "category").agg(F.count(F.lit(1)).alias("orders"), F.sum("units").cast("long").alias("units"), F.sum("gross").alias("gross"))
    total = F.sum("gross").over(Window.partitionBy("month"))
    return g.select("month", "category", "orders", "units", money("gross", 22).alias("gross_revenue"), F.round(F.try_divide(100 * F.col("gross").cast("double"), total.cast("double")), 6).alias("revenue_share_pct"))


def category_gross(ctx: Context, columns: Sequence[str]) -> DataFrame:
    """``revenue_by_category`` where only its gross revenue is asked for: summed by product id, so that categories unfold for months and ids, not for items."""
    if not set(columns) <= {"month", "category", "gross_revenue"} or not ctx.unbuilt("silver.fct_order_items"):
        return revenue_by_category(ctx)
    o = ctx("silver.fct_orders").filter(_valid()).select("order_id", month_of("order_date").alias("month"))
    kinds = ctx("silver.dim_products").groupBy("product_id", "category").agg(F.count(F.lit(1)).alias(TIMES))
    sold = merged_items(ctx).select("order_id", "product_id", money("line_total").alias("line_total")).join(o, "order_id").groupBy("month", "product_id").agg(F.sum("line_total").alias("gross"))
    g = sold.join(kinds, "product_id").groupBy("month", "category").agg(F.sum(F.col("gross") * F.col(TIMES).cast("decimal(10,0)")).alias("gross"))
    return g.select("month", "category", money("gross", 22).alias("gross_revenue"))


def monthly_kpis(ctx: Context) -> DataFrame:
    o = ctx("silver.fct_orders")
    by = o.groupBy(month_of("order_date").alias("month")).agg(*_status_counts(), F.countDistinct("customer_id").alias("unique_customers"), sum_where(_valid(), F.col("total_amount")).alias("gross"))
    new = o.groupBy("customer_id").agg(F.min("order_date").alias("d")).groupBy(month_of("d").alias("month")).agg(F.count(F.lit(1)).alias("new"))
    refunds = ctx("silver.fct_refunds").groupBy(month_of("refund_date").alias("month")).agg(F.sum("refund_amount").alias("refunds"))
    fresh = F.coalesce("new", F.lit(0))
    return by.join(new, "month", "left").join(refunds, "month", "left").select("month", *_revenue_columns(), "unique_customers", fresh.alias("new_customers"), (F.col("unique_customers") - fresh).alias("returning_customers"))
