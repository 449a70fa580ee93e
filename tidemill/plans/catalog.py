"""Registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalar import REVENUE_BUCKETS, TOP_BUCKET, money
from . import marts
from .context import Context, driver_context
from .gold import ladder
from .oracle import oracle
from .specs import SPECS, stats

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def add(name: str, build: Callable[[Context], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(driver_context(spark, sf_dir))
    if sql:
        ORACLE[name] = oracle(sql)


_IDS = {"silver.dim_customers": "s01", "silver.dim_products": "s02", "silver.dim_order_dates": "s03", "silver.fct_orders": "s04", "silver.fct_order_items": "s05", "silver.fct_payments": "s06", "silver.fct_refunds": "s07", "silver.fct_web_events": "s08", "silver.fct_support_tickets": "s09", "gold.customer_360": "g01", "gold.revenue_by_channel": "g02", "gold.revenue_by_category": "g03", "gold.monthly_kpis": "g04"}
for _name, _id in _IDS.items():
    _layer, _, _table = _name.partition(".")
    add(f"{_id}_{_table}", lambda ctx, n=_name: ctx(n), f"SELECT * FROM {_layer[0]}_{_table}")
# The table's amounts are wider; the SQL asks for this type.
QUERIES["g03_revenue_by_category"] = lambda spark, sf_dir: driver_context(spark, sf_dir)("gold.revenue_by_category").withColumn("gross_revenue", money("gross_revenue", 14))


def _stats(layer: str, phase: str) -> Callable[[Context], DataFrame]:
    def build(ctx: Context) -> DataFrame:
        parts = [stats(ctx, s, phase) for s in SPECS.values() if s.layer == layer and getattr(s, phase)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    return build


def _rows(phase: str, *rows: tuple[str, str, str]) -> str:
    return "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, '{phase}' AS phase, '{label}' AS label, CAST(({value}) AS BIGINT) AS value" for t, label, value in rows)


def _n(what: str) -> str:
    return f"SELECT count(*) FROM {what}"


def _gone(raw: str, fact: str) -> str:
    return f"SELECT (SELECT count(*) FROM b_{raw}) + (SELECT count(*) FROM b_stream_{raw}) - (SELECT count(*) FROM s_{fact})"


_PRE = (
    ("silver.dim_customers", "bronze_rows", _n("b_customers")),
    ("silver.dim_customers", "duplicate_emails", "SELECT count(*) - count(DISTINCT lower(trim(email))) FROM b_customers"),
    ("silver.dim_products", "bronze_rows", _n("b_products")),
    ("silver.dim_products", "non_positive_prices", _n("b_products WHERE unit_price <= 0")),
    ("silver.dim_order_dates", "expected_days", "SELECT max(order_date) - min(order_date) + 1 FROM b_orders"),
    ("silver.fct_orders", "bronze_rows", _n("b_orders")),
    ("silver.fct_orders", "stream_rows", _n("b_stream_orders")),
    ("silver.fct_orders", "orphan_orders", _n("(SELECT customer_id FROM b_orders UNION ALL SELECT customer_id FROM b_stream_orders) o WHERE customer_id NOT IN (SELECT customer_id FROM b_customers)")),
    ("silver.fct_order_items", "bronze_rows", _n("b_order_items")),
    ("silver.fct_order_items", "stream_rows", _n("b_stream_order_items")),
    ("silver.fct_order_items", "orphan_items", _n("(SELECT order_id, product_id FROM b_order_items UNION ALL SELECT order_id, product_id FROM b_stream_order_items) i WHERE order_id NOT IN (SELECT order_id FROM b_orders UNION SELECT order_id FROM b_stream_orders) OR product_id NOT IN (SELECT product_id FROM b_products)")),
    ("silver.fct_payments", "bronze_rows", _n("b_payments")),
    ("silver.fct_payments", "stream_rows", _n("b_stream_payments")),
    ("silver.fct_payments", "duplicate_payments", "SELECT count(*) - count(DISTINCT order_id) FROM (SELECT order_id FROM b_payments UNION ALL SELECT order_id FROM b_stream_payments)"),
    ("silver.fct_refunds", "bronze_rows", _n("b_refunds")),
    ("silver.fct_web_events", "bronze_rows", _n("b_web_events")),
    ("silver.fct_web_events", "stream_rows", _n("b_stream_web_events")),
    ("silver.fct_web_events", "anonymous_rows", _n("b_web_events WHERE customer_id IS NULL")),
    ("silver.fct_support_tickets", "bronze_rows", _n("b_support_tickets")),
    ("silver.fct_support_tickets", "linked_rows", _n("b_support_tickets WHERE order_id IS NOT NULL")),
)
_POST = (
    ("silver.dim_customers", "email_collisions_after", "SELECT count(*) - count(DISTINCT email) FROM s_dim_customers"),
    ("silver.dim_customers", "null_emails", _n("s_dim_customers WHERE email IS NULL")),
    ("silver.dim_order_dates", "calendar_days", _n("s_dim_order_dates")),
    ("silver.fct_orders", "payment_conflicts", _n("s_fct_orders WHERE payment_status_conflict")),
    ("silver.fct_orders", "orders_without_payment", _n("s_fct_orders WHERE NOT has_payment")),
    ("silver.fct_orders", "duplicates_dropped", _gone("orders", "fct_orders")),
    ("silver.fct_order_items", "line_total_mismatches", _n("s_fct_order_items WHERE line_total_mismatch")),
    ("silver.fct_order_items", "duplicates_dropped", _gone("order_items", "fct_order_items")),
    ("silver.fct_payments", "duplicates_dropped", _gone("payments", "fct_payments")),
    ("silver.fct_payments", "amount_mismatches", _n("s_fct_payments WHERE amount_mismatch")),
    *[("silver.fct_payments", s, _n(f"s_fct_payments WHERE is_{s}")) for s in ("succeeded", "failed", "pending")],
    ("silver.fct_refunds", "full_refunds", _n("s_fct_refunds WHERE is_full_refund")),
    ("silver.fct_refunds", "min_refund_lag_days", "SELECT coalesce(min(refund_lag_days), 0) FROM s_fct_refunds"),
    ("silver.fct_refunds", "max_refund_lag_days", "SELECT coalesce(max(refund_lag_days), 0) FROM s_fct_refunds"),
    ("silver.fct_web_events", "anonymous_after", _n("s_fct_web_events WHERE is_anonymous")),
    ("silver.fct_web_events", "duplicates_dropped", _gone("web_events", "fct_web_events")),
    ("silver.fct_support_tickets", "invalid_linked_orders", _n("s_fct_support_tickets WHERE has_linked_order AND NOT linked_order_valid")),
)
_GOLD_POST = (
    ("gold.customer_360", "customers_with_orders", _n("g_customer_360 WHERE total_orders > 0")),
    ("gold.customer_360", "champions", _n("g_customer_360 WHERE rfm_segment = 'champion'")),
    ("gold.customer_360", "churn_high", _n("g_customer_360 WHERE churn_risk = 'high'")),
    ("gold.revenue_by_channel", "channels", "SELECT count(DISTINCT channel) FROM g_revenue_by_channel"),
    ("gold.revenue_by_channel", "months", "SELECT count(DISTINCT month) FROM g_revenue_by_channel"),
    ("gold.revenue_by_category", "categories", "SELECT count(DISTINCT category) FROM g_revenue_by_category"),
    ("gold.monthly_kpis", "months", "SELECT count(DISTINCT month) FROM g_monthly_kpis"),
)
add("s10_pre_stats", _stats("silver", "pre"), _rows("pre", *_PRE))
add("s10_post_stats", _stats("silver", "post"), _rows("post", *_POST))
add("g05_pre_stats", _stats("gold", "pre"), _rows("pre", ("gold.customer_360", "silver_customer_rows", _n("s_dim_customers"))))
add("g05_post_stats", _stats("gold", "post"), _rows("post", *_GOLD_POST))

# Serving queries, without filters and with all that they honour.
_MONEY = "CAST(sum({c}) AS DECIMAL(24,2))"
BUCKET_SQL = ladder(tuple((f"net_revenue {'<' if i else '<='} {bound}", label) for i, (bound, label) in enumerate(REVENUE_BUCKETS)), TOP_BUCKET)
MART_SQL = {
    "m01_kpi_customers": "SELECT count(*) AS value FROM g_customer_360 WHERE {cust}",
    "m02_kpi_orders": "SELECT CAST(sum(orders) AS BIGINT) AS value FROM g_revenue_by_channel WHERE {rev}",
    "m03_kpi_gmv": f"SELECT {_MONEY.format(c='gross_revenue')} AS value FROM g_revenue_by_channel WHERE {{rev}}",
    "m04_kpi_aov": "SELECT round(CAST(sum(net_revenue) AS DOUBLE) / CAST(sum(valid_orders) AS DOUBLE), 6) AS value FROM g_revenue_by_channel WHERE {rev}",
    "m05_ltv_distribution": f"SELECT {BUCKET_SQL} AS ltv_bucket, count(*) AS customers FROM g_customer_360 WHERE {{cust}} GROUP BY 1",
    "m06_churn_risk_mix": "SELECT churn_risk, count(*) AS customers FROM g_customer_360 WHERE {cust} GROUP BY 1",
    "m07_rfm_segment_mix": "SELECT rfm_segment, count(*) AS customers FROM g_customer_360 WHERE {cust} GROUP BY 1",
    "m08_revenue_trend": f"SELECT month, {_MONEY.format(c='gross_revenue')} AS gross_revenue, {_MONEY.format(c='net_revenue')} AS net_revenue FROM g_revenue_by_channel WHERE {{rev}} GROUP BY 1",
    "m09_channel_mix": f"SELECT channel, {_MONEY.format(c='net_revenue')} AS net_revenue FROM g_revenue_by_channel WHERE {{rev}} GROUP BY 1",
    "m10_category_mix": f"SELECT category, {_MONEY.format(c='gross_revenue')} AS gross_revenue FROM g_revenue_by_category WHERE {{months}} GROUP BY 1",
    "m11_customer_sample": f"""SELECT customer_id, first_name, last_name, country, city, age, marketing_channel, signup_date, total_orders, frequency AS valid_orders, gross_revenue, net_revenue, {BUCKET_SQL} AS ltv_bucket, rfm_segment, churn_risk, total_tickets, open_tickets, total_web_events
FROM g_customer_360 WHERE {{cust}} ORDER BY net_revenue DESC, customer_id LIMIT 25""",
}
FILTERS = {"channels": ["web", "pos"], "months": ("1996-01-01", "1998-12-01"), "acq_channels": ["building", "machinery"], "churn_risks": ["low", "high"], "search": "User.1"}
_FILTER_SQL = {"cust": "marketing_channel IN ('building', 'machinery') AND churn_risk IN ('low', 'high') AND contains(lower(first_name || ' ' || last_name || ' ' || email || ' ' || customer_id), 'user.1')", "months": "month BETWEEN DATE '1996-01-01' AND DATE '1998-12-01'"}
_FILTER_SQL["rev"] = f"channel IN ('web', 'pos') AND {_FILTER_SQL['months']}"
for _name, _sql in MART_SQL.items():
    add(_name, lambda ctx, n=_name[4:]: marts.mart(ctx, n), _sql.format(cust="true", rev="true", months="true"))
    add(f"{_name}_filtered", lambda ctx, n=_name[4:]: marts.mart(ctx, n, FILTERS), _sql.format(**_FILTER_SQL))
add("m12_mart_registry", lambda ctx: ctx.spark.createDataFrame([(n,) for n in sorted(marts.MARTS)], "mart string"), "SELECT unnest(['category_mix', 'channel_mix', 'churn_risk_mix', 'customer_sample', 'kpi_aov', 'kpi_customers', 'kpi_gmv', 'kpi_orders', 'ltv_distribution', 'revenue_trend', 'rfm_segment_mix']) AS mart")
add(
    "m13_filter_options",
    marts.filter_options,
    """SELECT DISTINCT 'channel' AS option, channel AS value FROM g_revenue_by_channel UNION ALL SELECT DISTINCT 'acquisition_channel', marketing_channel FROM g_customer_360 UNION ALL SELECT DISTINCT 'churn_risk', churn_risk FROM g_customer_360
UNION ALL SELECT 'first_month', CAST(min(month) AS VARCHAR) FROM g_revenue_by_channel UNION ALL SELECT 'last_month', CAST(max(month) AS VARCHAR) FROM g_revenue_by_channel""",
)
add("m14_trend_unpivot", marts.trend_series, f"SELECT month, 'Gross' AS series, {_MONEY.format(c='gross_revenue')} AS revenue FROM g_revenue_by_channel GROUP BY 1 UNION ALL SELECT month, 'Net', {_MONEY.format(c='net_revenue')} FROM g_revenue_by_channel GROUP BY 1")
add("m15_stream_counts", marts.stream_counts, "SELECT (SELECT count(*) FROM b_stream_web_events) AS stream_rows, (SELECT max(event_id) FROM b_stream_web_events) AS newest_event_id, (SELECT max(event_date) FROM b_stream_web_events WHERE event_id = (SELECT max(event_id) FROM b_stream_web_events)) AS newest_event_date, (SELECT count(*) FROM b_web_events) AS batch_rows, (SELECT count(*) FROM s_fct_web_events) AS fact_rows")
add("m16_latest_events", lambda ctx: marts.latest(ctx, "bronze.stream_web_events", "event_id"), "SELECT * FROM b_stream_web_events ORDER BY event_id DESC LIMIT 15")
add("m16_latest_orders", lambda ctx: marts.latest(ctx, "bronze.stream_orders", "order_id"), "SELECT * FROM b_stream_orders ORDER BY order_id DESC LIMIT 15")
add("m18_top5_customers", marts.top_customers, "SELECT customer_id, count(DISTINCT order_id) AS orders, CAST(sum(CAST(line_total AS DECIMAL(14,2))) AS DECIMAL(18,2)) AS revenue FROM b_order_items JOIN b_orders USING (order_id) JOIN b_customers USING (customer_id) GROUP BY 1 ORDER BY revenue DESC, customer_id LIMIT 5")
