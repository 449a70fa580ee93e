"""Registered queries for single operators, checks, verifiers, streams, storage and the generator."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import functions as fn
from ..operators import relational as ops
from ..sources import landing
from ..sources.schemas import STREAMS, describe
from ..sources.scratch import scratch
from ..sources.versioned import Store
from ..streaming import ingest, monitor, producer
from . import gold, marts, quality, silver, verify
from .catalog import BUCKET_SQL, ORACLE, QUERIES, add
from .context import Context, driver_context
from .oracle import oracle

# --- projections, filters, predicates ------------------------------------------------
add("pf01_projection", lambda c: c("bronze.customers").select(F.col("customer_id").alias("id"), "country", F.col("age").alias("years")), "SELECT customer_id AS id, country, age AS years FROM b_customers")
add("pf02_star_plus_derived", lambda c: c("bronze.products").select("*", (F.col("unit_price") > 1000).alias("expensive")), "SELECT *, unit_price > 1000 AS expensive FROM b_products")
add("pf03_comparison", lambda c: c("bronze.products").filter("unit_price > 1500").select("product_id"), "SELECT product_id FROM b_products WHERE unit_price > 1500")
add("pf04_null_test", lambda c: c("bronze.web_events").select("event_id", F.col("customer_id").isNull().alias("anonymous"), F.col("category").isNotNull().alias("has_category")), "SELECT event_id, customer_id IS NULL AS anonymous, category IS NOT NULL AS has_category FROM b_web_events")
add("pf05_in_list", lambda c: c("gold.customer_360").filter(F.col("churn_risk").isin("low", "medium") & ~F.col("rfm_segment").isin("lost", "hibernating")).select("customer_id"), "SELECT customer_id FROM g_customer_360 WHERE churn_risk IN ('low', 'medium') AND rfm_segment NOT IN ('lost', 'hibernating')")
add("pf06_between", lambda c: c("bronze.orders").filter(F.col("order_date").between(dt.date(1996, 1, 1), dt.date(1996, 12, 31)) & ~F.col("total_amount").between(1, 100000)).select("order_id"), "SELECT order_id FROM b_orders WHERE order_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND total_amount NOT BETWEEN 1 AND 100000")
add("pf07_boolean_logic", lambda c: c("silver.fct_support_tickets").filter((F.col("has_linked_order") & ~F.col("linked_order_valid")) | (F.col("status") == "open")).select("ticket_id"), "SELECT ticket_id FROM s_fct_support_tickets WHERE (has_linked_order AND NOT linked_order_valid) OR status = 'open'")
add("pf08_search", lambda c: c("gold.customer_360").filter(marts.customer_filter({"search": "USER.12"})).select("customer_id"), "SELECT customer_id FROM g_customer_360 WHERE contains(lower(concat_ws(' ', first_name, last_name, email, customer_id)), 'user.12')")
add("pf09_case_bucket", lambda c: c("gold.customer_360").select("customer_id", fn.bucket_revenue(F.col("net_revenue")).alias("bucket")), f"SELECT customer_id, {BUCKET_SQL} AS bucket FROM g_customer_360")
add("pf10_case_without_else", lambda c: c("gold.customer_360").select("customer_id", F.when(F.col("total_orders") > 3, F.col("recency_days")).alias("recency_of_regulars")), "SELECT customer_id, CASE WHEN total_orders > 3 THEN recency_days END AS recency_of_regulars FROM g_customer_360")
add("pf11_boolean_values", lambda c: c("silver.fct_orders").select("order_id", (F.col("is_cancelled") != F.col("is_payment_succeeded")).alias("either"), (F.col("order_status") == F.col("channel")).alias("same")), "SELECT order_id, is_cancelled <> is_payment_succeeded AS either, order_status = channel AS same FROM s_fct_orders")
add("pf12_conjunction", lambda c: c("gold.revenue_by_channel").filter(marts.revenue_filter({"channels": [], "months": ("1997-01-01", "1997-06-01")})).select("month", "channel"), "SELECT month, channel FROM g_revenue_by_channel WHERE month BETWEEN DATE '1997-01-01' AND DATE '1997-06-01'")
add("pf13_quoted_literal", lambda c: c("bronze.customers").select("customer_id").filter(F.col("customer_id") != "O'Brien").filter(ops.all_of([])), "SELECT customer_id FROM b_customers WHERE customer_id <> 'O''Brien'")
add("pf14_source_rank", lambda c: ops.ranked_union(c("bronze.payments"), c("bronze.stream_payments")).groupBy("src_rank").agg(F.count(F.lit(1)).alias("n")), "SELECT CAST(1 AS INTEGER) AS src_rank, count(*) AS n FROM b_payments UNION ALL SELECT 2, count(*) FROM b_stream_payments")

# --- joins ---------------------------------------------------------------------------
add("j01_inner", lambda c: c("bronze.order_items").join(c("bronze.orders").select("order_id", "channel"), "order_id").select("order_item_id", "channel"), "SELECT order_item_id, channel FROM b_order_items JOIN b_orders USING (order_id)")
add("j02_left", lambda c: c("bronze.customers").select("customer_id").join(c("bronze.orders").select("customer_id", "order_id"), "customer_id", "left"), "SELECT customer_id, order_id FROM b_customers LEFT JOIN b_orders USING (customer_id)")
add("j03_composite_key", lambda c: c("bronze.support_tickets").join(c("bronze.orders").select("order_id", "customer_id", "channel"), ["order_id", "customer_id"], "left").select("ticket_id", "channel"), "SELECT t.ticket_id, o.channel FROM b_support_tickets t LEFT JOIN b_orders o ON o.order_id = t.order_id AND o.customer_id = t.customer_id")
add("j04_month_channel_grain", lambda c: c("gold.revenue_by_channel").select("month", "channel").join(c("gold.monthly_kpis").select("month", "orders"), "month", "left"), "SELECT c.month, c.channel, k.orders FROM g_revenue_by_channel c LEFT JOIN g_monthly_kpis k ON k.month = c.month")
add("j05_one_row_cross", lambda c: ops.with_scalar(c("silver.fct_orders").select("order_id", "order_date"), gold.as_of(c)), "SELECT order_id, order_date, (SELECT max(order_date) FROM s_fct_orders) AS as_of FROM s_fct_orders")
add("j06_anti_join", lambda c: ops.orphans(c("bronze.order_items"), c("bronze.orders"), "order_id").select("order_item_id"), "SELECT i.order_item_id FROM b_order_items i LEFT JOIN b_orders o ON o.order_id = i.order_id WHERE o.order_id IS NULL")
add("j06_anti_join_nullable", lambda c: ops.orphans(c("bronze.support_tickets"), c("bronze.orders"), "order_id", nullable=True).select("ticket_id"), "SELECT ticket_id FROM b_support_tickets WHERE order_id IS NOT NULL AND order_id NOT IN (SELECT order_id FROM b_orders)")
add("j07_not_exists_or", lambda c: c("bronze.order_items").join(c("bronze.orders").select("order_id", F.lit(1).alias("o")).distinct(), "order_id", "left").join(c("silver.dim_products").filter("unit_price < 1500").select("product_id", F.lit(1).alias("p")).distinct(), "product_id", "left").filter("o is null or p is null").select("order_item_id"), "SELECT order_item_id FROM b_order_items i WHERE NOT EXISTS (SELECT 1 FROM b_orders o WHERE o.order_id = i.order_id) OR NOT EXISTS (SELECT 1 FROM s_dim_products p WHERE p.product_id = i.product_id AND p.unit_price < 1500)")
add("j08_semi_join_union", lambda c: c("bronze.order_items").join(c("bronze.orders").select("order_id").union(c("bronze.stream_orders").select("order_id")).distinct(), "order_id", "left_semi").select("order_item_id"), "SELECT order_item_id FROM b_order_items WHERE order_id IN (SELECT order_id FROM b_orders UNION SELECT order_id FROM b_stream_orders)")
add("j09_scalar_subquery", lambda c: ops.with_scalar(c("bronze.orders").select("order_id", "total_amount"), c("bronze.orders").agg(F.max("total_amount").alias("most"))).filter("total_amount * 2 > most").select("order_id"), "SELECT order_id FROM b_orders WHERE total_amount * 2 > (SELECT max(total_amount) FROM b_orders)")
add("j10_generated_bounds", lambda c: c("bronze.refunds").agg(F.min("refund_date").alias("a"), F.max("refund_date").alias("z")).select(F.explode(F.sequence("a", "z")).alias("d")), "SELECT CAST(unnest(generate_series(min(refund_date), max(refund_date), INTERVAL 1 DAY)) AS DATE) AS d FROM b_refunds")
add("j11_star_join", lambda c: gold.customer_base(c, ("total_refunded", "total_tickets", "total_web_events")).select("customer_id", "total_orders", "total_refunded", "total_tickets", "total_web_events", F.round("gap", 6).alias("gap")), "SELECT customer_id, total_orders, total_refunded, total_tickets, total_web_events, round(gap, 6) AS gap FROM x_base")
add("j12_join_group_top", lambda c: marts.top_customers(c, 3), "SELECT customer_id, count(DISTINCT order_id) AS orders, CAST(sum(CAST(line_total AS DECIMAL(14,2))) AS DECIMAL(18,2)) AS revenue FROM b_order_items JOIN b_orders USING (order_id) JOIN b_customers USING (customer_id) GROUP BY 1 ORDER BY revenue DESC, customer_id LIMIT 3")
add("j13_named_steps", lambda c: silver.merged_orders(c).join(silver.item_counts(c), "order_id").select("order_id", "item_count"), "SELECT order_id, count(*) AS item_count FROM m_orders JOIN m_items USING (order_id) GROUP BY 1")

# --- aggregations --------------------------------------------------------------------
add("a01_count", lambda c: c("silver.fct_web_events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "SELECT event_type, count(*) AS n FROM s_fct_web_events GROUP BY 1")
add("a02_count_distinct", lambda c: c("silver.fct_orders").groupBy("channel").agg(F.countDistinct("customer_id").alias("customers")), "SELECT channel, count(DISTINCT customer_id) AS customers FROM s_fct_orders GROUP BY 1")
add("a03_duplicate_counter", lambda c: ops.ranked_union(c("bronze.orders"), c("bronze.stream_orders")).agg((F.count(F.lit(1)) - F.countDistinct("order_id")).alias("duplicates")), "SELECT count(*) - count(DISTINCT order_id) AS duplicates FROM (SELECT order_id FROM b_orders UNION ALL SELECT order_id FROM b_stream_orders)")
add("a04_basic", lambda c: c("silver.fct_orders").groupBy("channel").agg(F.sum("total_amount").cast("decimal(24,2)").alias("total"), F.min("order_date").alias("first"), F.max("order_date").alias("last"), F.round(F.avg(F.col("item_count").cast("double")), 6).alias("mean_items")), "SELECT channel, CAST(sum(total_amount) AS DECIMAL(24,2)) AS total, min(order_date) AS first, max(order_date) AS last, round(avg(item_count), 6) AS mean_items FROM s_fct_orders GROUP BY 1")
add("a05_filtered", lambda c: c("silver.fct_orders").groupBy("channel").agg(ops.count_where(F.col("is_returned")).alias("returned"), F.sum(F.when(F.col("is_returned"), F.col("total_amount"))).cast("decimal(24,2)").alias("returned_total"), F.max(F.when(F.col("is_cancelled"), F.col("order_date"))).alias("last_cancelled")), "SELECT channel, count(*) FILTER (WHERE is_returned) AS returned, CAST(sum(total_amount) FILTER (WHERE is_returned) AS DECIMAL(24,2)) AS returned_total, max(order_date) FILTER (WHERE is_cancelled) AS last_cancelled FROM s_fct_orders GROUP BY 1")
add("a06_empty_default", lambda c: c("silver.fct_orders").groupBy("customer_id").agg(ops.sum_where(F.col("is_returned"), F.col("total_amount")).cast("decimal(24,2)").alias("returned_total")), "SELECT customer_id, CAST(coalesce(sum(total_amount) FILTER (WHERE is_returned), 0) AS DECIMAL(24,2)) AS returned_total FROM s_fct_orders GROUP BY 1")
add("a07_group_by_expression", lambda c: c("bronze.web_events").groupBy(fn.month_of("event_date").alias("month"), fn.enum("device").alias("device")).agg(F.count(F.lit(1)).alias("n")), "SELECT CAST(date_trunc('month', event_date) AS DATE) AS month, lower(trim(device)) AS device, count(*) AS n FROM b_web_events GROUP BY 1, 2")
add("a08_having", lambda c: ops.duplicate_keys(c("bronze.order_items"), ["order_id", "product_id"]), "SELECT order_id, product_id, count(*) AS n FROM b_order_items GROUP BY 1, 2 HAVING count(*) > 1")
add("a09_distinct", lambda c: c("silver.fct_orders").select("customer_id", "order_date").distinct(), "SELECT DISTINCT customer_id, order_date FROM s_fct_orders")
add("a10_distinct_over_union", lambda c: c("bronze.orders").select("order_id").union(c("bronze.stream_orders").select("order_id")).distinct(), "SELECT order_id FROM (SELECT order_id FROM b_orders UNION ALL SELECT order_id FROM b_stream_orders) GROUP BY 1")
add("a11_two_levels", lambda c: gold.order_gaps(c).agg(F.round(F.avg("own_gap"), 6).alias("usual_gap")), "SELECT round(avg(gap), 6) AS usual_gap FROM x_gaps")
add("a12_aggregate_in_window", lambda c: c("gold.revenue_by_category").select("month", "category", F.sum("gross_revenue").over(Window.partitionBy("month")).cast("decimal(24,2)").alias("month_total")), "SELECT month, category, CAST(sum(sum(gross_revenue)) OVER (PARTITION BY month) AS DECIMAL(24,2)) AS month_total FROM g_revenue_by_category GROUP BY month, category")
add("a13_ratio_of_sums", lambda c: c("gold.revenue_by_channel").groupBy("channel").agg(fn.ratio(F.sum("net_revenue"), F.sum("valid_orders")).alias("net_per_order")), "SELECT channel, round(CAST(sum(net_revenue) AS DOUBLE) / CAST(sum(valid_orders) AS DOUBLE), 6) AS net_per_order FROM g_revenue_by_channel GROUP BY 1")
add("a14_stddev", lambda c: c("gold.monthly_kpis").agg(F.round(F.stddev(F.col("orders").cast("double")), 6).alias("sd")), "SELECT round(stddev_samp(orders), 6) AS sd FROM g_monthly_kpis")
add("a15_totals_joined_back", lambda c: c("bronze.orders").select("order_id").join(c("bronze.order_items").groupBy("order_id").agg(F.sum(fn.money("line_total")).alias("t")), "order_id", "left").select("order_id", F.coalesce("t", F.lit(0)).cast("decimal(14,2)").alias("total")), "SELECT order_id, CAST(coalesce(t, 0) AS DECIMAL(14,2)) AS total FROM b_orders LEFT JOIN (SELECT order_id, sum(CAST(line_total AS DECIMAL(12,2))) AS t FROM b_order_items GROUP BY 1) USING (order_id)")

# --- windows, sorting, sets ----------------------------------------------------------
add("w01_keep_first", lambda c: ops.keep_first(c("bronze.orders"), ["customer_id"], ["order_date", "order_id"]).select("customer_id", "order_id"), "SELECT customer_id, order_id FROM b_orders QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_id) = 1")
add("w02_lag_gap", lambda c: gold.order_gaps(c).select("customer_id", F.round("own_gap", 6).alias("gap")), "SELECT customer_id, round(gap, 6) AS gap FROM x_gaps")
add("w03_ntile", lambda c: c("gold.customer_360").select("customer_id", "r_score", "f_score", "m_score"), "SELECT customer_id, r_score, f_score, m_score FROM g_customer_360")
add("w04_share_of_total", lambda c: c("gold.revenue_by_category").select("month", "category", "revenue_share_pct"), "SELECT month, category, revenue_share_pct FROM g_revenue_by_category")
add("w05_z_score", lambda c: quality.monthly_z(quality.Period(end=dt.date(2001, 12, 31)))(c), "SELECT round(max(abs(g - mean) / sd), 6) AS z FROM (SELECT CAST(gross_revenue AS DOUBLE) AS g, avg(CAST(gross_revenue AS DOUBLE)) OVER () AS mean, stddev_samp(CAST(gross_revenue AS DOUBLE)) OVER () AS sd FROM g_monthly_kpis WHERE month <= DATE '2001-12-31')")
add("l01_top25", lambda c: c("gold.customer_360").orderBy(F.desc("net_revenue"), "customer_id").limit(25).select("customer_id", "net_revenue"), "SELECT customer_id, net_revenue FROM g_customer_360 ORDER BY net_revenue DESC, customer_id LIMIT 25")
add("l02_latest", lambda c: marts.latest(c, "bronze.stream_payments", "payment_id", 7), "SELECT * FROM b_stream_payments ORDER BY payment_id DESC LIMIT 7")
add("l03_top5", lambda c: marts.top_customers(c, 5).select("customer_id", "revenue"), "SELECT customer_id, CAST(sum(CAST(line_total AS DECIMAL(14,2))) AS DECIMAL(18,2)) AS revenue FROM b_order_items JOIN b_orders USING (order_id) JOIN b_customers USING (customer_id) GROUP BY 1 ORDER BY revenue DESC, customer_id LIMIT 5")
add("l04_ordered_options", lambda c: c("silver.fct_orders").select("channel").distinct().orderBy("channel"), "SELECT DISTINCT channel FROM s_fct_orders ORDER BY 1")
add("l05_sorted_result", lambda c: c("gold.monthly_kpis").orderBy("month").select("month", "orders"), "SELECT month, orders FROM g_monthly_kpis ORDER BY month")
add("u01_union_all", lambda c: c("bronze.orders").unionByName(c("bronze.stream_orders")), "SELECT * FROM b_orders UNION ALL SELECT * FROM b_stream_orders")
add("u02_union_distinct", lambda c: c("bronze.web_events").select("event_id").union(c("bronze.stream_web_events").select("event_id")).distinct(), "SELECT event_id FROM b_web_events UNION SELECT event_id FROM b_stream_web_events")
add("u03_intersect", lambda c: c("bronze.orders").select("order_id").intersect(c("bronze.stream_orders").select("order_id")), "SELECT order_id FROM b_orders INTERSECT SELECT order_id FROM b_stream_orders")
add("u04_merge_dedup", lambda c: silver.merged_items(c), "SELECT * FROM m_items")
add("u05_live_suffix", lambda c: ops.only_in_left(c("bronze.stream_orders"), c("bronze.orders"), "order_id").select("order_id"), "SELECT order_id FROM b_stream_orders WHERE order_id NOT IN (SELECT order_id FROM b_orders)")

# --- scalar functions ----------------------------------------------------------------
_D = "SELECT DISTINCT order_date AS d FROM b_orders"
_dates = lambda c: c("bronze.orders").select(F.col("order_date").alias("d")).distinct()
add("f01_clean", lambda c: c("bronze.customers").select("customer_id", fn.clean("first_name").alias("first_name"), fn.enum("email").alias("email")), "SELECT customer_id, trim(first_name) AS first_name, lower(trim(email)) AS email FROM b_customers")
add("f03_concat", lambda c: c("bronze.web_events").select("event_id", F.concat("customer_id", F.lit("/"), "device").alias("visitor")), "SELECT event_id, customer_id || '/' || device AS visitor FROM b_web_events")
add("f04_money", lambda c: c("bronze.products").select("product_id", fn.money("unit_price").alias("price"), fn.money(fn.money("unit_price"), 14).alias("wide_price")), "SELECT product_id, CAST(unit_price AS DECIMAL(12,2)) AS price, CAST(CAST(unit_price AS DECIMAL(12,2)) AS DECIMAL(14,2)) AS wide_price FROM b_products")
add("f05_coalesce", lambda c: c("bronze.web_events").select("event_id", F.coalesce("customer_id", F.lit("anonymous")).alias("who")), "SELECT event_id, coalesce(customer_id, 'anonymous') AS who FROM b_web_events")
add("f06_days_between", lambda c: c("silver.fct_refunds").select("refund_id", fn.days_between("order_date", "refund_date").alias("days")), "SELECT refund_id, date_diff('day', order_date, refund_date) AS days FROM s_fct_refunds")
add("f07_month", lambda c: _dates(c).select("d", fn.month_of("d").alias("month")), f"SELECT d, CAST(date_trunc('month', d) AS DATE) AS month FROM ({_D})")
add("f08_date_parts", lambda c: _dates(c).select("d", F.year("d").alias("y"), F.month("d").alias("m"), F.quarter("d").alias("q")), f"SELECT d, CAST(year(d) AS INTEGER) AS y, CAST(month(d) AS INTEGER) AS m, CAST(quarter(d) AS INTEGER) AS q FROM ({_D})")
add("f09_weekday", lambda c: _dates(c).select("d", fn.iso_weekday("d").alias("n"), fn.day_name("d").alias("name")), f"SELECT d, isodow(d) AS n, dayname(d) AS name FROM ({_D})")
add("f11_sequence", lambda c: c("bronze.orders").groupBy(fn.month_of("order_date").alias("m")).agg(F.min("order_date").alias("a"), F.max("order_date").alias("z")).select("m", F.explode(F.sequence("a", "z")).alias("d")), "SELECT m, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT CAST(date_trunc('month', order_date) AS DATE) AS m, min(order_date) AS a, max(order_date) AS z FROM b_orders GROUP BY 1)")
add("f12_date_literal", lambda c: c("bronze.orders").filter(F.col("order_date") >= F.lit(dt.date(2001, 1, 1))).select("order_id"), "SELECT order_id FROM b_orders WHERE order_date >= DATE '2001-01-01'")
add("f13_arithmetic", lambda c: c("gold.revenue_by_channel").select("month", "channel", fn.ratio(100 * F.col("returned_orders"), F.col("orders")).alias("pct"), (F.col("orders") - F.col("valid_orders")).alias("lost")), "SELECT month, channel, round(100 * returned_orders / CAST(orders AS DOUBLE), 6) AS pct, orders - valid_orders AS lost FROM g_revenue_by_channel")
add("f14_abs", lambda c: c("silver.fct_refunds").select("refund_id", F.abs(F.col("refund_amount") - F.col("order_total")).cast("decimal(14,2)").alias("gap")), "SELECT refund_id, CAST(abs(refund_amount - order_total) AS DECIMAL(14,2)) AS gap FROM s_fct_refunds")
add("f15_round", lambda c: c("silver.fct_orders").select("order_id", F.round(F.col("total_amount"), 0).cast("decimal(14,0)").alias("whole")), "SELECT order_id, CAST(round(total_amount, 0) AS DECIMAL(14,0)) AS whole FROM s_fct_orders")
add("f16_boolean_equals", lambda c: c("silver.fct_orders").filter(F.col("payment_status_conflict") == F.lit(False)).select("order_id"), "SELECT order_id FROM s_fct_orders WHERE payment_status_conflict = false")
add("f17_text_forms", lambda c: c("bronze.orders").select("order_id", F.initcap(fn.clean("channel")).alias("label"), F.date_format("order_date", "yyyy-MM-dd").alias("iso")), "SELECT order_id, upper(substr(channel, 1, 1)) || lower(substr(channel, 2)) AS label, CAST(order_date AS VARCHAR) AS iso FROM b_orders")
add("f18_row_digest", lambda c: c("bronze.support_tickets").select("ticket_id", fn.row_digest(["ticket_id", "customer_id", "order_id"]).alias("digest")), "SELECT ticket_id, sha256(concat_ws('|', '=' || ticket_id, '=' || customer_id, coalesce('=' || order_id, 'NULL'))) AS digest FROM b_support_tickets")
add("f19_padded_id", lambda c: c("bronze.orders").select("order_id", fn.padded_id("X", fn.id_number("order_id"), 9).alias("wide")), "SELECT order_id, 'X-' || lpad(CAST(CAST(substr(order_id, 5) AS BIGINT) AS VARCHAR), 9, '0') AS wide FROM b_orders")
add("f20_unpivot", lambda c: ops.unpivot(c("gold.monthly_kpis").select("month", "orders", "valid_orders"), ["month"], ["orders", "valid_orders"], "measure", "n"), "SELECT month, 'orders' AS measure, orders AS n FROM g_monthly_kpis UNION ALL SELECT month, 'valid_orders', valid_orders FROM g_monthly_kpis")

# --- checks --------------------------------------------------------------------------


def _values(*rows: tuple[str, str, str]) -> str:
    return "\nUNION ALL ".join(f"SELECT '{key}' AS check_key, '{measure}' AS measure, CAST(({sql}) AS VARCHAR) AS value" for key, measure, sql in rows)


def _span(key: str, table: str, column: str) -> list[tuple[str, str, str]]:
    return [(key, "mn", f"SELECT min({column}) FROM {table}"), (key, "mx", f"SELECT max({column}) FROM {table}")]


def _twice(table: str, keys: str) -> str:
    return f"SELECT count(*) FROM (SELECT {keys} FROM {table} GROUP BY {keys} HAVING count(*) > 1)"


def _known(child: str, key: str, parent: str, more: str = "") -> str:
    return f"SELECT count(*) FROM {child} c WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{key}){more}"


_G = quality.GATE
_K = quality.KEYS
_DQ = {
    "dq01_bronze_not_empty": [(f"bronze.{t}.not_empty", "n", f"SELECT count(*) FROM b_{t}") for t in _K],
    "dq02_bronze_key_unique": [(f"bronze.{t}.key_unique", "n", _twice(f"b_{t}", k)) for t, k in _K.items()],
    "dq03_bronze_manifest_rows": [(f"bronze.{t}.manifest_rows", "n", f"SELECT count(*) FROM b_{t}") for t in _K],
    "dq04_bronze_date_range": [r for t in ("orders", "payments", "web_events", "refunds", "support_tickets") for r in _span(f"bronze.{t}.date_range", f"b_{t}", quality.DATES[t])],
    "dq05_bronze_fk": [(f"bronze.{_G}.{c}_{k}_known", "n", _known(f"b_{c}", k, f"b_{p}")) for c, k, p in quality.RAW_PARENTS],
    "dq06_stream_key_unique": [(f"bronze.stream_{t}.key_unique", "n", _twice(f"b_stream_{t}", _K[t])) for t in STREAMS],
    "dq07_stream_consumer_lag": [(f"bronze.stream_{t}.consumer_lag", "n", f"SELECT count(*) FROM b_stream_{t}") for t in STREAMS],
    "dq08_stream_date_range": [r for t in ("web_events", "orders", "payments") for r in _span(f"bronze.stream_{t}.date_range", f"b_stream_{t}", quality.DATES[t])],
    "dq09_cross_source_duplicates": [(f"bronze.{_G}.{t}_in_both_sources", "n", f"SELECT count(*) FROM (SELECT {_K[t]} FROM b_{t} INTERSECT SELECT {_K[t]} FROM b_stream_{t})") for t in STREAMS],
    "dq10_silver_not_empty": [(f"silver.{t}.not_empty", "n", f"SELECT count(*) FROM s_{t}") for t in quality.SILVER],
    "dq11_silver_key_unique": [(f"silver.{t}.key_unique", "n", _twice(f"s_{t}", k)) for t, k in quality.SILVER_KEYS.items()],
    "dq12_silver_not_null": [(f"silver.{t}.{x}_not_null", "n", f"SELECT count(*) FROM s_{t} WHERE {x} IS NULL") for t, x in quality.NOT_NULL.items()],
    "dq13_silver_fk": [(f"silver.{_G}.{c}_{k}_known", "n", _known(f"s_{c}", k, f"s_{p}")) for c, k, p in quality.FACT_PARENTS],
    "dq14_business_rules": [(f"silver.{t}.{n}", "n", f"SELECT count(*) FROM s_{t} WHERE {v}") for t, n, v in quality.RULES],
    "dq15_silver_date_range": [r for t, x in (("fct_orders", "order_date"), ("fct_web_events", "event_date"), ("fct_payments", "payment_date")) for r in _span(f"silver.{t}.date_range", f"s_{t}", x)],
    "dq16_stream_fk": [
        (f"silver.{_G}.stream_web_events_customer_known", "n", _known("b_stream_web_events", "customer_id", "b_customers", " AND c.customer_id IS NOT NULL")),
        (f"silver.{_G}.stream_orders_customer_known", "n", _known("b_stream_orders", "customer_id", "b_customers")),
        (f"silver.{_G}.stream_order_items_product_known", "n", _known("b_stream_order_items", "product_id", "b_products")),
    ],
    "dq17_merge_reconcile": [(f"silver.{_G}.{f}_reconciles", "ok", f"SELECT (SELECT count(*) FROM (SELECT {_K[t]} FROM b_{t} UNION SELECT {_K[t]} FROM b_stream_{t})) = (SELECT count(*) FROM s_{f})") for t, f in quality.MERGED.items()],
    "dq18_gold_not_empty": [(f"gold.{t}.not_empty", "n", f"SELECT count(*) FROM g_{t}") for t in quality.GOLD],
    "dq19_customer_unique": [("gold.customer_360.customer_unique", "n", _twice("g_customer_360", "customer_id"))],
    "dq20_one_row_per_customer": [(f"gold.{_G}.one_row_per_customer", "ok", "SELECT (SELECT count(*) FROM g_customer_360) = (SELECT count(*) FROM s_dim_customers)")],
    "dq21_score_range": [("gold.customer_360.score_range", "n", "SELECT count(*) FROM g_customer_360 WHERE r_score NOT BETWEEN 1 AND 5 OR f_score NOT BETWEEN 1 AND 5 OR m_score NOT BETWEEN 1 AND 5")],
    "dq22_domains": [("gold.customer_360.segment_domain", "n", f"SELECT count(*) FROM g_customer_360 WHERE rfm_segment NOT IN {quality.SEGMENTS}"), ("gold.customer_360.churn_domain", "n", f"SELECT count(*) FROM g_customer_360 WHERE churn_risk NOT IN {quality.RISKS}")],
    "dq23_revenue_invariant": [
        (f"gold.{_G}.revenue_invariant", name, f"SELECT CAST(sum({x}) AS DECIMAL(18,2)) FROM {t}")
        for name, x, t in (("orders", "total_amount", "s_fct_orders WHERE NOT is_cancelled"), ("items", "line_total", "s_fct_order_items WHERE order_id IN (SELECT order_id FROM s_fct_orders WHERE NOT is_cancelled)"), ("customers", "gross_revenue", "g_customer_360"), ("channels", "gross_revenue", "g_revenue_by_channel"), ("months", "gross_revenue", "g_monthly_kpis"))
    ],
    "dq24_monthly_freshness": [("gold.monthly_kpis.freshness", "mx", "SELECT max(month) FROM g_monthly_kpis")],
    "dq25_reconcile": [(f"gold.{_G}.orders_reconcile", "ok", "SELECT (SELECT sum(orders) FROM g_monthly_kpis) = (SELECT count(*) FROM s_fct_orders)"), (f"gold.{_G}.new_customers_reconcile", "ok", "SELECT (SELECT sum(new_customers) FROM g_monthly_kpis) = (SELECT count(DISTINCT customer_id) FROM s_fct_orders)")],
    "dq26_monthly_anomaly": [("gold.monthly_kpis.monthly_anomaly", "z", "SELECT round(max(abs(g - mean) / sd), 6) FROM (SELECT CAST(gross_revenue AS DOUBLE) AS g, avg(CAST(gross_revenue AS DOUBLE)) OVER () AS mean, stddev_samp(CAST(gross_revenue AS DOUBLE)) OVER () AS sd FROM g_monthly_kpis WHERE month <= DATE '2024-12-31')")],
    "dq27_mart_keys": [("gold.revenue_by_channel.key_unique", "n", _twice("g_revenue_by_channel", "month, channel")), ("gold.revenue_by_category.key_unique", "n", _twice("g_revenue_by_category", "month, category"))],
}
for _name, _rows in _DQ.items():
    add(_name, lambda c, f=_name[:4]: quality.probe_values(c, f), _values(*_rows))


def check_report(c: Context, missing: int = 0, behind: int = 0, only: tuple[str, ...] = ()) -> DataFrame:
    """All checks on the driver's tables, with the period, manifest and stream ends that these tables have.

    ``missing``: rows that every manifest has beyond its table; ``behind``: messages that
    every stream has beyond its table; ``only``: the conditions that are judged, all if there are none.  The probes of a family are one job, and tables that several of them read are computed once.
    """
    period = quality.data_period(c)
    counts: dict[str, int] = {}

    def count(name: str) -> int:
        if name not in counts:
            counts[name] = c(name).count()
        return counts[name]

    checks = quality.build_checks(period, manifest=lambda t: count(f"bronze.{t}") + missing, stream_end=lambda t: count(f"bronze.stream_{t}") + behind)
    rows = [(s.family, s.key, s.condition, s.blocking, r.passed, r.detail) for s, r in quality.run_checks(c, [s for s in checks if not only or s.condition in only])]
    return c.spark.createDataFrame(rows, "family string, check_key string, condition string, blocking boolean, passed boolean, detail string")


# --- verifiers -----------------------------------------------------------------------
add("v02_gmv_across_layers", verify.gmv_across_layers, "SELECT CAST(sum(CAST(line_total AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS raw_gmv, (SELECT CAST(sum(line_total) AS DECIMAL(18,2)) FROM s_fct_order_items) AS silver_gmv FROM m_items WHERE order_id IN (SELECT order_id FROM m_orders) AND product_id IN (SELECT product_id FROM b_products WHERE unit_price > 0)")
# --- storage, streams, generator: these work in a scratch folder of the shared place ------
def own(name: str) -> Callable[[Callable[[SparkSession, str], DataFrame]], None]:
    def register(query: Callable[[SparkSession, str], DataFrame]) -> None:
        QUERIES[name] = query

    return register


@own("io01_parquet_scan")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.scan(spark, f"{sf_dir}/part.parquet")


ORACLE["io01_parquet_scan"] = "SELECT * FROM part"


@own("io02_schema_inference")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(spark.read.parquet(f"{sf_dir}/customer.parquet"), spark).drop("position")


ORACLE["io02_schema_inference"] = "SELECT column_name, lower(data_type) AS sql_type FROM information_schema.columns WHERE table_name = 'customer'"


@own("io03_landing_copy")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = landing.land(spark.read.parquet(f"{sf_dir}/supplier.parquet"), scratch(spark), "supplier")
    return spark.read.parquet(path)


ORACLE["io03_landing_copy"] = "SELECT * FROM supplier"


@own("io05_full_refresh")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, scratch(spark))
    for _i in range(2):
        store.write("bronze.nation", spark.read.parquet(f"{sf_dir}/nation.parquet"))
    return store.read("bronze.nation")


ORACLE["io05_full_refresh"] = "SELECT * FROM nation"


@own("io12_json_messages")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return producer.to_messages(driver_context(spark, sf_dir)("bronze.payments").select("payment_id", "order_id", "payment_status", "payment_date"))


ORACLE["io12_json_messages"] = oracle("""SELECT '{"payment_id":"' || payment_id || '","order_id":"' || order_id || '","payment_status":"' || payment_status || '","payment_date":"' || CAST(payment_date AS VARCHAR) || '"}' AS value FROM b_payments""")


@own("io18_time_travel")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, n = Store(spark, scratch(spark)), spark.read.parquet(f"{sf_dir}/nation.parquet")
    store.write("t.nation", n)
    store.write("t.nation", n.filter("n_nationkey < 5"))
    return store.read("t.nation", version=1)


ORACLE["io18_time_travel"] = "SELECT * FROM nation"


def _stream_run(spark: SparkSession, sf_dir: str, name: str, twice: bool = False) -> tuple[DataFrame, list[int]]:
    spec = ingest.stream_specs(scratch(spark))[name]
    producer.ensure_topic(spark, spec)
    producer.send(driver_context(spark, sf_dir)(f"bronze.stream_{name}"), spec)
    runs = [ingest.ingest_available(spark, spec) for _ in range(2 if twice else 1)]
    return ingest.read_table(spark, spec), runs


for _stream in STREAMS:
    QUERIES[f"st01_ingest_{_stream}"] = lambda spark, sf_dir, n=_stream: _stream_run(spark, sf_dir, n)[0]
    ORACLE[f"st01_ingest_{_stream}"] = oracle(f"SELECT * FROM b_stream_{_stream}")


add("st10_stream_observer", lambda c: monitor.observed(c("bronze.stream_orders"), "orders"), "SELECT count(*) AS rows, count(DISTINCT order_id) AS distinct_keys, min(order_date) AS first_date, max(order_date) AS last_date FROM b_stream_orders")
