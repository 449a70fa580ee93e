"""The same tables in plain SQL, written apart from the transformations, to compare results with.

The rules of segments and risks are fixed values; both sides read the one list of them.
"""

from __future__ import annotations

import re

from ..sources import adapter
from . import gold

_T = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _t(c: str) -> str:
    return _T.format(c=c)


def _lt(c: str) -> str:
    return f"lower({_t(c)})"


def _merge(columns: str, a: str, b: str, key: str, then: str = "") -> str:
    return f"SELECT {columns} FROM (SELECT *, 1 AS src FROM {a} UNION ALL SELECT *, 2 AS src FROM {b}) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY src{then}) = 1"


def _aov(gross: str, n: str) -> str:
    """Exact division of cents, halves up."""
    cents = f"CAST({gross} * 100 AS HUGEINT)"
    return f"CASE WHEN {n} > 0 THEN CAST(CAST((2 * {cents} + {n}) // (2 * {n}) AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(14,2)) END"


def _figures(gross: str = "m.gross", refunds: str = "coalesce(r.refunds, 0)") -> str:
    return f"""m.orders, m.completed_orders, m.returned_orders, m.cancelled_orders, m.valid_orders,
  CAST({gross} AS DECIMAL(14,2)) AS gross_revenue, CAST({refunds} AS DECIMAL(14,2)) AS refunds, CAST({gross} - {refunds} AS DECIMAL(14,2)) AS net_revenue,
  {_aov(gross, 'm.valid_orders')} AS aov, round(CAST(m.returned_orders AS DOUBLE) / m.orders, 6) AS return_rate, round(CAST(m.cancelled_orders AS DOUBLE) / m.orders, 6) AS cancel_rate"""


_STATES = ("completed", "returned", "cancelled")
_COUNTS = ", ".join(["count(*) AS orders", *[f"count(*) FILTER (WHERE is_{x}) AS {x}_orders" for x in _STATES], "count(*) FILTER (WHERE NOT is_cancelled) AS valid_orders"])
_NONE = ", ".join(["coalesce(o.orders, 0) AS total_orders", *[f"coalesce(o.{x}_orders, 0) AS {x}_orders" for x in (*_STATES, "valid")]])
_MONTH = "CAST(date_trunc('month', {d}) AS DATE)"

CTES: dict[str, str] = {name: adapter.plain(sql).strip() for name, sql in adapter.VIEWS.items()}
CTES |= {
    "m_orders": _merge("order_id, customer_id, order_date, order_status, channel, total_amount", "b_orders", "b_stream_orders", "order_id"),
    "m_items": _merge("order_item_id, order_id, product_id, quantity, unit_price, line_total", "b_order_items", "b_stream_order_items", "order_item_id"),
    "m_payments": _merge("payment_id, order_id, payment_method, payment_status, payment_date, amount", "b_payments", "b_stream_payments", "order_id", ", payment_id"),
    "m_events": _merge("event_id, customer_id, event_type, category, device, event_date", "b_web_events", "b_stream_web_events", "event_id"),
    "s_dim_customers": f"""SELECT customer_id, {_t('first_name')} AS first_name, {_t('last_name')} AS last_name, {_lt('email')} AS email, signup_date, {_t('country')} AS country, {_t('city')} AS city, {_lt('marketing_channel')} AS marketing_channel, age
FROM b_customers QUALIFY row_number() OVER (PARTITION BY {_lt('email')} ORDER BY signup_date, customer_id) = 1""",
    "s_dim_products": f"SELECT product_id, {_t('product_name')} AS product_name, {_t('category')} AS category, {_t('brand')} AS brand, CAST(unit_price AS DECIMAL(12,2)) AS unit_price FROM b_products WHERE unit_price > 0",
    "s_dim_order_dates": """SELECT d AS order_date, CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month, CAST(quarter(d) AS INT) AS quarter, CAST(isodow(d) AS BIGINT) AS day_of_week, dayname(d) AS day_of_week_name, month(d) IN (11, 12) AS is_holiday_season
FROM (SELECT CAST(unnest(generate_series(min(order_date), max(order_date), INTERVAL 1 DAY)) AS DATE) AS d FROM b_orders)""",
    "s_fct_orders": f"""SELECT o.order_id, o.customer_id, o.order_date, {_lt('o.order_status')} AS order_status, {_lt('o.channel')} AS channel, CAST(o.total_amount AS DECIMAL(12,2)) AS total_amount,
  coalesce(i.n, 0) AS item_count, coalesce(i.p, 0) AS distinct_product_count, {_lt('o.order_status')} = 'completed' AS is_completed, {_lt('o.order_status')} = 'returned' AS is_returned, {_lt('o.order_status')} = 'cancelled' AS is_cancelled,
  p.payment_status IS NOT NULL AS has_payment, {_lt('p.payment_status')} = 'succeeded' AS is_payment_succeeded, ({_lt('o.order_status')} = 'cancelled') <> ({_lt('p.payment_status')} = 'failed') AS payment_status_conflict
FROM m_orders o SEMI JOIN b_customers c ON c.customer_id = o.customer_id
LEFT JOIN (SELECT order_id, count(*) AS n, count(DISTINCT product_id) AS p FROM m_items GROUP BY order_id) i ON i.order_id = o.order_id
LEFT JOIN m_payments p ON p.order_id = o.order_id""",
    "s_fct_order_items": """SELECT i.order_item_id, i.order_id, i.product_id, p.product_name, p.category, p.brand, i.quantity, CAST(i.unit_price AS DECIMAL(12,2)) AS unit_price, CAST(i.line_total AS DECIMAL(12,2)) AS line_total,
  CAST(i.quantity * i.unit_price AS DECIMAL(12,2)) <> CAST(i.line_total AS DECIMAL(12,2)) AS line_total_mismatch
FROM m_items i JOIN s_dim_products p USING (product_id) WHERE i.order_id IN (SELECT order_id FROM m_orders)""",
    "s_fct_payments": f"""SELECT p.payment_id, p.order_id, o.customer_id, {_lt('p.payment_method')} AS payment_method, {_lt('p.payment_status')} AS payment_status, p.payment_date, CAST(p.amount AS DECIMAL(12,2)) AS amount,
  {_lt('p.payment_status')} = 'succeeded' AS is_succeeded, {_lt('p.payment_status')} = 'failed' AS is_failed, {_lt('p.payment_status')} = 'pending' AS is_pending, CAST(p.amount AS DECIMAL(12,2)) <> CAST(o.total_amount AS DECIMAL(12,2)) AS amount_mismatch
FROM m_payments p JOIN m_orders o USING (order_id)""",
    "s_fct_refunds": f"""SELECT r.refund_id, r.order_id, r.customer_id, o.order_date, r.refund_date, CAST(r.refund_date - o.order_date AS BIGINT) AS refund_lag_days, CAST(r.refund_amount AS DECIMAL(12,2)) AS refund_amount,
  CAST(o.total_amount AS DECIMAL(12,2)) AS order_total, {_lt('r.refund_reason')} AS refund_reason, CAST(r.refund_amount AS DECIMAL(12,2)) >= CAST(o.total_amount AS DECIMAL(12,2)) AS is_full_refund
FROM b_refunds r JOIN b_orders o USING (order_id)""",
    "s_fct_web_events": f"SELECT event_id, customer_id, {_lt('event_type')} AS event_type, {_t('category')} AS category, {_lt('device')} AS device, event_date, customer_id IS NULL AS is_anonymous FROM m_events",
    "s_fct_support_tickets": f"""SELECT t.ticket_id, t.customer_id, t.order_id, t.order_id IS NOT NULL AS has_linked_order,
  EXISTS (SELECT 1 FROM b_orders o WHERE o.order_id = t.order_id AND o.customer_id = t.customer_id) AS linked_order_valid, {_lt('t.issue_type')} AS issue_type, {_lt('t.priority')} AS priority, t.ticket_date, {_lt('t.status')} AS status
FROM b_support_tickets t""",
    "x_gaps": """SELECT customer_id, avg(order_date - prev) AS gap FROM (SELECT customer_id, order_date, lag(order_date) OVER (PARTITION BY customer_id ORDER BY order_date) AS prev FROM (SELECT DISTINCT customer_id, order_date FROM s_fct_orders))
WHERE prev IS NOT NULL GROUP BY customer_id""",
    "x_base": f"""SELECT c.*, {_NONE},
  o.first_order_date, o.last_order_date, CAST(coalesce(o.gross, 0) AS DECIMAL(14,2)) AS gross_revenue, CAST(coalesce(r.refunded, 0) AS DECIMAL(14,2)) AS total_refunded, CAST(coalesce(o.gross, 0) - coalesce(r.refunded, 0) AS DECIMAL(14,2)) AS net_revenue,
  CAST(coalesce(o.items, 0) AS BIGINT) AS items_purchased, CAST((SELECT max(order_date) FROM s_fct_orders) - o.last_order_date AS BIGINT) AS recency_days, coalesce(g.gap, (SELECT coalesce(avg(gap), 1.0) FROM x_gaps)) AS gap,
  coalesce(t.n, 0) AS total_tickets, coalesce(t.open, 0) AS open_tickets, coalesce(e.n, 0) AS total_web_events, coalesce(e.carts, 0) AS cart_adds, e.last_event_date
FROM s_dim_customers c
LEFT JOIN (SELECT customer_id, {_COUNTS}, min(order_date) AS first_order_date, max(order_date) AS last_order_date, sum(total_amount) FILTER (NOT is_cancelled) AS gross, sum(item_count) FILTER (NOT is_cancelled) AS items FROM s_fct_orders GROUP BY 1) o USING (customer_id)
LEFT JOIN (SELECT customer_id, sum(refund_amount) AS refunded FROM s_fct_refunds GROUP BY 1) r USING (customer_id)
LEFT JOIN x_gaps g USING (customer_id)
LEFT JOIN (SELECT customer_id, count(*) AS n, count(*) FILTER (WHERE status = 'open') AS open FROM s_fct_support_tickets GROUP BY 1) t USING (customer_id)
LEFT JOIN (SELECT customer_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'add_to_cart') AS carts, max(event_date) AS last_event_date FROM s_fct_web_events WHERE customer_id IS NOT NULL GROUP BY 1) e USING (customer_id)""",
    "x_scored": """SELECT *, 6 - ntile(5) OVER (PARTITION BY valid_orders > 0 ORDER BY recency_days NULLS LAST, customer_id) AS r, ntile(5) OVER (PARTITION BY valid_orders > 0 ORDER BY valid_orders, customer_id) AS f,
  ntile(5) OVER (PARTITION BY valid_orders > 0 ORDER BY net_revenue, customer_id) AS m, CASE WHEN total_orders > 0 THEN recency_days / gap END AS churn FROM x_base""",
    "g_customer_360": f"""SELECT customer_id, first_name, last_name, email, country, city, marketing_channel, age, signup_date, total_orders, completed_orders, returned_orders, cancelled_orders, first_order_date, last_order_date, gross_revenue, total_refunded, net_revenue,
  {_aov('gross_revenue', 'valid_orders')} AS aov, items_purchased, recency_days, valid_orders AS frequency, net_revenue AS monetary, CASE WHEN total_orders > 0 THEN r END AS r_score, CASE WHEN total_orders > 0 THEN f END AS f_score, CASE WHEN total_orders > 0 THEN m END AS m_score,
  {gold.ladder(gold.SEGMENT_RULES, gold.SEGMENT_ELSE)} AS rfm_segment,
  round(gap, 6) AS avg_order_gap_days, round(churn, 6) AS churn_ratio, {gold.ladder(gold.RISK_RULES, gold.RISK_ELSE)} AS churn_risk,
  total_tickets, open_tickets, total_web_events, cart_adds, last_event_date FROM x_scored""",
    "g_revenue_by_channel": f"""SELECT m.month, m.channel, {_figures()}
FROM (SELECT {_MONTH.format(d='order_date')} AS month, channel, {_COUNTS}, coalesce(sum(total_amount) FILTER (NOT is_cancelled), 0) AS gross FROM s_fct_orders GROUP BY ALL) m
LEFT JOIN (SELECT {_MONTH.format(d='refund_date')} AS month, channel, sum(refund_amount) AS refunds FROM s_fct_refunds JOIN (SELECT order_id, channel FROM s_fct_orders) USING (order_id) GROUP BY ALL) r ON r.month = m.month AND r.channel = m.channel""",
    "g_revenue_by_category": f"""SELECT month, category, orders, units, CAST(gross AS DECIMAL(14,2)) AS gross_revenue, round(100 * CAST(gross AS DOUBLE) / CAST(sum(gross) OVER (PARTITION BY month) AS DOUBLE), 6) AS revenue_share_pct
FROM (SELECT {_MONTH.format(d='o.order_date')} AS month, i.category, count(DISTINCT i.order_id) AS orders, CAST(sum(i.quantity) AS BIGINT) AS units, sum(i.line_total) AS gross FROM s_fct_order_items i JOIN s_fct_orders o ON o.order_id = i.order_id AND NOT o.is_cancelled GROUP BY ALL)""",
    "g_monthly_kpis": f"""SELECT m.month, {_figures()}, m.unique_customers, coalesce(n.new, 0) AS new_customers, m.unique_customers - coalesce(n.new, 0) AS returning_customers
FROM (SELECT {_MONTH.format(d='order_date')} AS month, {_COUNTS}, count(DISTINCT customer_id) AS unique_customers, coalesce(sum(total_amount) FILTER (NOT is_cancelled), 0) AS gross FROM s_fct_orders GROUP BY ALL) m
LEFT JOIN (SELECT {_MONTH.format(d='d')} AS month, count(*) AS new FROM (SELECT min(order_date) AS d FROM s_fct_orders GROUP BY customer_id) GROUP BY ALL) n ON n.month = m.month
LEFT JOIN (SELECT {_MONTH.format(d='refund_date')} AS month, sum(refund_amount) AS refunds FROM s_fct_refunds GROUP BY ALL) r ON r.month = m.month""",
}
_NAME = re.compile(r"\b(?:b|m|s|x|g)_\w+\b")


def oracle(sql: str) -> str:
    """``sql`` with the definitions of every table that it needs before it."""
    need: set[str] = set()
    todo = [n for n in _NAME.findall(sql) if n in CTES]
    while todo:
        n = todo.pop()
        if n not in need:
            need.add(n)
            todo += [k for k in _NAME.findall(CTES[n]) if k in CTES]
    defined = [f"{n} AS (\n{text}\n)" for n, text in CTES.items() if n in need]
    return ("WITH " + ",\n".join(defined) + "\n" if defined else "") + sql
