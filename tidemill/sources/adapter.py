"""The raw tables as views over the driver's star schema.

The texts are portable: Spark and DuckDB read the same SQL, so both sides of a
comparison start from the same rows.  Names in braces are inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .scratch import materialised
from .versioned import Files

INPUTS = ("region", "nation", "customer", "part", "orders", "lineitem", "events")

VIEWS: dict[str, str] = {
    "b_customers": """
SELECT concat('C-', lpad(cast(c.c_custkey AS varchar(20)), 6, '0')) AS customer_id, ' Customer' AS first_name, substr(c.c_name, 10) AS last_name,
       concat('User.', cast(c.c_custkey AS varchar(20)), '@Example.com ') AS email,
       CAST(DATE '1994-01-01' + CAST(c.c_custkey % 365 AS INT) AS DATE) AS signup_date,
       r.r_name AS country, n.n_name AS city, c.c_mktsegment AS marketing_channel, CAST(18 + c.c_custkey % 60 AS INT) AS age
FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey""",
    "b_products": """
SELECT concat('P-', lpad(cast(p_partkey AS varchar(20)), 5, '0')) AS product_id, p_name AS product_name, p_type AS category, p_brand AS brand, p_retailprice AS unit_price
FROM {part}""",
    "b_order_items": """
SELECT concat('OI-', cast(l_orderkey AS varchar(20)), '-', cast(rn AS varchar(20))) AS order_item_id,
       concat('ORD-', lpad(cast(l_orderkey AS varchar(20)), 7, '0')) AS order_id, concat('P-', lpad(cast(l_partkey AS varchar(20)), 5, '0')) AS product_id,
       CAST(l_quantity AS INT) AS quantity, p_retailprice AS unit_price,
       CASE WHEN l_orderkey % 50 = 0 THEN l_extendedprice ELSE CAST(CAST(l_quantity AS INT) * CAST(p_retailprice AS DECIMAL(10,2)) AS DOUBLE) END AS line_total
FROM (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM {lineitem} l) x
JOIN {part} ON p_partkey = l_partkey
WHERE l_orderkey % 25 <> 7""",
    "b_orders": """
SELECT concat('ORD-', lpad(cast(o.o_orderkey AS varchar(20)), 7, '0')) AS order_id, concat('C-', lpad(cast(o.o_custkey AS varchar(20)), 6, '0')) AS customer_id,
       CAST(o.o_orderdate AS DATE) AS order_date,
       CASE WHEN o.o_orderkey % 100 < 84 THEN ' Completed' WHEN o.o_orderkey % 100 < 91 THEN 'returned' ELSE 'cancelled' END AS order_status,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'POS' WHEN '2-HIGH' THEN 'mobile' WHEN '3-MEDIUM' THEN 'mobile' ELSE 'web' END AS channel,
       coalesce(t.total_amount, CAST(0 AS DOUBLE)) AS total_amount
FROM {orders} o
LEFT JOIN (SELECT order_id, CAST(sum(CAST(line_total AS DECIMAL(12,2))) AS DOUBLE) AS total_amount FROM {b_order_items} GROUP BY order_id) t
       ON t.order_id = concat('ORD-', lpad(cast(o.o_orderkey AS varchar(20)), 7, '0'))
WHERE o.o_custkey % 25 <> 0""",
    "b_payments": """
SELECT replace(order_id, 'ORD', 'PAY') AS payment_id, order_id,
       CASE CAST(substr(order_id, 5) AS INT) % 5 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'paypal' WHEN 2 THEN 'apple_pay' WHEN 3 THEN 'gift_card' ELSE 'bank_transfer' END AS payment_method,
       CASE WHEN order_status = 'cancelled' THEN 'failed' WHEN CAST(substr(order_id, 5) AS INT) % 33 = 0 THEN 'pending' ELSE 'succeeded' END AS payment_status,
       order_date AS payment_date, total_amount AS amount
FROM {b_orders}""",
    "b_refunds": """
SELECT replace(order_id, 'ORD', 'REF') AS refund_id, order_id, customer_id,
       CAST(order_date + CAST(3 + CAST(substr(order_id, 5) AS INT) % 43 AS INT) AS DATE) AS refund_date,
       CASE WHEN CAST(substr(order_id, 5) AS INT) % 10 < 7 THEN total_amount ELSE CAST(CAST(CAST(total_amount AS DECIMAL(12,2)) * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(12,2)) AS DOUBLE) END AS refund_amount,
       CASE CAST(substr(order_id, 5) AS INT) % 3 WHEN 0 THEN 'damaged' WHEN 1 THEN 'wrong_item' ELSE 'changed_mind' END AS refund_reason
FROM {b_orders} WHERE order_status = 'returned'""",
    "b_web_events": """
SELECT concat('EVT-', lpad(cast(event_id AS varchar(20)), 8, '0')) AS event_id,
       CASE WHEN event_id % 10 < 3 THEN NULL ELSE concat('C-', lpad(cast(user_id AS varchar(20)), 6, '0')) END AS customer_id,
       CASE event_type WHEN 'click' THEN ' Add_To_Cart' WHEN 'view' THEN 'PAGE_VIEW' ELSE event_type END AS event_type,
       CASE WHEN value < 20 THEN 'low' ELSE ' high' END AS category,
       CASE event_id % 3 WHEN 0 THEN 'Desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END AS device, CAST(ts AS DATE) AS event_date
FROM {events}""",
    "b_support_tickets": """
SELECT concat('T-', lpad(cast(e.event_id AS varchar(20)), 5, '0')) AS ticket_id, concat('C-', lpad(cast(e.user_id AS varchar(20)), 6, '0')) AS customer_id,
       CASE WHEN e.event_id % 5 < 2 THEN NULL WHEN e.event_id % 5 = 2 THEN 'ORD-0000001' ELSE f.order_id END AS order_id,
       CASE e.event_id % 3 WHEN 0 THEN 'Shipping' WHEN 1 THEN 'billing' ELSE 'other' END AS issue_type,
       CASE e.event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'urgent' END AS priority, CAST(e.ts AS DATE) AS ticket_date,
       CASE e.event_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'resolved' ELSE 'pending' END AS status
FROM {events} e LEFT JOIN (SELECT customer_id, min(order_id) AS order_id FROM {b_orders} GROUP BY customer_id) f
  ON f.customer_id = concat('C-', lpad(cast(e.user_id AS varchar(20)), 6, '0'))
WHERE e.event_type = 'error'""",
    "b_stream_orders": """
SELECT * FROM {b_orders} WHERE CAST(substr(order_id, 5) AS INT) % 3 = 0
UNION ALL
SELECT replace(order_id, 'ORD-0', 'ORD-9'), customer_id, CAST(order_date + 2500 AS DATE), CASE WHEN order_status = 'returned' THEN 'completed' ELSE order_status END, channel, total_amount
FROM {b_orders} WHERE CAST(substr(order_id, 5) AS INT) % 40 = 0""",
    "b_stream_order_items": """
SELECT i.* FROM {b_order_items} i WHERE CAST(substr(i.order_id, 5) AS INT) % 3 = 0
UNION ALL
SELECT concat('L', i.order_item_id), replace(i.order_id, 'ORD-0', 'ORD-9'), i.product_id, i.quantity, i.unit_price, i.line_total
FROM {b_order_items} i WHERE CAST(substr(i.order_id, 5) AS INT) % 40 = 0""",
    "b_stream_payments": """
SELECT * FROM {b_payments} WHERE CAST(substr(order_id, 5) AS INT) % 3 = 0
UNION ALL
SELECT replace(payment_id, 'PAY-0', 'PAY-9'), replace(order_id, 'ORD-0', 'ORD-9'), payment_method, payment_status, CAST(payment_date + 2500 AS DATE), amount
FROM {b_payments} WHERE CAST(substr(order_id, 5) AS INT) % 40 = 0""",
    "b_stream_web_events": """
SELECT * FROM {b_web_events} WHERE CAST(substr(event_id, 5) AS INT) % 3 = 0
UNION ALL
SELECT replace(event_id, 'EVT-0', 'EVT-9'), customer_id, event_type, category, device, CAST(event_date + 60 AS DATE)
FROM {b_web_events} WHERE CAST(substr(event_id, 5) AS INT) % 40 = 0""",
}


class Names(dict):
    """Format arguments that are their own names, for plain SQL text."""

    def __missing__(self, key: str) -> str:
        return key


def plain(sql: str) -> str:
    return sql.format_map(Names())


def inputs_of(sql: str) -> list[str]:
    return [n for n in (*INPUTS, *VIEWS) if "{" + n + "}" in sql]


#: Views that many others read; each is landed once for an application, as raw tables are, and goes with it.
LANDED = ("b_order_items", "b_orders")
_seen: dict[tuple[str, str], tuple[tuple, dict[str, DataFrame]]] = {}


def shared_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The frames of one application over one folder, shared by all its queries as long as the folder's files are the same."""
    files = Files(spark, sf_dir)
    state = tuple(f for n in INPUTS for f in sorted(files.listing(f"{sf_dir}/{n}.parquet")))
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _seen or _seen[key][0] != state:
        _seen[key] = (state, {})
    return _seen[key][1]


def raw_table(spark: SparkSession, sf_dir: str, name: str, seen: dict[str, DataFrame] | None = None) -> DataFrame:
    """One raw table; ``seen`` keeps the frames that several tables share."""
    seen = {} if seen is None else seen
    if name not in seen:
        if name in INPUTS:
            seen[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            sql = VIEWS[name]
            seen[name] = spark.sql(sql, **{n: raw_table(spark, sf_dir, n, seen) for n in inputs_of(sql)})
            if name in LANDED:
                seen[name] = materialised(seen[name], name)
    return seen[name]
