"""Schemas of the raw tables and the column types that are accepted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Columns and types of the raw tables.
TABLES: dict[str, str] = {
    "customers": "customer_id string, first_name string, last_name string, email string, signup_date date, country string, city string, marketing_channel string, age int",
    "products": "product_id string, product_name string, category string, brand string, unit_price double",
    "orders": "order_id string, customer_id string, order_date date, order_status string, channel string, total_amount double",
    "order_items": "order_item_id string, order_id string, product_id string, quantity int, unit_price double, line_total double",
    "payments": "payment_id string, order_id string, payment_method string, payment_status string, payment_date date, amount double",
    "refunds": "refund_id string, order_id string, customer_id string, refund_date date, refund_amount double, refund_reason string",
    "web_events": "event_id string, customer_id string, event_type string, category string, device string, event_date date",
    "support_tickets": "ticket_id string, customer_id string, order_id string, issue_type string, priority string, ticket_date date, status string",
}
#: Streams have the columns of the table of the same name.
STREAMS = ("web_events", "orders", "order_items", "payments")
#: The date column by which a stream's table is partitioned; None: not partitioned.
STREAM_DATES = {"web_events": "event_date", "orders": "order_date", "order_items": None, "payments": "payment_date"}
KEYS = {"customers": "customer_id", "products": "product_id", "orders": "order_id", "order_items": "order_item_id", "payments": "payment_id", "refunds": "refund_id", "web_events": "event_id", "support_tickets": "ticket_id"}
DATES = {"customers": "signup_date", "orders": "order_date", "payments": "payment_date", "refunds": "refund_date", "web_events": "event_date", "support_tickets": "ticket_date"}

_DDL = {T.StringType: "varchar", T.BooleanType: "boolean", T.ByteType: "integer", T.ShortType: "integer", T.IntegerType: "integer", T.LongType: "bigint", T.FloatType: "real", T.DoubleType: "double", T.DateType: "date", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp"}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def sql_type(kind: T.DataType) -> str:
    """Name of a column type in table definitions; raises ValueError for a type that no raw table may have."""
    for accepted, name in _DDL.items():
        if type(kind) is accepted:
            return name
    raise ValueError(f"no table may have a column of type {kind.simpleString()}")


def column_types(df: DataFrame) -> dict[str, str]:
    return {f.name: sql_type(f.dataType) for f in df.schema}


def describe(df: DataFrame, spark: SparkSession) -> DataFrame:
    """(column_name, sql_type, position) of a DataFrame."""
    rows = [(n, t, i) for i, (n, t) in enumerate(column_types(df).items())]
    return spark.createDataFrame(rows, "column_name string, sql_type string, position int")
