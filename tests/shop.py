"""A small shop from literal rows: only the tables that a test gives hold any."""

from __future__ import annotations

import datetime as dt

from tidemill.plans.context import Context
from tidemill.sources.schemas import STREAMS, TABLES, schema


def d(text):
    return dt.date.fromisoformat(text)


def shop(spark, **rows):
    tables = {f"bronze.{t}": spark.createDataFrame(rows.get(t, []), schema(t)) for t in TABLES}
    tables |= {f"bronze.stream_{t}": spark.createDataFrame(rows.get(f"stream_{t}", []), schema(t)) for t in STREAMS}
    return Context(spark, tables)


def customer(i, email=None, signup="2024-01-01"):
    return (f"C{i}", " Ann ", "Lee", email or f"u{i}@x.com", d(signup), "France", "Paris", " Email", 30)


def order(i, c, day="2024-01-10", status="completed", channel="web", total=10.0):
    return (f"ORD-{i:07d}", f"C{c}", d(day), status, channel, total)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
