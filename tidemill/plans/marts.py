"""Serving queries over the marts, with optional filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bucket_revenue
from ..operators.relational import all_of, unpivot
from .context import Context

Filters = dict[str, Any]

SAMPLE_ROWS = 25
LATEST_ROWS = 15


def customer_filter(f: Filters) -> Column:
    """acq_channels, churn_risks: any of a list; search: text in id, names or email. Empty: no filter."""
    out = []
    if f.get("acq_channels"):
        out.append(F.col("marketing_channel").isin(list(f["acq_channels"])))
    if f.get("churn_risks"):
        out.append(F.col("churn_risk").isin(list(f["churn_risks"])))
    if f.get("search"):
        haystack = F.lower(F.concat("first_name", F.lit(" "), "last_name", F.lit(" "), "email", F.lit(" "), "customer_id"))
        out.append(haystack.contains(str(f["search"]).lower()))
    return all_of(out)


def revenue_filter(f: Filters, channel: bool = True) -> Column:
    """channels: any of a list; months: (first, last), dates or ISO texts. Empty: no filter."""
    out = []
    if channel and f.get("channels"):
        out.append(F.col("channel").isin(list(f["channels"])))
    if f.get("months"):
        a, z = (m if isinstance(m, dt.date) else dt.date.fromisoformat(m) for m in f["months"])
        out.append(F.col("month").between(a, z))
    return all_of(out)


_FILTERED = {"acq_channels": ("marketing_channel",), "churn_risks": ("churn_risk",), "search": ("customer_id", "first_name", "last_name", "email")}


def _customers(ctx: Context, f: Filters, *columns: str) -> DataFrame:
    """Filtered customers with at least ``columns``."""
    need = dict.fromkeys(("customer_id", *columns, *[c for k, of in _FILTERED.items() if f.get(k) for c in of]))
    return ctx.narrow("gold.customer_360", tuple(need)).filter(customer_filter(f))


def _channels(ctx: Context, f: Filters) -> DataFrame:
    return ctx("gold.revenue_by_channel").filter(revenue_filter(f))


def _total(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.sum(column).alias("value"))


def kpi_aov(ctx: Context, f: Filters) -> DataFrame:
    sums = _channels(ctx, f).agg(F.sum("net_revenue").alias("net"), F.sum("valid_orders").alias("n"))
    return sums.select(F.round(F.try_divide(F.col("net").cast("double"), F.col("n").cast("double")), 6).alias("value"))


def ltv_distribution(ctx: Context, f: Filters) -> DataFrame:
    return _customers(ctx, f, "net_revenue").groupBy(bucket_revenue(F.col("net_revenue")).alias("ltv_bucket")).agg(F.count(F.lit(1)).alias("customers"))


def _mix(column: str) -> Callable[[Context, Filters], DataFrame]:
    return lambda ctx, f: _customers(ctx, f, column).groupBy(column).agg(F.count(F.lit(1)).alias("customers"))


def revenue_trend(ctx: Context, f: Filters) -> DataFrame:
    return _channels(ctx, f).groupBy("month").agg(F.sum("gross_revenue").alias("gross_revenue"), F.sum("net_revenue").alias("net_revenue"))


def customer_sample(ctx: Context, f: Filters) -> DataFrame:
    return ctx("gold.customer_360").filter(customer_filter(f)).orderBy(F.desc("net_revenue"), "customer_id").limit(SAMPLE_ROWS).select(
        "customer_id", "first_name", "last_name", "country", "city", "age", "marketing_channel", "signup_date", "total_orders", F.col("frequency").alias("valid_orders"), "gross_revenue", "net_revenue",
        bucket_revenue(F.col("net_revenue")).alias("ltv_bucket"), "rfm_segment", "churn_risk", "total_tickets", "open_tickets", "total_web_events",
    )


MARTS: dict[str, Callable[[Context, Filters], DataFrame]] = {
    "kpi_customers": lambda ctx, f: _customers(ctx, f).agg(F.count(F.lit(1)).alias("value")),
    "kpi_orders": lambda ctx, f: _total(_channels(ctx, f), "orders"),
    "kpi_gmv": lambda ctx, f: _total(_channels(ctx, f), "gross_revenue"),
    "kpi_aov": kpi_aov,
    "ltv_distribution": ltv_distribution,
    "churn_risk_mix": _mix("churn_risk"),
    "rfm_segment_mix": _mix("rfm_segment"),
    "revenue_trend": revenue_trend,
    "channel_mix": lambda ctx, f: _channels(ctx, f).groupBy("channel").agg(F.sum("net_revenue").alias("net_revenue")),
    "category_mix": lambda ctx, f: ctx.narrow("gold.revenue_by_category", ("month", "category", "gross_revenue")).filter(revenue_filter(f, channel=False)).groupBy("category").agg(F.sum("gross_revenue").cast("decimal(24,2)").alias("gross_revenue")),
    "customer_sample": customer_sample,
}


def mart(ctx: Context, name: str, filters: Filters | None = None) -> DataFrame:
    """A serving query by name; KeyError names the known ones."""
    if name not in MARTS:
        raise KeyError(f"no mart {name!r}; there are {', '.join(sorted(MARTS))}")
    return MARTS[name](ctx, dict(filters or {}))


def filter_options(ctx: Context) -> DataFrame:
    """(option, value) rows: what the filters may hold, and the first and last month."""
    c, r = ctx("gold.customer_360"), ctx("gold.revenue_by_channel")
    option = lambda df, column, name: df.select(F.lit(name).alias("option"), F.col(column).alias("value")).distinct()
    span = r.agg(F.min("month").alias("first_month"), F.max("month").alias("last_month")).select(*[F.col(x).cast("string").alias(x) for x in ("first_month", "last_month")])
    ends = unpivot(span, [], ["first_month", "last_month"], "option", "value")
    return option(r, "channel", "channel").unionByName(option(c, "marketing_channel", "acquisition_channel")).unionByName(option(c, "churn_risk", "churn_risk")).unionByName(ends).orderBy("option", "value")


def trend_series(ctx: Context, filters: Filters | None = None) -> DataFrame:
    """The revenue trend in long form, ordered for display: month, series, revenue."""
    wide = revenue_trend(ctx, dict(filters or {}))
    return unpivot(wide, ["month"], ["gross_revenue", "net_revenue"], "series", "revenue").withColumn("series", F.initcap(F.regexp_replace("series", "_revenue", ""))).orderBy("month", "series")


def stream_counts(ctx: Context) -> DataFrame:
    """Rows of the event streams and fact, and the newest stream event with its day."""
    s = ctx("bronze.stream_web_events")
    newest = s.agg(F.count(F.lit(1)).alias("stream_rows"), F.max("event_id").alias("newest_event_id"), F.max_by("event_date", "event_id").alias("newest_event_date"))
    batch = ctx("bronze.web_events").agg(F.count(F.lit(1)).alias("batch_rows"))
    fact = ctx("silver.fct_web_events").agg(F.count(F.lit(1)).alias("fact_rows"))
    return newest.crossJoin(batch).crossJoin(fact)


def latest(ctx: Context, table: str, key: str, rows: int = LATEST_ROWS) -> DataFrame:
    """The rows with the largest ids."""
    return ctx(table).orderBy(F.desc(key)).limit(int(rows))


def top_customers(ctx: Context, rows: int = 5) -> DataFrame:
    """Customers by the sum of their item totals, over raw tables."""
    i = ctx("bronze.order_items").select("order_id", F.col("line_total").cast("decimal(14,2)").alias("v"))
    sums = i.join(ctx("bronze.orders").select("order_id", "customer_id"), "order_id").join(ctx("bronze.customers").select("customer_id"), "customer_id").groupBy("customer_id").agg(F.countDistinct("order_id").alias("orders"), F.sum("v").cast("decimal(18,2)").alias("revenue"))
    return sums.orderBy(F.desc("revenue"), "customer_id").limit(rows)
