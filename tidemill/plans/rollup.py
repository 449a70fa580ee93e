"""Marts from small tables of grouping sets, written once after a refresh.

Customers are counted by all that the marts group or filter them by, and revenue is summed
by month and channel (and by month and category), each with the coarser groupings that
unfiltered marts ask for.  A mart reads the coarsest grouping that knows its columns and
filters; the finest one has as many rows as there are combinations, not customers.  Free
text cannot be answered from groups, so a search goes to the customers themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bucket_revenue
from ..operators.relational import all_of
from ..sources.scratch import materialised
from . import marts
from .context import Context

#: Columns by cube, and the groupings kept of each, coarsest first; the last holds every column.
CUSTOMERS = ("marketing_channel", "churn_risk", "rfm_segment", "ltv_bucket")
REVENUE, CATEGORIES = ("month", "channel"), ("month", "category")
GROUPINGS: dict[str, tuple[tuple[str, ...], ...]] = {
    "customers": ((), ("churn_risk",), ("rfm_segment",), ("ltv_bucket",), CUSTOMERS),
    "revenue": ((), ("month",), ("channel",), REVENUE),
    "categories": (("category",), CATEGORIES),
}
COLUMNS = {"customers": CUSTOMERS, "revenue": REVENUE, "categories": CATEGORIES}
_SUMS = ("orders", "valid_orders", "gross_revenue", "net_revenue")


@dataclass(frozen=True)
class Rollups:
    """The cubes by name; each row says its grouping."""

    cubes: dict[str, DataFrame]

    def read(self, cube: str, group: Sequence[str], filters: Sequence[tuple[str, Column]]) -> DataFrame:
        """Rows of the coarsest grouping with all columns of ``group`` and of the filters, filtered."""
        need = {*group, *(c for c, _ in filters)}
        grouping = next(g for g in GROUPINGS[cube] if need <= set(g))
        return self.cubes[cube].filter(F.col("grouping") == "+".join(grouping)).filter(all_of([p for _, p in filters]))


def cubes_of(mart_name: str) -> tuple[str, ...]:
    """The cubes that a mart reads."""
    if mart_name == "category_mix":
        return ("categories",)
    return ("customers",) if mart_name in ("kpi_customers", "ltv_distribution", "churn_risk_mix", "rfm_segment_mix") else () if mart_name == "customer_sample" else ("revenue",)


def build(ctx: Context, names: Sequence[str] = tuple(GROUPINGS), keep=materialised) -> Rollups:
    """Cubes of a context's gold tables, all or those named, each in one pass with one shuffle, and kept."""
    count = [F.count(F.lit(1)).alias("customers")]
    money = lambda c: F.sum(c).cast("decimal(24,2)").alias(c)
    sums = [F.sum(c).cast("bigint").alias(c) if c.endswith("orders") else money(c) for c in _SUMS]
    tables = {"customers": ("gold.customer_360", ("marketing_channel", "churn_risk", "rfm_segment", "net_revenue"), count), "revenue": ("gold.revenue_by_channel", (*REVENUE, *_SUMS), sums), "categories": ("gold.revenue_by_category", (*CATEGORIES, "gross_revenue"), [money("gross_revenue")])}
    out = {}
    for name in names:
        table, columns, values = tables[name]
        rows = ctx.narrow(table, columns)
        rows = rows.withColumn("ltv_bucket", bucket_revenue(F.col("net_revenue"))) if name == "customers" else rows
        out[name] = keep(_cube(rows, name, values), f"cube-{name}")
    return Rollups(out)


def _cube(df: DataFrame, name: str, values: list[Column]) -> DataFrame:
    columns = COLUMNS[name]
    grouped = df.groupingSets([list(g) for g in GROUPINGS[name]], *columns).agg(F.grouping_id(*columns).alias("_id"), *values)
    label = F.lit(None).cast("string")
    for g in GROUPINGS[name]:
        number = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in g)
        label = F.when(F.col("_id") == number, "+".join(g)).otherwise(label)
    return grouped.withColumn("grouping", label).drop("_id")


def _customer_filters(f: marts.Filters) -> list[tuple[str, Column]]:
    return [(c, F.col(c).isin(list(f[k]))) for k, c in (("acq_channels", "marketing_channel"), ("churn_risks", "churn_risk")) if f.get(k)]


def _revenue_filters(f: marts.Filters, channel: bool = True) -> list[tuple[str, Column]]:
    out = [("channel", marts.revenue_filter({"channels": f["channels"]}))] if channel and f.get("channels") else []
    return out + ([("month", marts.revenue_filter({"months": f["months"]}))] if f.get("months") else [])


def mart(rollups: Rollups, ctx: Context, name: str, filters: marts.Filters | None = None) -> DataFrame:
    """The same rows as ``marts.mart``, from the cubes where they can answer, else from the tables."""
    f = dict(filters or {})
    if name not in marts.MARTS:
        raise KeyError(f"no mart {name!r}; there are {', '.join(sorted(marts.MARTS))}")
    groups = {"ltv_distribution": "ltv_bucket", "churn_risk_mix": "churn_risk", "rfm_segment_mix": "rfm_segment"}
    if name == "customer_sample" or (f.get("search") and (name in groups or name == "kpi_customers")):
        return marts.mart(ctx, name, f)
    if name == "kpi_customers":
        return rollups.read("customers", (), _customer_filters(f)).agg(F.coalesce(F.sum("customers"), F.lit(0)).alias("value"))
    if name in groups:
        return rollups.read("customers", (groups[name],), _customer_filters(f)).groupBy(groups[name]).agg(F.sum("customers").alias("customers"))
    if name == "category_mix":
        return rollups.read("categories", ("category",), _revenue_filters(f, channel=False)).groupBy("category").agg(F.sum("gross_revenue").alias("gross_revenue"))
    by = {"revenue_trend": "month", "channel_mix": "channel"}.get(name)
    rows = rollups.read("revenue", (by,) if by else (), _revenue_filters(f))
    total = lambda c: F.sum(c).alias(c)
    if name == "kpi_aov":
        sums = rows.agg(F.sum("net_revenue").alias("net"), F.sum("valid_orders").alias("n"))
        return sums.select(F.round(F.try_divide(F.col("net").cast("double"), F.col("n").cast("double")), 6).alias("value"))
    if by:
        return rows.groupBy(by).agg(*([total("gross_revenue"), total("net_revenue")] if by == "month" else [total("net_revenue")]))
    return rows.agg(F.sum({"kpi_orders": "orders", "kpi_gmv": "gross_revenue"}[name]).alias("value"))
