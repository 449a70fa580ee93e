"""Deterministic synthetic tables of an online shop.

Every random value is a hash of (seed, purpose, row number), so tables can be made in
any order and on any number of executors and come out the same.
"""

from __future__ import annotations

import bisect
import datetime as dt
import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import padded_id, row_digest, set_digest

# Domains and shares.
ORDER_STATUSES = (("completed", 0.84), ("returned", 0.07), ("cancelled", 0.09))
CHANNELS = (("web", 0.55), ("mobile", 0.35), ("pos", 0.10))
PAYMENT_METHODS = (("credit_card", 0.55), ("paypal", 0.20), ("apple_pay", 0.12), ("gift_card", 0.08), ("bank_transfer", 0.05))
REFUND_REASONS = (("damaged", 0.30), ("wrong_item", 0.20), ("changed_mind", 0.25), ("late_delivery", 0.15), ("other", 0.10))
EVENT_TYPES = (("page_view", 0.55), ("search", 0.12), ("add_to_cart", 0.12), ("checkout", 0.10), ("purchase", 0.06), ("wishlist", 0.05))
DEVICES = (("desktop", 0.45), ("mobile", 0.48), ("tablet", 0.07))
ISSUE_TYPES = (("shipping", 0.30), ("damaged", 0.20), ("wrong_item", 0.15), ("billing", 0.15), ("product_question", 0.10), ("other", 0.10))
TICKET_STATUSES = (("resolved", 0.60), ("open", 0.25), ("pending", 0.15))
TICKET_PRIORITIES = (("low", 0.40), ("medium", 0.40), ("high", 0.15), ("urgent", 0.05))
MARKETING_CHANNELS = ("organic_search", "paid_search", "email", "social", "referral", "direct")
CATEGORIES = (("Electronics", 120.0, 0.9), ("Clothing", 45.0, 0.7), ("Home & Kitchen", 60.0, 0.8), ("Beauty", 28.0, 0.6), ("Sports & Outdoors", 70.0, 0.7), ("Toys & Games", 30.0, 0.6), ("Books & Media", 22.0, 0.5), ("Grocery", 8.0, 0.5))
PLACES = (("United States", "Austin"), ("United States", "Seattle"), ("Canada", "Toronto"), ("United Kingdom", "London"), ("Germany", "Berlin"), ("France", "Paris"), ("Netherlands", "Amsterdam"))
LINES_PER_ORDER = ((1, 0.45), (2, 0.30), (3, 0.15), (4, 0.07), (5, 0.03))
MONTH_WEIGHTS = {11: 1.6, 12: 1.8}
POPULARITY_POWER = 0.7


@dataclass(frozen=True)
class Config:
    seed: int = 42
    customers: int = 5_000
    products: int = 500
    orders: int = 50_000
    web_events: int = 50_000
    support_tickets: int = 300
    start: dt.date = dt.date(2024, 1, 1)
    end: dt.date = dt.date(2024, 12, 31)


def uniform(seed: int, purpose: str, row: Column) -> Column:
    """A value in (0, 1) for a row and a purpose."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), row.cast("long")), F.lit(1 << 48)).cast("double") + 0.5) / float(1 << 48)


def choose(u: Column, shares: Sequence[tuple]) -> Column:
    """A weighted choice by a uniform value."""
    out, total = None, 0.0
    for value, share in shares[:-1]:
        total += share
        out = F.when(u < total, value) if out is None else out.when(u < total, value)
    return out.otherwise(shares[-1][0]) if out is not None else F.lit(shares[-1][0])


def one_of(u: Column, values: Sequence) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def normal(seed: int, purpose: str, row: Column) -> Column:
    """A standard normal value by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(seed, purpose + "-r", row))) * F.cos(2 * math.pi * uniform(seed, purpose + "-a", row))


def popular(u: Column, n: int, power: float = POPULARITY_POWER) -> Column:
    """A rank from 1 to n with weight rank^-power, by inverting the continuous distribution."""
    return F.least(F.lit(n), F.floor(F.pow(u * (math.pow(n + 1, 1 - power) - 1) + 1, F.lit(1 / (1 - power))))).cast("long")


def seasonal_day(u: Column, start: dt.date, end: dt.date) -> Column:
    """A day, with November and December busier.

    The day is the number of ends up to ``u``.  Intervals of 2^-k hold one end at most: their
    number, which is exact, tells the ends before, and one comparison decides on the next.
    """
    weights, day = [], start
    while day <= end:
        weights.append(MONTH_WEIGHTS.get(day.month, 1.0))
        day += dt.timedelta(1)
    total, sums = sum(weights), []
    for w in weights:
        sums.append((sums[-1] if sums else 0.0) + w / total)
    k = 1 << max(0, math.ceil(-math.log2(min(weights) / total))) + 1
    before = [bisect.bisect_right(sums[:-1], i / k) for i in range(k)]
    values = lambda found, kind: F.expr(f"array({', '.join(f'{x!r}{kind}' for x in found)})")
    day = F.get(values(before, ""), F.floor(u * k).cast("int"))
    return F.date_add(F.lit(start), day + (F.get(values([*sums[:-1], 2.0], "D"), day) <= u).cast("int"))


class Generator:
    """The eight tables of a configuration; those in ``written`` are read where others are made from them."""

    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.c = spark, config or Config()
        self.written: dict[str, DataFrame] = {}

    def _rows(self, n: int) -> DataFrame:
        return self.spark.range(1, n + 1).withColumnRenamed("id", "i")

    def _u(self, purpose: str, row: Column | None = None) -> Column:
        return uniform(self.c.seed, purpose, F.col("i") if row is None else row)

    def customers(self) -> DataFrame:
        place = one_of(self._u("place"), range(len(PLACES)))
        days = (self.c.end - self.c.start).days + 1
        return self._rows(self.c.customers).withColumn("place", place).select(
            padded_id("C", F.col("i"), 6).alias("customer_id"), F.concat(F.lit("First"), F.floor(self._u("first") * 47)).alias("first_name"), F.concat(F.lit("Last"), F.floor(self._u("last") * 48)).alias("last_name"),
            F.concat(F.lit("user"), F.col("i"), F.lit("@"), one_of(self._u("domain"), ("gmail.com", "outlook.com", "yahoo.com", "example.com"))).alias("email"), F.date_add(F.lit(self.c.start), -F.floor(self._u("signup") * 2 * days).cast("int")).alias("signup_date"),
            F.element_at(F.array(*[F.lit(p[0]) for p in PLACES]), F.col("place") + 1).alias("country"), F.element_at(F.array(*[F.lit(p[1]) for p in PLACES]), F.col("place") + 1).alias("city"),
            one_of(self._u("marketing"), MARKETING_CHANNELS).alias("marketing_channel"), (18 + F.floor(self._u("age") * 60)).cast("int").alias("age"),
        )

    def _category(self, product: Column, at: int) -> Column:
        return F.element_at(F.array(*[F.lit(c[at]) for c in CATEGORIES]), ((product - 1) % len(CATEGORIES) + 1).cast("int"))

    def _price(self, product: Column) -> Column:
        price = self._category(product, 1) * F.exp(self._category(product, 2) * normal(self.c.seed, "price", product))
        return F.greatest(F.round(price, 2), F.lit(0.5))

    def products(self) -> DataFrame:
        brand = F.concat(F.lit("Brand"), F.floor(self._u("brand") * 20))
        return self._rows(self.c.products).select(padded_id("P", F.col("i"), 5).alias("product_id"), F.concat(brand, F.lit(" Item "), F.col("i") + 99).alias("product_name"), self._category(F.col("i"), 0).alias("category"), brand.alias("brand"), self._price(F.col("i")).alias("unit_price"))

    def _order_heads(self) -> DataFrame:
        return self._rows(self.c.orders).select(
            "i", padded_id("ORD", F.col("i"), 7).alias("order_id"), padded_id("C", popular(self._u("buyer"), self.c.customers), 6).alias("customer_id"), seasonal_day(self._u("order-day"), self.c.start, self.c.end).alias("order_date"),
            choose(self._u("status"), ORDER_STATUSES).alias("order_status"), choose(self._u("channel"), CHANNELS).alias("channel"), choose(self._u("lines"), LINES_PER_ORDER).alias("lines"),
        )

    def order_items(self) -> DataFrame:
        # A product's price follows from its number, so no table of products is joined.
        lines = self._order_heads().select("i", "order_id", F.explode(F.sequence(F.lit(1), F.col("lines"))).alias("line"))
        at = F.col("i") * 8 + F.col("line")
        lines = lines.withColumn("product", F.floor(self._u("line-product", at) * self.c.products) + 1).filter(F.col("product") <= self.c.products)
        jitter = 0.98 + 0.04 * self._u("line-price", at)
        lines = lines.withColumn("unit_price", F.round(self._price(F.col("product")) * jitter, 2)).withColumn("quantity", (F.floor(self._u("line-quantity", at) * 5) + 1).cast("int"))
        return lines.select(padded_id("OI", at, 8).alias("order_item_id"), "order_id", padded_id("P", F.col("product"), 5).alias("product_id"), "quantity", "unit_price", F.round(F.col("quantity") * F.col("unit_price"), 2).alias("line_total"))

    def orders(self) -> DataFrame:
        totals = self.table("order_items").groupBy("order_id").agg(F.round(F.sum(F.col("line_total").cast("decimal(18,2)")).cast("double"), 2).alias("total"))
        return self._order_heads().join(totals, "order_id", "left").select("order_id", "customer_id", "order_date", "order_status", "channel", F.coalesce("total", F.lit(0.0)).alias("total_amount"))

    def payments(self) -> DataFrame:
        n = F.substring("order_id", 5, 7).cast("long")
        status = F.when(F.col("order_status") == "cancelled", "failed").when(self._u("pending", n) < 0.03, "pending").otherwise("succeeded")
        return self.table("orders").select(padded_id("PAY", n, 7).alias("payment_id"), "order_id", choose(self._u("method", n), PAYMENT_METHODS).alias("payment_method"), status.alias("payment_status"), F.col("order_date").alias("payment_date"), F.col("total_amount").alias("amount"))

    def refunds(self) -> DataFrame:
        n = F.substring("order_id", 5, 7).cast("long")
        part = F.when(self._u("refund-full", n) < 0.7, 1.0).otherwise(0.3 + 0.5 * self._u("refund-part", n))
        late = (3 + F.floor(self._u("refund-days", n) * 43)).cast("int")
        return self.table("orders").filter("order_status = 'returned'").select(padded_id("REF", n, 6).alias("refund_id"), "order_id", "customer_id", F.date_add("order_date", late).alias("refund_date"), F.round(F.col("total_amount") * part, 2).alias("refund_amount"), choose(self._u("refund-reason", n), REFUND_REASONS).alias("refund_reason"))

    def web_events(self) -> DataFrame:
        customer = padded_id("C", F.floor(self._u("visitor") * self.c.customers) + 1, 6)
        return self._rows(self.c.web_events).select(
            padded_id("EVT", F.col("i"), 8).alias("event_id"), F.when(self._u("known") < 0.7, customer).alias("customer_id"), choose(self._u("event"), EVENT_TYPES).alias("event_type"), one_of(self._u("event-category"), [c[0] for c in CATEGORIES]).alias("category"),
            choose(self._u("device"), DEVICES).alias("device"), seasonal_day(self._u("event-day"), self.c.start, self.c.end).alias("event_date"),
        )

    def support_tickets(self) -> DataFrame:
        days = (self.c.end - self.c.start).days + 1
        t = self._rows(self.c.support_tickets).withColumn("customer_id", padded_id("C", F.floor(self._u("ticket-customer") * self.c.customers) + 1, 6))
        own = self.written.get("orders", self._order_heads()).select("customer_id", "order_id", F.row_number().over(Window.partitionBy("customer_id").orderBy("order_id")).alias("k"))
        sizes = own.groupBy("customer_id").agg(F.max("k").alias("n"))
        t = t.join(sizes, "customer_id", "left").withColumn("k", F.when(self._u("ticket-linked") < 0.6, F.floor(self._u("ticket-order") * F.col("n")) + 1).cast("int")).join(own, ["customer_id", "k"], "left")
        return t.select(
            padded_id("T", F.col("i"), 5).alias("ticket_id"), "customer_id", "order_id", choose(self._u("issue"), ISSUE_TYPES).alias("issue_type"), choose(self._u("priority"), TICKET_PRIORITIES).alias("priority"),
            F.date_add(F.lit(self.c.start), F.floor(self._u("ticket-day") * days).cast("int")).alias("ticket_date"), choose(self._u("ticket-status"), TICKET_STATUSES).alias("status"),
        )

    def table(self, name: str) -> DataFrame:
        return self.written[name] if name in self.written else getattr(self, name)()


def table_digest(df: DataFrame) -> str:
    """A digest of a table's rows that their order does not change."""
    return df.select(row_digest(sorted(df.columns)).alias("d")).agg(set_digest(F.col("d"))).first()[0]


def write_dataset(spark: SparkSession, root: str, config: Config | None = None) -> dict:
    """All tables as Parquet under a folder, with a manifest of rows, types and digests beside them.

    Items come first and orders next, since orders, payments, refunds and tickets are made from what is written of these.
    """
    from .schemas import TABLES
    from .versioned import Files

    config = config or Config()
    made = Generator(spark, config)
    tables: dict[str, dict] = {}
    for name in dict.fromkeys(("order_items", "orders", *TABLES)):
        path = f"{root}/{name}"
        made.table(name).write.mode("overwrite").parquet(path)
        df = made.written[name] = spark.read.parquet(path)
        tables[name] = {"path": path, "rows": df.count(), "columns": dict(df.dtypes), "sha256": table_digest(df)}
    manifest = {"seed": config.seed, "date_range": [config.start.isoformat(), config.end.isoformat()], "tables": {t: tables[t] for t in TABLES}}
    Files(spark, root).write_text(f"{root}/manifest.json", json.dumps(manifest, indent=2))
    return manifest


def read_manifest(spark: SparkSession, root: str) -> dict:
    from .versioned import Files

    return json.loads(Files(spark, root).read_text(f"{root}/manifest.json"))
