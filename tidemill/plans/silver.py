"""Cleaned dimensions and facts.

Facts that also arrive as a stream merge both sources, and the batch row wins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean, day_name, days_between, enum, iso_weekday, money
from ..operators.relational import keep_first, merge_sources, ranked_union
from .context import TIMES, Context

Join = Callable[[DataFrame, DataFrame, list[str], str], DataFrame]


def dim_customers(ctx: Context) -> DataFrame:
    """One customer for each normalised email; the earliest signup wins, then the smaller id."""
    c = ctx("bronze.customers").select(
        "customer_id", clean("first_name").alias("first_name"), clean("last_name").alias("last_name"), enum("email").alias("email"), "signup_date",
        clean("country").alias("country"), clean("city").alias("city"), enum("marketing_channel").alias("marketing_channel"), "age",
    )
    return keep_first(c, ["email"], ["signup_date", "customer_id"])


def dim_products(ctx: Context) -> DataFrame:
    """Products with a positive price."""
    return ctx("bronze.products").filter("unit_price > 0").select("product_id", *[clean(c).alias(c) for c in ("product_name", "category", "brand")], money("unit_price").alias("unit_price"))


def dim_order_dates(ctx: Context) -> DataFrame:
    """Every day from the first to the last batch order."""
    span = ctx("bronze.orders").agg(F.min("order_date").alias("a"), F.max("order_date").alias("z")).filter("a is not null")
    d = F.col("order_date")
    days = span.select(F.explode(F.sequence("a", "z")).alias("order_date"))
    return days.select(
        d, F.year(d).alias("year"), F.month(d).alias("month"), F.quarter(d).alias("quarter"),
        iso_weekday(d).alias("day_of_week"), day_name(d).alias("day_of_week_name"), F.month(d).isin(11, 12).alias("is_holiday_season"),
    )


def merged_orders(ctx: Context) -> DataFrame:
    return merge_sources(ctx("bronze.orders"), ctx("bronze.stream_orders"), "order_id")


def merged_items(ctx: Context) -> DataFrame:
    return merge_sources(ctx("bronze.order_items"), ctx("bronze.stream_order_items"), "order_item_id")


def merged_payments(ctx: Context) -> DataFrame:
    """One payment for each order: batch first, then the smallest payment id."""
    return merge_sources(ctx("bronze.payments"), ctx("bronze.stream_payments"), "order_id", ["payment_id"])


def item_counts(ctx: Context, raw_item_union: bool = False) -> DataFrame:
    """Items and distinct products of each order.

    Items in both sources count once; with ``raw_item_union`` they count as often as they occur.
    One shuffle by order serves all steps: items fall together, then products, then the order.
    """
    columns = ["order_id", "order_item_id", "product_id"]
    return count_items(ranked_union(ctx("bronze.order_items").select(*columns), ctx("bronze.stream_order_items").select(*columns)).repartition("order_id"), raw_item_union)


def count_items(both: DataFrame, raw_item_union: bool = False) -> DataFrame:
    """Items and distinct products of each order, of item rows with src_rank that are dealt out by order."""
    items = both.groupBy("order_id", "order_item_id").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("src_rank", "product_id")).alias("first"))
    products = items.groupBy("order_id", F.col("first.product_id").alias("product_id")).agg((F.sum("times") if raw_item_union else F.count(F.lit(1))).alias("n"))
    return products.groupBy("order_id").agg(F.sum("n").cast("long").alias("item_count"), F.count("product_id").alias("distinct_products"))


def fct_orders(ctx: Context, raw_item_union: bool = False) -> DataFrame:
    # One row for each order already; as a group of its own the planner knows that too, and leaves payments out where no column of theirs is read.
    paid = merged_payments(ctx).groupBy("order_id").agg(F.any_value("payment_status").alias("payment_status"))
    return orders_fact(merged_orders(ctx), item_counts(ctx, raw_item_union), paid, ctx("bronze.customers"))


def orders_fact(merged: DataFrame, counts: DataFrame, payments: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders of known customers, with their counts and payment."""
    status = enum("order_status")
    paid = payments.select("order_id", enum("payment_status").alias("payment_status"))
    # By order first, where all three are dealt out alike, and by customer last.
    orders = merged.join(counts, "order_id", "left").join(paid, "order_id", "left")
    # An inner join with distinct keys: a semi join would be pushed below the joins by order, which are then dealt out anew.
    orders = orders.join(customers.select("customer_id").distinct(), "customer_id")
    p = F.col("payment_status")
    return orders.select(
        "order_id", "customer_id", "order_date", status.alias("order_status"), enum("channel").alias("channel"), money("total_amount").alias("total_amount"),
        F.coalesce("item_count", F.lit(0)).cast("long").alias("item_count"), F.coalesce("distinct_products", F.lit(0)).cast("long").alias("distinct_product_count"),
        (status == "completed").alias("is_completed"), (status == "returned").alias("is_returned"), (status == "cancelled").alias("is_cancelled"),
        p.isNotNull().alias("has_payment"), (p == "succeeded").alias("is_payment_succeeded"), ((status == "cancelled") != (p == "failed")).alias("payment_status_conflict"),
    )


def fct_order_items(ctx: Context) -> DataFrame:
    order_ids = ctx("bronze.orders").select("order_id").union(ctx("bronze.stream_orders").select("order_id")).distinct()
    return items_fact(merged_items(ctx), order_ids, ctx("silver.dim_products"))


def known_items(ctx: Context) -> DataFrame:
    """The items of the fact without their products' columns, and how many rows of the fact each is (several, where several products have one id)."""
    times = ctx("silver.dim_products").groupBy("product_id").agg(F.count(F.lit(1)).alias(TIMES))
    order_ids = ctx("bronze.orders").select("order_id").union(ctx("bronze.stream_orders").select("order_id")).distinct()
    return item_rows(merged_items(ctx), order_ids).join(times, "product_id")


def described_items(ctx: Context) -> DataFrame:
    """The fact from its known items."""
    return describe_items(ctx.weighted("silver.fct_order_items"), ctx("silver.dim_products"))


def item_rows(merged: DataFrame, orders: DataFrame) -> DataFrame:
    """Items of known orders, without columns of their products."""
    mismatch = money(F.col("quantity") * F.col("unit_price")) != money("line_total")
    return merged.join(orders.select("order_id"), "order_id", "left_semi").select("order_item_id", "order_id", "product_id", "quantity", money("unit_price").alias("unit_price"), money("line_total").alias("line_total"), mismatch.alias("line_total_mismatch"))


def describe_items(items: DataFrame, products: DataFrame) -> DataFrame:
    """``item_rows`` with the columns of their products.

    Several products may have one id, so the join gives many times what it reads.  Its tasks
    are all that a shuffle has, not few by the size of their input, and products, which grow
    with the shop, are not broadcast.
    """
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return items.repartition(tasks, "product_id").join(products.drop("unit_price").hint("merge"), "product_id").select("order_item_id", "order_id", "product_id", "product_name", "category", "brand", "quantity", "unit_price", "line_total", "line_total_mismatch")


def items_fact(merged: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """Items of known orders and known products."""
    return describe_items(item_rows(merged, orders), products)


def fct_payments(ctx: Context) -> DataFrame:
    return payments_fact(merged_payments(ctx), merged_orders(ctx))


def payments_fact(payments: DataFrame, merged: DataFrame) -> DataFrame:
    """Payments of known orders."""
    status = enum("payment_status")
    return payments.join(merged.select("order_id", "customer_id", "total_amount"), "order_id").select(
        "payment_id", "order_id", "customer_id", enum("payment_method").alias("payment_method"), status.alias("payment_status"), "payment_date", money("amount").alias("amount"),
        (status == "succeeded").alias("is_succeeded"), (status == "failed").alias("is_failed"), (status == "pending").alias("is_pending"), (money("amount") != money("total_amount")).alias("amount_mismatch"),
    )


def fct_refunds(ctx: Context, join: Join = DataFrame.join) -> DataFrame:
    """Refunds of batch orders; ``join``: how they are joined (``operators.skew.salted_join`` where few orders hold many)."""
    orders = ctx("bronze.orders").select("order_id", "order_date", "total_amount")
    return join(ctx("bronze.refunds"), orders, ["order_id"], "inner").select(
        "refund_id", "order_id", "customer_id", "order_date", "refund_date", days_between("order_date", "refund_date").alias("refund_lag_days"), money("refund_amount").alias("refund_amount"),
        money("total_amount").alias("order_total"), enum("refund_reason").alias("refund_reason"), (money("refund_amount") >= money("total_amount")).alias("is_full_refund"),
    )


def fct_web_events(ctx: Context) -> DataFrame:
    events = merge_sources(ctx("bronze.web_events"), ctx("bronze.stream_web_events"), "event_id")
    return events.select("event_id", "customer_id", enum("event_type").alias("event_type"), clean("category").alias("category"), enum("device").alias("device"), "event_date", F.col("customer_id").isNull().alias("is_anonymous"))


def fct_support_tickets(ctx: Context, join: Join = DataFrame.join) -> DataFrame:
    """Tickets; a link is valid if the order is the customer's own batch order."""
    own = ctx("bronze.orders").select("order_id", "customer_id", F.lit(True).alias("own"))
    return join(ctx("bronze.support_tickets"), own, ["order_id", "customer_id"], "left").select(
        "ticket_id", "customer_id", "order_id", F.col("order_id").isNotNull().alias("has_linked_order"), F.col("own").isNotNull().alias("linked_order_valid"),
        enum("issue_type").alias("issue_type"), enum("priority").alias("priority"), "ticket_date", enum("status").alias("status"),
    )
