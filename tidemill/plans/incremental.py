"""Merged facts kept up to date by what has changed.

Raw rows of both sources lie in tables that are bucketed by order id and partitioned by
block, a range of order numbers.  The orders, payments and items of an order share bucket
and block, so merging, counting and joining them by order needs no exchange.  Rows that
arrive are appended, and the blocks that they fall in are noted; a refresh reads these
blocks of the raw tables and writes these blocks of the facts, by dynamic partition
overwrite, and leaves all others alone.

An order depends on its own rows and on whether its customer is known, and its items on
their products.  Digests of customers and products are kept from the last refresh: if
customers differ now, every block is computed again, and if products do, every block of
items.  An item id belongs to one order, as everything about an order lies in its block.

Items are written without their products' columns, beside a snapshot of the products that
they were computed with, and joined with it when they are read: where several products have
one id, the joined rows are many more than the items.

State is on disk: tables, the log of changes and that of refreshes.  ``attach`` makes a
new session know tables that an earlier one wrote.  A block is noted before its rows are
appended, so a refresh after a lost append computes too much, never too little.  Before the
first refresh nothing is noted, since that computes every block.

A bucket of all blocks is a task, so the number of buckets should follow that of orders
(``buckets_for``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import id_number, set_digest
from ..operators.relational import keep_first
from ..sources.schemas import schema
from ..sources.scratch import settings
from ..sources.versioned import Files
from . import silver
from .context import Context

RAW = ("orders", "order_items", "payments")
FACTS = {"orders": "fct_orders", "payments": "fct_payments", "order_items": "fct_order_items"}
#: Orders numbered in a block, and buckets of a block.
BLOCK, BUCKETS = 50_000, 8
#: Orders that a bucket should hold, and the bounds of the number of buckets: each has a file in every block.
BUCKET_ORDERS, FEWEST, MOST = 100_000, 4, 96


def buckets_for(orders: int) -> int:
    """Buckets for a number of orders."""
    return min(max(-(-orders // BUCKET_ORDERS), FEWEST), MOST)


class OrderTables:
    """Raw tables and facts of orders under one folder and database."""

    def __init__(self, spark: SparkSession, root: str, database: str, block: int = BLOCK, buckets: int = BUCKETS):
        self.spark, self.root, self.database, self.block, self.buckets = spark, root.rstrip("/"), database, block, buckets
        self.files = Files(spark, self.root)
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")

    def name(self, table: str) -> str:
        return f"`{self.database}`.`{table}`"

    def table(self, table: str) -> DataFrame:
        """A raw table or a fact, with the column ``block``; items with the products of the last refresh."""
        rows = self.spark.table(self.name(table))
        return silver.describe_items(rows, self._products()).select("*", self.block_of()) if table == FACTS["order_items"] else rows

    def _products(self) -> DataFrame:
        """The newest snapshot of products that a complete refresh wrote."""
        newest = max(int(n) for n in self.files.names(f"{self.root}/products") if int(n) <= self.refreshes())
        return self.spark.read.parquet(f"{self.root}/products/{newest}")

    def _known(self, table: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.database}.{table}")

    def block_of(self, order_id: str = "order_id") -> F.Column:
        """The block of an order; ids that do not end in a number share one."""
        return F.coalesce(F.call_function("div", id_number(order_id), F.lit(self.block)), F.lit(-1).cast("bigint")).alias("block")

    def _write(self, table: str, rows: DataFrame, mode: str) -> None:
        # Dealt out as the buckets are, so a task writes one bucket of each block.
        rows.repartition(self.buckets, "order_id").write.mode(mode).format("parquet").partitionBy("block").bucketBy(self.buckets, "order_id").sortBy("order_id").option("path", f"{self.root}/{table}").saveAsTable(self.name(table))

    def append(self, table: str, rows: DataFrame, src_rank: int) -> None:
        """Rows of a raw table (1: batch, 2: stream), whose blocks the next refresh computes."""
        placed = rows.select(*schema(table).names, F.lit(src_rank).alias("src_rank"), self.block_of())
        if refreshes := self.refreshes():  # the first one computes all blocks
            placed.select("block").distinct().coalesce(1).write.mode("append").parquet(f"{self.root}/changes/refresh={refreshes + 1}")
        self._write(table, placed, "append")

    def refreshes(self) -> int:
        """Refreshes that are complete."""
        return max([0, *(int(n) for n in self.files.names(f"{self.root}/refreshes"))])

    def touched(self) -> list[int]:
        """Blocks with rows that no complete refresh has seen: one number for each, as many as blocks at most."""
        changes = f"{self.root}/changes/refresh={self.refreshes() + 1}"
        return sorted(r[0] for r in self.spark.read.parquet(changes).distinct().collect()) if self.files.exists(changes) else []

    def raw(self, table: str, blocks: Iterable[int] | None = None) -> DataFrame:
        df = self.table(table)
        return df if blocks is None else df.filter(F.col("block").isin(list(blocks)))

    def build(self, customers: DataFrame, blocks: list[int] | None = None) -> dict[str, DataFrame]:
        """The facts of some blocks, or of all, with the column ``block``."""
        merged = keep_first(self.raw("orders", blocks), ["order_id"], ["src_rank"])
        paid = keep_first(self.raw("payments", blocks), ["order_id"], ["src_rank", "payment_id"])
        counts = silver.count_items(self.raw("order_items", blocks))
        orders = silver.orders_fact(merged.drop("block", "src_rank"), counts, paid.select("order_id", "payment_status"), customers)
        payments = silver.payments_fact(paid.drop("block", "src_rank"), merged)
        return {"fct_orders": orders.select("*", self.block_of()), "fct_payments": payments.select("*", self.block_of())}

    def build_items(self, products: DataFrame, blocks: list[int] | None = None) -> DataFrame:
        """The items of some blocks, or of all, that have a product, as they are written: without its columns, with ``block``."""
        merged = keep_first(self.raw("order_items", blocks), ["order_id", "order_item_id"], ["src_rank"])
        items = silver.item_rows(merged.drop("block", "src_rank"), self.raw("orders", blocks))
        return items.join(products.select("product_id"), "product_id", "left_semi").select(*items.columns, self.block_of())

    def refresh(self, customers: DataFrame, products: DataFrame | None = None) -> dict[str, int | bool]:
        """Bring the facts up to date (items only with products): blocks computed, blocks in all, and whether all had to be."""
        for t in RAW:
            if not self._known(t):
                self.append(t, self.spark.createDataFrame([], schema(t)), 2)
        seen = [_digest(customers, "customer_id"), _digest(products, *products.columns) if products else "none"]
        number = self.refreshes()
        last = self.files.read_text(f"{self.root}/refreshes/{number}").split() if number else [None, None]
        everything = last[0] != seen[0]
        blocks = None if everything else self.touched()
        if everything or blocks:
            for table, rows in self.build(customers, blocks).items():
                self._replace(table, rows, blocks)
        all_items = everything or last[1] != seen[1]
        if products and all_items:
            products.write.mode("overwrite").parquet(f"{self.root}/products/{number + 1}")
        if products and (all_items or blocks):
            self._replace("fct_order_items", self.build_items(products, None if all_items else blocks), None if all_items else blocks)
        self.files.write_text(f"{self.root}/refreshes/{number + 1}", " ".join(seen))
        total = self.table("orders").select("block").union(self.table("payments").select("block")).union(self.table("order_items").select("block")).distinct().count()
        return {"blocks": total if everything else len(blocks), "of": total, "everything": everything}

    def _replace(self, table: str, rows: DataFrame, blocks: list[int] | None) -> None:
        if blocks is None or not self._known(table):
            self._write(table, rows, "overwrite")
            return
        with settings(self.spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
            columns = self.spark.table(self.name(table)).columns
            rows.select(*columns).repartition(self.buckets, "order_id").write.mode("overwrite").insertInto(self.name(table))

    def attach(self) -> None:
        """Make the catalog of this session know the tables of an earlier one."""
        for t in (*RAW, *FACTS.values()):
            if self.files.exists(f"{self.root}/{t}") and not self._known(t):
                found = self.spark.read.parquet(f"{self.root}/{t}").schema
                columns = ", ".join(f"`{f.name}` {f.dataType.simpleString() if f.name != 'block' else 'bigint'}" for f in found)
                self.spark.sql(f"CREATE TABLE {self.name(t)} ({columns}) USING parquet PARTITIONED BY (block) CLUSTERED BY (order_id) SORTED BY (order_id) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{t}'")
                self.spark.catalog.recoverPartitions(f"{self.database}.{t}")


def _digest(df: DataFrame, *columns: str) -> str:
    # Dealt out first: hashing is the work, and a file of few row groups is read by few tasks.
    return df.select(*columns).repartition(columns[0]).agg(set_digest(F.sha2(F.to_json(F.struct(*columns)), 256))).first()[0]


def start(tables: OrderTables, ctx: Context, stream: dict[str, DataFrame] | None = None, items: bool = True) -> dict[str, int | bool]:
    """Load both sources of a context (``stream``: other rows for the streams) and refresh for the first time, with or without items."""
    for t in RAW:
        tables.append(t, ctx(f"bronze.{t}"), 1)
        tables.append(t, (stream or {}).get(t, ctx(f"bronze.stream_{t}")), 2)
    return tables.refresh(ctx("bronze.customers"), ctx("silver.dim_products") if items else None)
