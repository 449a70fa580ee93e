"""Registered queries for storage, streams, serving, the generator and the verifiers.

Those that write work in a scratch folder of the shared place.  Where a result is a
statement about what was done, its SQL counts the same from the tables.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import orphans
from ..sources import generator, landing
from ..sources.schemas import DATES, KEYS, STREAMS, TABLES
from ..sources.scratch import scratch
from ..sources.versioned import Files, Store
from ..streaming import ingest, monitor, producer
from . import marts, quality, serving, silver, verify
from .catalog import MART_SQL, ORACLE, QUERIES, add
from .catalog_more import _DQ, check_report, own
from .context import driver_context
from .oracle import oracle

_PLACE = {"bronze": "b", "silver": "s", "gold": "g"}


def sql(name: str, text: str) -> None:
    ORACLE[name] = oracle(text)


def _union(rows: list[str]) -> str:
    return "\nUNION ALL ".join(f"SELECT {r}" for r in rows)


# --- sources and storage ---------------------------------------------------------------
@own("io04_external_table")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, database = scratch(spark), f"landing_{uuid.uuid4().hex}"
    path = landing.land(spark.read.parquet(f"{sf_dir}/nation.parquet"), root, "nation")
    for _i in range(2):  # a second time: dropped and made anew
        landing.external_table(spark, database, "nation", path)
    return spark.table(f"{database}.nation")


sql("io04_external_table", "SELECT * FROM nation")


@own("io06_databases")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"{layer}_{uuid.uuid4().hex}" for layer in _PLACE]
    for _i in range(2):
        landing.create_databases(spark, *names)
    known = {d.name for d in spark.catalog.listDatabases()}
    return spark.createDataFrame([(n.partition("_")[0], n in known) for n in names], "layer string, known boolean")


sql("io06_databases", _union(["'bronze' AS layer, true AS known", "'silver', true", "'gold', true"]))


@own("io07_round_trip")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    (*rows, types) = landing.round_trip(spark, scratch(spark))
    return spark.createDataFrame([("row", repr(r)) for r in rows] + [("type", f"{c} {t}") for c, t in types], "kind string, text string")


sql("io07_round_trip", _union(["'row' AS kind, '(1, ''a'', 1.5)' AS text", "'row', '(2, None, -2.0)'", "'type', 'id int'", "'type', 'name string'", "'type', 'x double'"]))


@own("io08_catalog")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, database = scratch(spark), f"schema_{uuid.uuid4().hex}"
    for t in ("nation", "customer"):
        landing.external_table(spark, database, t, landing.land(spark.read.parquet(f"{sf_dir}/{t}.parquet"), root, t))
    return landing.catalog_tables(spark, database).drop("database")


sql("io08_catalog", "SELECT table_name, column_name, CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(data_type) END AS data_type FROM information_schema.columns WHERE table_name IN ('nation', 'customer')")


@own("io11_register_stream")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ingest.stream_specs(scratch(spark))["payments"]
    payments = driver_context(spark, sf_dir)("bronze.stream_payments")
    first = F.pmod(F.xxhash64("payment_id"), F.lit(2)) == 0
    producer.send(payments.filter(first), spec)
    ingest.ingest_available(spark, spec)
    name = ingest.register(spark, spec, f"bronze_{uuid.uuid4().hex}")
    producer.send(payments.filter(~first), spec)  # rows that arrive after the registration are seen too
    ingest.ingest_available(spark, spec)
    return spark.table(name)


sql("io11_register_stream", "SELECT * FROM b_stream_payments")


def sized(spark: SparkSession, sf_dir: str) -> generator.Config:
    """A configuration with as many rows as the tables of a folder have."""
    n = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
    return generator.Config(customers=n("customer"), products=n("part"), orders=n("orders"), web_events=n("events"), support_tickets=max(1, n("events") // 100))


#: The same numbers in SQL.
SIZES = {"customers": "(SELECT count(*) FROM customer)", "products": "(SELECT count(*) FROM part)", "orders": "(SELECT count(*) FROM orders)", "web_events": "(SELECT count(*) FROM events)", "support_tickets": "(SELECT greatest(1, count(*) // 100) FROM events)"}


@own("io14_dataset_writer")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    generator.write_dataset(spark, root, sized(spark, sf_dir))
    manifest = generator.read_manifest(spark, root)["tables"]
    rows = []
    for t, m in manifest.items():
        df = spark.read.parquet(m["path"])
        rows.append((t, df.count() == m["rows"], dict(df.dtypes) == m["columns"], generator.table_digest(df) == m["sha256"]))
    return spark.createDataFrame(rows, "table_name string, same_rows boolean, same_types boolean, same_digest boolean")


sql("io14_dataset_writer", _union([f"'{t}' AS table_name, true AS same_rows, true AS same_types, true AS same_digest" for t in TABLES]))


@own("io15_object_listing")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    landing.land(spark.read.parquet(f"{sf_dir}/region.parquet").coalesce(1), root, "region")
    listed = landing.list_objects(spark, root)
    data = listed.filter("path like '%.parquet'").agg(F.count(F.lit(1)).alias("n"), F.min("bytes").alias("bytes")).first()
    n = listed.count()
    return spark.createDataFrame([(data["n"], data["bytes"] > 0, landing.purge(spark, root) == n, len(Files(spark, root).listing(root)))], "data_files bigint, with_bytes boolean, all_purged boolean, left_over int")


sql("io15_object_listing", "SELECT 1 AS data_files, true AS with_bytes, true AS all_purged, 0 AS left_over")


@own("io16_fetch")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = marts.mart(driver_context(spark, sf_dir), "channel_mix")
    rows, table = serving.fetch(spark, customers), serving.frame(spark, customers)
    return spark.createDataFrame([(r["channel"], r["net_revenue"], int((table["channel"] == r["channel"]).sum())) for r in rows], "channel string, net_revenue decimal(24,2), in_frame int")


sql("io16_fetch", "SELECT channel, CAST(sum(net_revenue) AS DECIMAL(24,2)) AS net_revenue, 1 AS in_frame FROM g_revenue_by_channel GROUP BY channel")


@own("io17_result_cache")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = [0.0]
    cache = serving.ResultCache(clock=lambda: now[0])
    read = lambda: serving.fetch(spark, spark.read.parquet(f"{sf_dir}/region.parquet").agg(F.count(F.lit(1)).alias("n")))
    rows, before = [], None
    for step, at, clear in (("first", 0.0, False), ("within the time", 299.0, False), ("after it", 301.0, False), ("cleared", 302.0, True)):
        now[0] = at
        if clear:
            cache.clear()
        found = cache.get("regions", read)
        rows.append((step, found is before, found[0]["n"]))
        before = found
    return spark.createDataFrame(rows, "step string, from_cache boolean, n bigint")


sql("io17_result_cache", _union([f"'{s}' AS step, {c} AS from_cache, (SELECT count(*) FROM region) AS n" for s, c in (("first", "false"), ("within the time", "true"), ("after it", "false"), ("cleared", "false"))]))


@own("io19_versions")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, n = Store(spark, scratch(spark)), spark.read.parquet(f"{sf_dir}/nation.parquet")
    for limit in (5, 10, 25):
        store.write("t.nation", n.filter(F.col("n_nationkey") < limit).coalesce(1))
    rows = [(v.number, v.files, v.bytes > 0, store.read("t.nation", v.number).count(), v.number == store.current("t.nation")) for v in store.versions("t.nation")]
    return spark.createDataFrame(rows, "version int, files int, with_bytes boolean, rows bigint, is_current boolean")


sql("io19_versions", _union([f"{i} AS version, 1 AS files, true AS with_bytes, (SELECT count(*) FROM nation WHERE n_nationkey < {k}) AS rows, {i == 3} AS is_current" for i, k in ((1, 5), (2, 10), (3, 25))]))


@own("io20_expire_versions")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, r = Store(spark, scratch(spark)), spark.read.parquet(f"{sf_dir}/region.parquet")
    far = 1e12
    store.write("t.few", r)
    store.write("t.few", r)
    kept = len(store.expire("t.few", 60, now=far))  # fewer than three versions are left alone
    for _i in range(4):
        store.write("t.region", r)
    gone = store.expire("t.region", 60, now=far)
    return spark.createDataFrame([(kept, len(gone), len(store.versions("t.region")), store.read("t.region").count())], "expired_of_two int, expired_of_four int, versions int, rows bigint")


sql("io20_expire_versions", "SELECT 0 AS expired_of_two, 3 AS expired_of_four, 1 AS versions, (SELECT count(*) FROM region) AS rows")


@own("io21_orphan_files")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, n = Store(spark, scratch(spark)), spark.read.parquet(f"{sf_dir}/nation.parquet").coalesce(1)
    store.write("t.nation", n)
    unfinished = f"{store.folder('t.nation')}/v=2"
    n.write.parquet(unfinished)
    store.files.remove(f"{unfinished}/_SUCCESS")
    young = store.remove_orphans("t.nation", 3600)
    old = store.remove_orphans("t.nation", 60, now=1e12)
    return spark.createDataFrame([(young["files"], old["files"], old["bytes"] > 0, store.read("t.nation").count())], "young_removed int, old_removed int, with_bytes boolean, rows bigint")


sql("io21_orphan_files", "SELECT 0 AS young_removed, 1 AS old_removed, true AS with_bytes, (SELECT count(*) FROM nation) AS rows")


# --- silver with the items of both sources counted as often as they occur --------------------
add("s04_raw_item_union", lambda c: silver.fct_orders(c, raw_item_union=True).select("order_id", "item_count", "distinct_product_count"),
    "SELECT o.order_id, coalesce(i.n, 0) AS item_count, coalesce(i.p, 0) AS distinct_product_count FROM s_fct_orders o LEFT JOIN (SELECT order_id, count(*) AS n, count(DISTINCT product_id) AS p FROM (SELECT order_id, product_id FROM b_order_items UNION ALL SELECT order_id, product_id FROM b_stream_order_items) GROUP BY order_id) i USING (order_id)")


# --- streams ------------------------------------------------------------------------------
def _sent(spark: SparkSession, sf_dir: str, name: str) -> tuple[ingest.StreamSpec, DataFrame]:
    spec = ingest.stream_specs(scratch(spark))[name]
    table = driver_context(spark, sf_dir)(f"bronze.stream_{name}")
    producer.send(table, spec)
    return spec, table


@own("st02_restart_resumes")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, _table = _sent(spark, sf_dir, "payments")
    runs = [ingest.ingest_available(spark, spec) for _i in range(2)]
    producer.send(ingest.read_table(spark, spec).limit(1), spec)
    runs.append(ingest.ingest_available(spark, spec))
    return spark.createDataFrame([tuple(runs)], "first_run bigint, second_run bigint, after_one_more bigint")


sql("st02_restart_resumes", "SELECT (SELECT count(*) FROM b_stream_payments) AS first_run, 0 AS second_run, 1 AS after_one_more")


@own("st03_checkpoint_kept")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, _table = _sent(spark, sf_dir, "payments")
    query = ingest.start(spark, spec)
    query.processAllAvailable()
    every = query.lastProgress is not None and ingest.CHECKPOINT_SECONDS
    query.stop()  # cancelled: the checkpoint stays, and a later run goes on from it
    commits = Files(spark, spec.checkpoint).names(f"{spec.checkpoint}/commits")
    return spark.createDataFrame([(every, "0" in commits, ingest.ingest_available(spark, spec), ingest.read_table(spark, spec).count())], "trigger_seconds int, commit_kept boolean, read_again bigint, rows bigint")


sql("st03_checkpoint_kept", "SELECT 10 AS trigger_seconds, true AS commit_kept, 0 AS read_again, (SELECT count(*) FROM b_stream_payments) AS rows")


@own("st04_duplicates_after_kill")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = driver_context(spark, sf_dir)
    spec, _table = _sent(spark, sf_dir, "web_events")
    ingest.ingest_available(spark, spec)
    Files(spark, spec.checkpoint).remove(spec.checkpoint)  # the whole checkpoint is lost: everything is delivered again
    ingest.ingest_available(spark, spec)
    ctx.tables["bronze.stream_web_events"] = ingest.read_table(spark, spec)
    return spark.createDataFrame([(ctx("bronze.stream_web_events").count(), silver.fct_web_events(ctx).count())], "delivered bigint, fact_rows bigint")


sql("st04_duplicates_after_kill", "SELECT 2 * (SELECT count(*) FROM b_stream_web_events) AS delivered, (SELECT count(*) FROM s_fct_web_events) AS fact_rows")


def _replay(spark: SparkSession, sf_dir: str) -> tuple[dict[str, ingest.StreamSpec], dict[str, DataFrame]]:
    ctx = driver_context(spark, sf_dir)
    return ingest.stream_specs(scratch(spark)), {n: ctx(f"bronze.stream_{n}") for n in STREAMS}


@own("st05_replay")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs, tables = _replay(spark, sf_dir)
    sent = producer.replay(spark, tables, specs)
    rows = []
    for n in STREAMS:
        values = spark.read.schema("value string").text(specs[n].source)
        # File order: what the files hold, by name, is ascending; at the seams too.
        key = F.get_json_object("value", f"$.{KEYS[n]}")
        ends = values.select(F.input_file_name().alias("file"), key.alias("key")).groupBy("file").agg(F.min("key").alias("low"), F.max("key").alias("high")).orderBy("file").collect()
        rows.append((n, sent[n], verify.same_rows(values, producer.to_messages(tables[n])), all(a["high"] <= b["low"] for a, b in zip(ends, ends[1:], strict=False))))
    return spark.createDataFrame(rows, "stream string, sent bigint, same_payloads boolean, in_order boolean")


sql("st05_replay", _union([f"'{n}' AS stream, (SELECT count(*) FROM b_stream_{n}) AS sent, true AS same_payloads, true AS in_order" for n in STREAMS]))


@own("st09_replay_once")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs, tables = _replay(spark, sf_dir)
    one = {"orders": tables["orders"]}
    steps = (("first", {}), ("if empty", {"if_empty": True}), ("reset", {"reset_topics": True}))
    rows = [(name, producer.replay(spark, one, specs, **how)["orders"], producer.end_offset(spark, specs["orders"])) for name, how in steps]
    return spark.createDataFrame(rows, "step string, sent bigint, end_offset bigint")


sql("st09_replay_once", _union([f"'{s}' AS step, {n} AS sent, (SELECT count(*) FROM b_stream_orders) AS end_offset" for s, n in (("first", "(SELECT count(*) FROM b_stream_orders)"), ("if empty", "0"), ("reset", "(SELECT count(*) FROM b_stream_orders)"))]))


@own("st08_interleaved")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs, tables = _replay(spark, sf_dir)
    n = {"orders": 40, "web_events": 400}
    live = {"orders": (tables["orders"].orderBy("order_id").limit(40), "order_id", 0.5), "web_events": (tables["web_events"].orderBy("event_id").limit(400), "event_id", 0.05)}
    sent = producer.drop_interleaved(live, specs, 5.0)
    both = sum(all(s.values()) for s in sent)  # steps in which both streams have messages
    return spark.createDataFrame([(k, sum(s[k] for s in sent), producer.end_offset(spark, specs[k]), len(sent) > 1 and both >= len(sent) - 2) for k in n], "stream string, sent bigint, end_offset bigint, mixed boolean")


sql("st08_interleaved", _union([f"'{k}' AS stream, (SELECT least({n}, count(*)) FROM b_stream_{k}) AS sent, (SELECT least({n}, count(*)) FROM b_stream_{k}) AS end_offset, true AS mixed" for k, n in (("orders", 40), ("web_events", 400))]))


@own("st11_consumer_lag")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, _table = _sent(spark, sf_dir, "payments")
    before = monitor.lag(spark, spec)
    ingest.ingest_available(spark, spec)
    return spark.createDataFrame([(before, monitor.lag(spark, spec), monitor.caught_up(spark, spec))], "lag_before bigint, lag_after bigint, caught_up boolean")


sql("st11_consumer_lag", "SELECT (SELECT count(*) FROM b_stream_payments) AS lag_before, 0 AS lag_after, true AS caught_up")


@own("st12_job_state")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, _table = _sent(spark, sf_dir, "orders")
    query = ingest.start(spark, spec)
    query.processAllAvailable()
    running = monitor.state(spark, spec)
    query.stop()
    return spark.createDataFrame([(running["state"], running["batches"] > 0, running["last_ms"] is not None, monitor.state(spark, spec)["state"])], "state string, has_batches boolean, has_duration boolean, after_stop string")


sql("st12_job_state", "SELECT 'RUNNING' AS state, true AS has_batches, true AS has_duration, 'not running' AS after_stop")


@own("st13_event_rate")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate over samples of a table that grew by its rows in the last minute; a sample older than two minutes does not count."""
    n = driver_context(spark, sf_dir)("bronze.stream_web_events").count()
    return spark.createDataFrame([(monitor.event_rate([(0.0, 0), (100.0, 10), (160.0, 10 + n)], 200.0), monitor.event_rate([(0.0, 0), (4.0, n)], 4.0))], "per_minute double, too_short double")


sql("st13_event_rate", "SELECT CAST((SELECT count(*) FROM b_stream_web_events) AS DOUBLE) AS per_minute, CAST(NULL AS DOUBLE) AS too_short")


@own("st14_catch_up_gate")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, _table = _sent(spark, sf_dir, "payments")
    now, polls = [0.0], []

    def wait(seconds: float) -> None:
        now[0] += seconds
        polls.append(seconds)
        if len(polls) == 2:
            ingest.ingest_available(spark, spec)

    try:
        monitor.await_caught_up(spark, [spec], tolerance=0, deadline=5, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
        late = "no"
    except monitor.CatchUpTimeout:
        late = "timeout"
    now[0] = 0.0
    behind = monitor.await_caught_up(spark, [spec], tolerance=0, clock=lambda: now[0], sleep=wait)
    return spark.createDataFrame([(late, len(polls), behind["payments"])], "while_behind string, polls int, lag bigint")


sql("st14_catch_up_gate", "SELECT 'timeout' AS while_behind, 2 AS polls, 0 AS lag")


@own("st15_stream_reset")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, _table = _sent(spark, sf_dir, "orders")
    query = ingest.start(spark, spec)
    query.processAllAvailable()
    before = ingest.read_table(spark, spec).count()
    ingest.reset(spark, spec)
    files = Files(spark, spec.table)
    return spark.createDataFrame([(before, query.isActive, ingest.read_table(spark, spec).count(), files.exists(spec.checkpoint), len(files.listing(spec.table)))], "rows_before bigint, still_running boolean, rows_after bigint, checkpoint_left boolean, files_left int")


sql("st15_stream_reset", "SELECT (SELECT count(*) FROM b_stream_orders) AS rows_before, false AS still_running, 0 AS rows_after, false AS checkpoint_left, 0 AS files_left")


@own("st16_malformed_messages")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, _table = _sent(spark, sf_dir, "payments")
    spark.createDataFrame([("{not json",), ("[]",), ("",)], "value string").coalesce(1).write.mode("append").text(spec.source)
    query = ingest.start(spark, spec, once=True)
    query.awaitTermination()
    values = spark.read.schema("value string").text(spec.source)
    return spark.createDataFrame([(ingest.read_table(spark, spec).count(), ingest.rejected(query), ingest.malformed(values, "payments").count())], "rows bigint, rejected bigint, malformed bigint")


sql("st16_malformed_messages", "SELECT (SELECT count(*) FROM b_stream_payments) AS rows, 2 AS rejected, 2 AS malformed")


@own("m17_money_stream_summary")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = ingest.stream_specs(scratch(spark))
    names = ("orders", "order_items", "payments")
    for n in names:
        producer.send(driver_context(spark, sf_dir)(f"bronze.stream_{n}"), specs[n])
        ingest.ingest_available(spark, specs[n])
    rows = [(s["stream"], s.get("rows"), s.get("end"), s.get("state"), s.get("error")) for s in monitor.summary(spark, [specs[n] for n in names])]
    return spark.createDataFrame(rows, "stream string, rows bigint, end_offset bigint, state string, error string")


sql("m17_money_stream_summary", _union([f"'{n}' AS stream, (SELECT count(*) FROM b_stream_{n}) AS rows, (SELECT count(*) FROM b_stream_{n}) AS end_offset, 'not running' AS state, CAST(NULL AS VARCHAR) AS error" for n in ("orders", "order_items", "payments")]))

# --- generator: what holds of every table that it makes --------------------------------------
PARENTS = {"orders": (("customer_id", "customers"),), "order_items": (("order_id", "orders"), ("product_id", "products")), "payments": (("order_id", "orders"),), "refunds": (("order_id", "orders"),), "web_events": (("customer_id", "customers"),), "support_tickets": (("customer_id", "customers"),)}
#: What no row may be, by table.
NEVER = {
    "customers": "age < 18 or email not like '%@%'",
    "products": "unit_price <= 0",
    "orders": "total_amount < 0 or lower(trim(order_status)) not in ('completed', 'returned', 'cancelled')",
    "order_items": "quantity not between 1 and 5 or abs(line_total - quantity * unit_price) > 0.005",
    "payments": "amount < 0",
    "refunds": "refund_amount < 0",
    "web_events": "event_type is null",
    "support_tickets": "status is null",
}


def invariants(made: generator.Generator, name: str) -> DataFrame:
    """Rows, distinct keys, rows without parent, outside the period and that may not be, of one table."""
    df, c = made.table(name), made.c
    lost = [orphans(df, made.table(p), k, nullable=True).agg(F.count(F.lit(1)).alias("n")) for k, p in PARENTS.get(name, ())]
    date = F.col(DATES[name]) if name in DATES and name not in ("customers", "refunds") else F.lit(None).cast("date")
    out = df.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(KEYS[name]).alias("distinct_keys"), F.count_if(F.col(KEYS[name]).isNull()).alias("null_keys"),
        F.count_if((date < F.lit(c.start)) | (date > F.lit(c.end))).alias("outside_period"), F.count_if(F.expr(NEVER[name])).alias("impossible"),
    )
    n = F.lit(0).cast("long")
    for i, x in enumerate(lost):
        out = out.crossJoin(x.withColumnRenamed("n", f"lost{i}"))
        n = n + F.col(f"lost{i}")
    return out.withColumn("orphans", n).select("rows", "distinct_keys", "null_keys", "orphans", "outside_period", "impossible")


for _table in TABLES:
    QUERIES[f"gen_{_table}"] = lambda spark, sf_dir, t=_table: invariants(generator.Generator(spark, sized(spark, sf_dir)), t)
    if _table in SIZES:
        sql(f"gen_{_table}", f"SELECT {SIZES[_table]} AS rows, {SIZES[_table]} AS distinct_keys, 0 AS null_keys, 0 AS orphans, 0 AS outside_period, 0 AS impossible")
    elif _table == "payments":
        sql("gen_payments", f"SELECT {SIZES['orders']} AS rows, {SIZES['orders']} AS distinct_keys, 0 AS null_keys, 0 AS orphans, 0 AS outside_period, 0 AS impossible")


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the numbers of rows that depend on draws lie where their shares put them."""
    made = generator.Generator(spark, sized(spark, sf_dir))
    n = made.orders().count()
    items, refunds = made.order_items().count(), made.refunds().count()
    return spark.createDataFrame([("order_items", bool(1.6 * n <= items <= 2.2 * n)), ("refunds", bool(0.04 * n <= refunds <= 0.10 * n))], "table_name string, as_expected boolean")


QUERIES["gen_shares"] = _shares
sql("gen_shares", _union(["'order_items' AS table_name, true AS as_expected", "'refunds', true"]))


@own("st06_live_events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = driver_context(spark, sf_dir)
    known, customers = ctx("bronze.web_events"), ctx("bronze.customers")
    n = max(100, known.count() // 100)
    live = producer.live_events(spark, known, customers, n).cache()
    last = known.agg(F.max("event_date")).first()[0]
    out = [(live.count(), live.select("event_id").distinct().count(), live.join(known, "event_id", "left_semi").count(), orphans(live, customers, "customer_id", nullable=True).count(), live.filter(F.col("event_date") <= F.lit(last)).count(), bool(0.5 * n < live.filter("customer_id is not null").count() < 0.9 * n))]
    live.unpersist()
    return spark.createDataFrame(out, "rows bigint, distinct_keys bigint, known_already bigint, orphans bigint, not_after bigint, known_share boolean")


sql("st06_live_events", "SELECT (SELECT greatest(100, count(*) // 100) FROM b_web_events) AS rows, (SELECT greatest(100, count(*) // 100) FROM b_web_events) AS distinct_keys, 0 AS known_already, 0 AS orphans, 0 AS not_after, true AS known_share")


@own("st07_live_orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = driver_context(spark, sf_dir)
    made = generator.Generator(spark, sized(spark, sf_dir))
    known, customers, products = ctx("bronze.orders"), made.customers(), made.products()
    n = max(50, known.count() // 100)
    live = producer.live_orders(spark, made.orders(), made.order_items(), made.payments(), customers, products, n)
    o, i, p = (live[t].cache() for t in ("orders", "order_items", "payments"))
    per_order = i.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("line_total"), 2).alias("total"))
    wrong = o.join(per_order, "order_id", "left").join(p.select("order_id", "payment_status", "amount"), "order_id", "left")
    out = [(
        o.count(), p.count(), o.select("order_id").distinct().count(), orphans(o, customers, "customer_id").count() + orphans(i, o, "order_id").count() + orphans(i, products, "product_id").count() + orphans(p, o, "order_id").count(),
        wrong.filter("n is null or n not between 1 and 5 or abs(total - total_amount) > 0.005 or abs(amount - total_amount) > 0.005").count(),
        wrong.filter("(order_status = 'cancelled') <> (payment_status = 'failed') or order_status = 'returned'").count(),
    )]
    for x in (o, i, p):
        x.unpersist()
    return spark.createDataFrame(out, "orders bigint, payments bigint, distinct_orders bigint, orphans bigint, wrong_totals bigint, wrong_states bigint")


_LIVE = "(SELECT greatest(50, count(*) // 100) FROM b_orders)"
sql("st07_live_orders", f"SELECT {_LIVE} AS orders, {_LIVE} AS payments, {_LIVE} AS distinct_orders, 0 AS orphans, 0 AS wrong_totals, 0 AS wrong_states")

# --- verifiers ------------------------------------------------------------------------------
_VERDICT = "check_name string, passed boolean, detail string"
for _name, _verifier in (("v01_verify_silver", verify.silver), ("v04_verify_gold", verify.gold), ("v06_verify_bronze", verify.bronze), ("v07_verify_serving", verify.serving)):
    QUERIES[_name] = lambda spark, sf_dir, v=_verifier: spark.createDataFrame(v(driver_context(spark, sf_dir, materialise=True)), _VERDICT).select("check_name", "passed")


def _between(table: str, fact: str) -> str:
    key = "order_id" if table == "payments" else KEYS[table]
    n, both = f"(SELECT count(*) FROM s_{fact})", f"(SELECT count(*) FROM (SELECT {key} FROM b_{table} UNION SELECT {key} FROM b_stream_{table}))"
    return f"'silver.{fact} rows' AS check_name, (SELECT count(*) FROM s_{fact} WHERE {key} IN (SELECT {key} FROM b_{table})) <= {n} AND {n} <= {both} AS passed"


_MONEY = {"silver.fct_orders": ["total_amount"], "silver.fct_order_items": ["unit_price", "line_total"], "silver.fct_payments": ["amount"], "silver.fct_refunds": ["refund_amount", "order_total"], "silver.dim_products": ["unit_price"], "gold.customer_360": ["gross_revenue", "net_revenue", "aov"], "gold.revenue_by_channel": ["gross_revenue", "refunds", "net_revenue"], "gold.revenue_by_category": ["gross_revenue"], "gold.monthly_kpis": ["gross_revenue", "refunds", "net_revenue"]}


def _is_money(table: str) -> str:
    layer, _, short = table.partition(".")
    kinds = " AND ".join(f"coalesce((SELECT typeof({c}) LIKE 'DECIMAL%' FROM {_PLACE[layer]}_{short} LIMIT 1), true)" for c in _MONEY[table])
    return f"'{table} money types' AS check_name, {kinds} AS passed"


sql("v01_verify_silver", _union([*[_between(t, f) for t, f in (("orders", "fct_orders"), ("order_items", "fct_order_items"), ("payments", "fct_payments"), ("web_events", "fct_web_events"))], *[_is_money(t) for t in _MONEY if t.startswith("silver")],
    "'item revenue across layers' AS check_name, (SELECT sum(CAST(line_total AS DECIMAL(12,2))) FROM m_items WHERE order_id IN (SELECT order_id FROM m_orders) AND product_id IN (SELECT product_id FROM b_products WHERE unit_price > 0)) = (SELECT sum(line_total) FROM s_fct_order_items) AS passed"]))

QUERIES["v03_money_types"] = lambda spark, sf_dir: spark.createDataFrame([verify.money_types(driver_context(spark, sf_dir), t, x) for t, x in _MONEY.items()], _VERDICT).select("check_name", "passed")
sql("v03_money_types", _union([_is_money(t) for t in _MONEY]))

_FIGURES = {
    "customers": ("count(*) FROM g_customer_360", "count(*) FROM s_dim_customers"),
    "orders by channel": ("sum(orders) FROM g_revenue_by_channel", "count(*) FROM s_fct_orders"),
    "orders by month": ("sum(orders) FROM g_monthly_kpis", "count(*) FROM s_fct_orders"),
    "orders by customer": ("sum(total_orders) FROM g_customer_360", "count(*) FROM s_fct_orders WHERE customer_id IN (SELECT customer_id FROM s_dim_customers)"),
    **{f"{s} orders by month": (f"sum({s}_orders) FROM g_monthly_kpis", f"count(*) FROM s_fct_orders WHERE is_{s}") for s in ("completed", "returned", "cancelled")},
    "valid orders by channel": ("sum(valid_orders) FROM g_revenue_by_channel", "count(*) FROM s_fct_orders WHERE NOT is_cancelled"),
    "gross by channel": ("sum(gross_revenue) FROM g_revenue_by_channel", "sum(total_amount) FROM s_fct_orders WHERE NOT is_cancelled"),
    "gross by month": ("sum(gross_revenue) FROM g_monthly_kpis", "sum(total_amount) FROM s_fct_orders WHERE NOT is_cancelled"),
    "gross by customer": ("sum(gross_revenue) FROM g_customer_360", "sum(total_amount) FROM s_fct_orders WHERE NOT is_cancelled"),
    "gross by category": ("sum(gross_revenue) FROM g_revenue_by_category", "sum(line_total) FROM s_fct_order_items WHERE order_id IN (SELECT order_id FROM s_fct_orders WHERE NOT is_cancelled)"),
    "refunds by customer": ("sum(total_refunded) FROM g_customer_360", "sum(refund_amount) FROM s_fct_refunds"),
    "net is gross less refunds": ("sum(net_revenue) FROM g_customer_360", "sum(gross_revenue - total_refunded) FROM g_customer_360"),
    "new customers": ("sum(new_customers) FROM g_monthly_kpis", "count(DISTINCT customer_id) FROM s_fct_orders"),
    "tickets": ("sum(total_tickets) FROM g_customer_360", "count(*) FROM s_fct_support_tickets WHERE customer_id IN (SELECT customer_id FROM s_dim_customers)"),
    "events": ("sum(total_web_events) FROM g_customer_360", "count(*) FROM s_fct_web_events WHERE customer_id IN (SELECT customer_id FROM s_dim_customers)"),
}
sql("v04_verify_gold", _union([*[f"'{n}' AS check_name, coalesce((SELECT {a}), 0) = coalesce((SELECT {b}), 0) AS passed" for n, (a, b) in _FIGURES.items()],
    "'five views of revenue' AS check_name, (SELECT sum(gross_revenue) FROM g_customer_360) = (SELECT sum(gross_revenue) FROM g_revenue_by_channel) AND (SELECT sum(gross_revenue) FROM g_monthly_kpis) = (SELECT sum(total_amount) FROM s_fct_orders WHERE NOT is_cancelled) AS passed", _is_money("gold.customer_360")]))
QUERIES["v04_gold_figures"] = lambda spark, sf_dir: verify.gold_figures(driver_context(spark, sf_dir, materialise=True))
sql("v04_gold_figures", _union([f"'{n}' AS figure, CAST(coalesce((SELECT {a}), 0) AS DECIMAL(24,2)) AS a, CAST(coalesce((SELECT {b}), 0) AS DECIMAL(24,2)) AS b" for n, (a, b) in _FIGURES.items()]))
sql("v06_verify_bronze", _union([*[f"'bronze.{t} rows' AS check_name, (SELECT count(*) FROM b_{t}) > 0 AS passed" for t in TABLES], "'top customers' AS check_name, (SELECT count(DISTINCT customer_id) FROM b_orders) >= 5 AS passed"]))
_OF_MART = {n[4:]: MART_SQL[n].format(cust="true", rev="true", months="true") for n in MART_SQL}
_CUSTOMERS = f"(SELECT value FROM ({_OF_MART['kpi_customers']}))"
sql("v07_verify_serving", _union([*[f"'mart {m}' AS check_name, (SELECT count(*) FROM ({_OF_MART[m]})) > 0 AS passed" for m in marts.MARTS], *[f"'customers over {what}', (SELECT sum(customers) FROM ({_OF_MART[m]})) = {_CUSTOMERS}" for what, m in (("buckets", "ltv_distribution"), ("risks", "churn_risk_mix"))], f"'revenue over months', (SELECT sum(gross_revenue) FROM ({_OF_MART['revenue_trend']})) = (SELECT value FROM ({_OF_MART['kpi_gmv']}))"]))


@own("v05_topic_equals_table")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for n in STREAMS:
        spec, table = _sent(spark, sf_dir, n)
        values = spark.read.schema("value string").text(spec.source)
        out.append((n, verify.same_rows(ingest.parsed(values, n), table), values.count()))
    return spark.createDataFrame(out, "stream string, same boolean, messages bigint")


sql("v05_topic_equals_table", _union([f"'{n}' AS stream, true AS same, (SELECT count(*) FROM b_stream_{n}) AS messages" for n in STREAMS]))

# --- all checks ------------------------------------------------------------------------------
QUERIES["dq_report"] = lambda spark, sf_dir: check_report(driver_context(spark, sf_dir, materialise=True)).drop("detail")
#: Manifests with a row too many, and streams with a message more than the tolerance: these checks fail.
QUERIES["dq_report_behind"] = lambda spark, sf_dir: check_report(driver_context(spark, sf_dir, materialise=True), 1, quality.LAG_TOLERANCE + 1, ("manifest", "kafka_lag")).drop("detail")

_ORDERS = "(SELECT o_orderkey AS k FROM orders WHERE o_custkey % 25 <> 0)"
_ITEMS = "(SELECT l_orderkey AS k FROM lineitem WHERE l_orderkey % 25 <> 7 AND l_partkey IN (SELECT p_partkey FROM part))"
#: Rows that each raw table should have, counted from the tables that it is made of.
_EXPECTED = {
    "customers": "SELECT count(*) FROM customer", "products": "SELECT count(*) FROM part", "orders": f"SELECT count(*) FROM {_ORDERS}", "order_items": f"SELECT count(*) FROM {_ITEMS}", "payments": f"SELECT count(*) FROM {_ORDERS}",
    "refunds": f"SELECT count(*) FROM {_ORDERS} WHERE k % 100 BETWEEN 84 AND 90", "web_events": "SELECT count(*) FROM events", "support_tickets": "SELECT count(*) FROM events WHERE event_type = 'error'",
} | {f"stream_{t}": f"SELECT count_if(k % 3 = 0) + count_if(k % 40 = 0) FROM {rows}" for t, rows in (("orders", _ORDERS), ("order_items", _ITEMS), ("payments", _ORDERS), ("web_events", "(SELECT event_id AS k FROM events)"))}


def _passes(spec: quality.CheckSpec, values: dict[str, str], missing: int = 0, behind: int = 0) -> str:
    """A condition on a check's probe, in SQL; the period is that of the batch orders, and expected rows are counted from the source tables."""
    start, end = "(SELECT min(order_date) FROM b_orders)", "(SELECT max(order_date) FROM b_orders)"
    v = {m: f"({x})" for m, x in values.items()}
    if spec.condition == "range_cover":
        low, high = v["mn"], v["mx"]
        known = f"{low} IS NOT NULL AND {high} IS NOT NULL"
        kind = spec.params["kind"]
        if kind == "fresh":
            return f"coalesce({known} AND {high} >= {end} - {quality.FRESH_DAYS}, false)"
        return f"coalesce({known} AND {low} {'<=' if kind == 'full' else '>='} {start} AND {high} >= {end}, false)"
    if spec.condition == "gmv_spread":
        each = ", ".join(v.values())
        return f"coalesce(CAST(greatest({each}) - least({each}) AS DOUBLE) < {quality.SPREAD}, false)"
    if spec.condition == "z_lt_3":
        return f"coalesce({v['z'].replace('DATE ' + repr('2024-12-31'), end)} < {quality.Z_LIMIT}, true)"
    if spec.condition == "max_month":
        return f"coalesce({v['mx']} >= date_trunc('month', {end}), false)"
    (one,) = v.values()
    expected = f"({_EXPECTED.get(spec.table, 'SELECT NULL')})"
    return {"zero": f"{one} = 0", "positive": f"{one} > 0", "manifest": f"{one} = {expected} + {missing}", "kafka_lag": f"abs({expected} + {behind} - {one}) <= {quality.LAG_TOLERANCE}", "info": "true", "boolean_true": f"coalesce({one}, false)"}[spec.condition]


def _report_sql(missing: int = 0, behind: int = 0, only: tuple[str, ...] = ()) -> str:
    probes: dict[str, dict[str, str]] = {}
    for rows in _DQ.values():
        for key, measure, text in rows:
            probes.setdefault(key, {})[measure] = text
    return _union([f"'{s.family}' AS family, '{s.key}' AS check_key, '{s.condition}' AS condition, {s.blocking} AS blocking, {_passes(s, probes[s.key], missing, behind)} AS passed" for s in quality.build_checks() if not only or s.condition in only])


sql("dq_report", _report_sql())
sql("dq_report_behind", _report_sql(1, quality.LAG_TOLERANCE + 1, ("manifest", "kafka_lag")))
