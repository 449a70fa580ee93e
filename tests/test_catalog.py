"""Registered queries against their SQL on the smallest tables."""

import datetime as dt
import decimal
import os

import duckdb
import pytest

import __spark_entry__
from tidemill.plans import catalog, catalog_fresh, catalog_more, catalog_ops  # noqa: F401

INPUTS = "region nation customer supplier part orders lineitem events".split()
FRESH = ["u04_incremental_orders", "u04_incremental_order_items", "u04_refresh_report", "w03_tile_ends", "st04_replayed_batch", "st12_recorded_states", "dq02_bitmap_keys", "dq05_bitmap_parents", "dq04_footer_ranges", "dq_report_behind", "v07_verify_serving", "rollup_m05_ltv_distribution", "rollup_m04_kpi_aov_filtered", "s09_salted_tickets", "j03_salted_hot_key", "pf08_gram_search_short"]
CHOSEN = FRESH + ["s04_fct_orders", "s05_fct_order_items", "g01_customer_360", "g02_revenue_by_channel", "g03_revenue_by_category", "g04_monthly_kpis", "m11_customer_sample_filtered", "m13_filter_options", "s10_pre_stats", "s10_post_stats", "dq16_stream_fk", "dq23_revenue_invariant", "j07_not_exists_or", "a14_stddev", "f18_row_digest", "s04_raw_item_union", "io08_catalog", "io11_register_stream", "io17_result_cache", "st05_replay", "st08_interleaved", "v04_gold_figures", "dq_report"]


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return v.normalize()
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in INPUTS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    df = catalog.QUERIES[name](spark, sf)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*sorted(df.columns)).collect())
    cur = con.execute(catalog.ORACLE[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(x) for x in sorted(names)]
    assert got == sorted(repr([plain(r[i]) for i in order]) for r in cur.fetchall())


def test_entry(spark, sf):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_report(spark, sf):
    report = catalog.QUERIES["v04_verify_gold"](spark, sf)
    assert report.filter("not passed").count() == 0


def test_filters_reach_the_scan(spark, sf):
    plan = spark.read.parquet(f"{sf}/orders.parquet").filter("o_custkey = 5").select("o_orderkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,5)]" in plan
