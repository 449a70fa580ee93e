import pytest
from shop import d, order, rows, shop

from tidemill.plans import silver
from tidemill.plans.verify import same_rows
from tidemill.sources import generator
from tidemill.streaming import ingest, monitor, producer

EVENTS = [("EVT-00000001", None, "page_view", "x", "mobile", d("2024-03-01")), ("EVT-00000002", "C1", "search", "y", "tablet", d("2024-03-02"))]


def test_append_resume_and_lag(spark, tmp_path):
    spec = ingest.stream_specs(f"file://{tmp_path}")["web_events"]
    table = shop(spark, web_events=EVENTS)("bronze.web_events")
    assert monitor.lag(spark, spec) is None
    producer.ensure_topic(spark, spec)
    with pytest.raises(monitor.StreamMissing):
        monitor.observe(spark, spec)
    producer.send(table, spec)
    assert monitor.lag(spark, spec) == 2
    assert ingest.ingest_available(spark, spec) == 2
    assert same_rows(ingest.read_table(spark, spec), table)
    assert ingest.ingest_available(spark, spec) == 0 and ingest.read_table(spark, spec).count() == 2
    producer.send(table.limit(1), spec)
    assert ingest.ingest_available(spark, spec) == 1
    assert monitor.observe(spark, spec).first()["distinct_keys"] == 2 and monitor.caught_up(spark, spec)
    ctx = shop(spark, web_events=EVENTS[:1])
    ctx.tables["bronze.stream_web_events"] = ingest.read_table(spark, spec)
    assert [r[0] for r in rows(silver.fct_web_events(ctx), "event_id")] == ["EVT-00000001", "EVT-00000002"]
    ingest.reset(spark, spec)
    assert ingest.read_table(spark, spec).count() == 0
    assert monitor.state(spark, spec)["state"] == "not running"


def test_messages_keep_nulls(spark):
    table = shop(spark, web_events=EVENTS)("bronze.web_events")
    values = producer.to_messages(table)
    assert '"customer_id":null' in values.first()[0] and '"event_date":"2024-03-01"' in values.first()[0]
    assert same_rows(ingest.parsed(values, "web_events"), table)


def test_replay_once(spark, tmp_path):
    specs = ingest.stream_specs(f"file://{tmp_path}")
    tables = {"orders": shop(spark, orders=[order(1, 1), order(2, 1)])("bronze.orders")}
    assert producer.replay(spark, tables, specs) == {"orders": 2}
    assert producer.replay(spark, tables, specs, if_empty=True) == {"orders": 0}
    assert producer.replay(spark, tables, specs, reset_topics=True) == {"orders": 2} and producer.end_offset(spark, specs["orders"]) == 2


def test_live_tail(spark):
    g = generator.Generator(spark, generator.Config(customers=20, products=10, orders=50, web_events=50))
    live = producer.live_orders(spark, g.orders(), g.order_items(), g.payments(), g.customers(), g.products(), 30)
    o, i, p = (live[t].cache() for t in ("orders", "order_items", "payments"))
    assert o.count() == p.count() == 30 and o.join(g.orders(), "order_id").count() == 0
    assert o.filter("order_status = 'returned'").count() == 0 and o.filter("order_date <= '2024-12-01'").count() == 0
    assert o.join(p, "order_id").filter("(order_status = 'cancelled') <> (payment_status = 'failed')").count() == 0
    assert {r["n"] for r in i.groupBy("order_id").count().withColumnRenamed("count", "n").collect()} <= {1, 2, 3, 4, 5}
    assert i.select("order_item_id").distinct().count() == i.count()
    events = producer.live_events(spark, g.web_events(), g.customers(), 40)
    assert events.select("event_id").distinct().count() == 40 and events.join(g.web_events(), "event_id").count() == 0


def test_rate():
    assert monitor.event_rate([(0, 0)], 1) is None and monitor.event_rate([(0, 0), (4, 9)], 4) is None
    assert monitor.event_rate([(0, 0), (100, 50), (160, 150)], 200) == 100.0


def test_summary_reports_errors(spark, tmp_path):
    specs = ingest.stream_specs(f"file://{tmp_path}")

    def count(spec):
        if spec.name == "orders":
            raise RuntimeError("away")
        return 5

    got = monitor.summary(spark, [specs["orders"], specs["payments"]], count)
    assert got[0] == {"stream": "orders", "error": "away"} and got[1]["rows"] == 5


