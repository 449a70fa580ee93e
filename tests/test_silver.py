from decimal import Decimal

from shop import customer, d, order, rows, shop

from tidemill.plans import silver


def test_one_customer_for_each_email(spark):
    ctx = shop(spark, customers=[customer(1, " A@X ", "2024-02-01"), customer(2, "a@x"), customer(3, "a@x")])
    assert rows(silver.dim_customers(ctx), "customer_id", "email", "first_name", "marketing_channel") == [("C2", "a@x", "Ann", "email")]


def test_only_positive_prices(spark):
    ctx = shop(spark, products=[("P1", "a", "c", "b", 0.0), ("P2", "a", "c", "b", -1.0), ("P3", "a", "c", "b", None), ("P4", " a ", "c", "b", 9.99)])
    assert rows(silver.dim_products(ctx), "product_id", "product_name", "unit_price") == [("P4", "a", Decimal("9.99"))]


def test_calendar(spark):
    ctx = shop(spark, orders=[order(1, 1, "2024-02-28"), order(2, 1, "2024-03-01")])
    got = rows(silver.dim_order_dates(ctx), "order_date", "day_of_week", "day_of_week_name", "is_holiday_season")
    assert len(got) == 3 and (d("2024-02-29"), 4, "Thursday", False) in got


def test_calendar_without_orders(spark):
    assert silver.dim_order_dates(shop(spark)).count() == 0


ITEMS = [("OI-1", "ORD-0000001", "P1", 2, 5.0, 10.0), ("OI-2", "ORD-0000001", "P2", 1, 1.0, 1.5)]
PAYMENTS = [("PAY-1", "ORD-0000001", "card", "succeeded", d("2024-01-10"), 10.0)]
PRODUCTS = [("P1", "a", "c", "b", 5.0), ("P2", "a", "c", "b", 1.0)]


def test_replay_changes_nothing(spark):
    base = {"customers": [customer(1)], "products": PRODUCTS, "orders": [order(1, 1)], "order_items": ITEMS, "payments": PAYMENTS}
    again = base | {"stream_orders": base["orders"], "stream_order_items": ITEMS, "stream_payments": PAYMENTS}
    for make in (silver.fct_orders, silver.fct_order_items, silver.fct_payments):
        assert rows(make(shop(spark, **base)), "*") == rows(make(shop(spark, **again)), "*")
    assert rows(silver.fct_orders(shop(spark, **again), raw_item_union=True), "item_count", "distinct_product_count") == [(4, 2)]


def test_batch_wins_and_stream_extends(spark):
    ctx = shop(spark, customers=[customer(1)], orders=[order(1, 1)], stream_orders=[order(1, 1, status="cancelled"), order(2, 1, status=" Cancelled")])
    assert rows(silver.fct_orders(ctx), "order_id", "order_status") == [("ORD-0000001", "completed"), ("ORD-0000002", "cancelled")]


def test_unknown_customer_and_missing_payment(spark):
    ctx = shop(spark, customers=[customer(1)], orders=[order(1, 1), order(2, 9)])
    assert rows(silver.fct_orders(ctx), "order_id", "has_payment", "is_payment_succeeded", "payment_status_conflict", "item_count") == [("ORD-0000001", False, None, None, 0)]


def test_payment_conflicts(spark):
    pay = lambda i, s: (f"PAY-{i}", f"ORD-{i:07d}", "card", s, d("2024-01-10"), 10.0)
    ctx = shop(spark, customers=[customer(1)], orders=[order(1, 1, status="cancelled"), order(2, 1), order(3, 1, status="cancelled")], payments=[pay(1, "succeeded"), pay(2, "failed"), pay(3, "failed")])
    assert [r[1] for r in rows(silver.fct_orders(ctx), "order_id", "payment_status_conflict")] == [True, True, False]


def test_two_payments_of_one_order(spark):
    ctx = shop(spark, orders=[order(1, 1)], payments=[("PAY-2", "ORD-0000001", "card", "failed", d("2024-01-10"), 9.0)], stream_payments=[("PAY-1", "ORD-0000001", "card", "pending", d("2024-01-10"), 10.0)])
    assert rows(silver.fct_payments(ctx), "payment_id", "is_failed", "amount_mismatch") == [("PAY-2", True, True)]


def test_items_need_order_and_product(spark):
    ctx = shop(spark, products=PRODUCTS[:1], orders=[order(1, 1)], order_items=[*ITEMS, ("OI-3", "ORD-0000009", "P1", 1, 5.0, 5.0)])
    assert rows(silver.fct_order_items(ctx), "order_item_id", "line_total_mismatch") == [("OI-1", False)]


def test_refunds(spark):
    refund = lambda i, x: (f"REF-{i}", "ORD-0000001", "C1", d("2024-01-20"), x, " Damaged ")
    ctx = shop(spark, orders=[order(1, 1, total=100.0)], refunds=[refund(1, 100.0), refund(2, 99.99)])
    assert rows(silver.fct_refunds(ctx), "refund_id", "is_full_refund", "refund_lag_days", "refund_reason") == [("REF-1", True, 10, "damaged"), ("REF-2", False, 10, "damaged")]


def test_ticket_links(spark):
    ticket = lambda i, c, o: (f"T{i}", c, o, "Shipping", "low", d("2024-01-11"), "open")
    ctx = shop(spark, orders=[order(1, 1)], support_tickets=[ticket(1, "C1", "ORD-0000001"), ticket(2, "C2", "ORD-0000001"), ticket(3, "C1", None)])
    assert rows(silver.fct_support_tickets(ctx), "ticket_id", "has_linked_order", "linked_order_valid") == [("T1", True, True), ("T2", True, False), ("T3", False, False)]


def test_anonymous_events(spark):
    ctx = shop(spark, web_events=[("E1", None, " Add_To_Cart", " x ", "Mobile", d("2024-01-01"))], stream_web_events=[("E1", "C1", "search", "y", "pos", d("2024-01-02"))])
    assert rows(silver.fct_web_events(ctx), "*") == [("E1", None, "add_to_cart", "x", "mobile", d("2024-01-01"), True)]
