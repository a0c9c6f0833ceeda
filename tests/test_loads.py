"""Data-driven loads: deliveries keep keys, facts keep unknown keys and rows."""

import datetime as dt
import decimal

from conftest import rows
from tillpoint.plans import facts as fx
from tillpoint.plans import loads as ld

SPEC = ld.Dimension("code", "sk", {"name": "string", "n": "bigint"}, None)


def feed(spark, data):
    return spark.createDataFrame(data, "delivery int, code string, name string, n string")


def test_deliveries_keep_keys_and_overwrite(spark):
    got = ld.load_dimension(SPEC, feed(spark, [
        (0, "b", "B", "1"), (0, "d", "D", None), (0, None, "none", "5"),
        (1, "b", None, "2"), (1, "a", "A", "3"), (1, "c", "C", "x9"[1:]), (1, None, "none", "6")]))
    assert rows(got, "code", "sk", "name", "n") == sorted(
        [("a", 3, "A", 3), ("b", 1, None, 2), ("c", 4, "C", 9), ("d", 2, "D", None)])
    assert ld.load_dimension(SPEC, feed(spark, [])).count() == 0


def test_payments_leave_void_ones_out_and_keep_unknown_keys(spark):
    at = dt.datetime(2024, 3, 5)
    d = decimal.Decimal
    pos = spark.createDataFrame(
        [(1, "c1", "i1", at, d("100.00"), d("5.00"), d("8.00"), "CARD", None), (2, None, "i2", at, d("1.00"), d("0.00"), d("0.00"), "COIN", False),
         (3, "c9", "i3", at, d("1.00"), d("0.00"), d("0.00"), "CASH", True)],
        "txn_id long, customer_id string, invoice_no string, txn_ts timestamp_ntz, gross_amount decimal(14,2), discount_amount decimal(14,2), "
        "tax_amount decimal(14,2), tender_type string, void_flag boolean")
    customers = spark.createDataFrame([("c1", 11)], "customer_id string, customer_sk long")
    methods = spark.createDataFrame([("CARD", 7, d("0.0150"), d("0.10"))], "method_code string, payment_method_sk long, fee_pct decimal(5,4), fee_flat decimal(8,2)")
    got = ld.fact_payments(pos, customers, methods)
    assert rows(got, "payment_id", "customer_sk", "payment_method_sk", "amount", "fee_amount") == [
        (1, 11, 7, d("103.00"), d("1.65")), (2, None, None, d("1.00"), None)]


def test_invoice_lines_have_no_slots(spark):
    big = 1_000_000
    inv = spark.createDataFrame(
        [(f"7-{big}", f"SUP{big}", [(f"s{k}", 1, decimal.Decimal("1.0000")) for k in range(150)], "USD", dt.date(2024, 1, 2)),
         ("7-3", "SUP3", [("x", 2, decimal.Decimal("2.5000"))], "EUR", dt.date(2024, 1, 2))],
        "invoice_no string, supplier_id string, line_items array<struct<sku:string,qty:long,unit_price:decimal(12,4)>>, currency string, invoice_date date")
    got = fx.fact_supplier_invoice_lines(inv, first_id=10).orderBy("invoice_line_id").collect()
    assert [r.invoice_line_id for r in got] == list(range(10, 161))
    assert (got[0].invoice_no, got[1].supplier_sk, got[150].line_position) == ("7-3", big, 149)


def test_repeated_clicks_count_once(spark):
    at = dt.datetime(2024, 1, 1, 10)
    c = [("s", "CMP1", "5", at, "u")] * 3 + [("s", "CMP1", "5", at + dt.timedelta(hours=1), "w")]
    got = fx.fact_email_engagement(spark.createDataFrame(c, "send_id string, campaign_id string, recipient string, clicked_at timestamp_ntz, click_url string")).first()
    assert [x.url for x in got.clicks] == ["u", "w"] and got.link_url == "u"
