"""
tables the jobs and checks in this package produce or read."""

from __future__ import annotations

from pyspark.sql import types as T

DDL = {
    "fact_sales": "invoice_no string, customer_sk bigint, product_sk bigint, quantity bigint, "
                  "unit_price decimal(10,2), line_total decimal(14,2), country string, "
                  "invoice_ts timestamp_ntz, sale_date date",
    "dim_customer": "customer_sk bigint, customer_id string, country string, first_seen_ts timestamp_ntz, "
                    "last_seen_ts timestamp_ntz",
    "dim_product": "product_sk bigint, stock_code string, description string, unit_price decimal(10,2)",
    "dim_store": "store_sk bigint, store_id string, store_name string, store_type string, region string, "
                 "city string, state string, country string, open_dt date, close_dt date, sq_ft bigint, "
                 "manager_employee_sk bigint, attributes map<string,string>",
    "dim_category": "category_sk bigint, category_id string, parent_id string, name string, depth bigint, "
                    "sort_order bigint",
    "fact_loyalty_events": "event_id bigint, member_id string, event_type string, points bigint, store_sk bigint, "
                           "tx_id string, event_ts timestamp_ntz, meta map<string,string>, event_date date",
    "fact_shipments": "shipment_id string, invoice_no string, customer_sk bigint, warehouse_sk bigint, "
                      "carrier string, tracking_no string, shipped_ts timestamp_ntz, delivered_ts timestamp_ntz, "
                      "sla_hours bigint, tracking_events array<struct<ts:timestamp_ntz,status:string,location:string>>, "
                      "ship_year bigint, ship_month bigint, ship_day bigint, carrier_partition string, "
                      "_partition_date date",
    "mobile_events": "event_id string, event_ts timestamp_ntz, user_id string, app_version string, "
                     "device_type string, platform string, properties map<string,string>, "
                     "context struct<ip:string,country:string,session_id:string,referrer:string>, "
                     "items array<struct<sku:string,qty:bigint,price:decimal(10,2)>>, event_date string, "
                     "hour_bucket bigint",
    "fraud_signals": "customer_id string, signal_type string, score double, risk_band string, "
                     "reason_codes array<string>, signal_ts timestamp, vendor string, signal_date string",
    "return_authorizations": "rma_id string, customer_id string, invoice_no string, stock_code string, "
                             "quantity bigint, reason_code string, reason_text string, requested_at timestamp_ntz, "
                             "approved boolean, refund_amount decimal(12,2), date_ts string",
    "omniture_logs": ", ".join(f"col_{i} string" for i in range(1, 61)) + ", date_ts string",
    "returns_ledger": "return_id bigint, invoice_no string, customer_sk bigint, return_ts timestamp_ntz, "
                      "refund_amount decimal(12,2), reason_code string, status string",
    "cleansed_orders": "order_id string, customer_id string, invoice_no string, txn_ts timestamp_ntz, "
                       "line_count bigint, gross_amount decimal(14,2), discount decimal(14,2), tax decimal(14,2), "
                       "net_amount decimal(14,2), tender_type string, source_feed string, order_date date",
    "sales_cube": "dim_level bigint, cube_key string, country string, month_key bigint, product_sk bigint, "
                  "orders bigint, revenue decimal(18,2), units bigint, as_of_date date",
}


def schema(name: str) -> T.StructType:
    return T.DataType.fromDDL(DDL[name])
