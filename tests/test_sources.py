"""Readers (R) and sinks (P) round-trip the driver's tables."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_SMALL, rows
from tillpoint.sources import readers as R
from tillpoint.sources import sinks as P
from tillpoint.sources import testdata as td


def _tmp():
    return tempfile.mkdtemp(prefix="tillpoint-test-")


CUST = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
                     T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType()),
                     T.StructField("c_mktsegment", T.StringType())])


def test_r1_tsv_keeps_empty_and_null_distinct(spark):
    src = spark.read.parquet(f"{SF_SMALL}/customer.parquet").withColumn(
        "c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).when(F.col("c_custkey") % 7 == 0, F.lit(""))
        .otherwise(F.col("c_mktsegment")))
    d = _tmp()
    line = F.concat_ws("\t", *[F.coalesce(F.col(f.name).cast("string"), F.lit("\\N")) for f in CUST.fields])
    src.select(line.alias("value")).write.mode("overwrite").text(d)
    back = R.read_delimited_text(spark, d, CUST)
    assert back.filter("_bad_fields > 0").count() == 0
    assert rows(back.drop("_bad_fields")) == rows(src)
    assert back.filter(F.col("c_mktsegment") == "").count() == src.filter(F.col("c_mktsegment") == "").count() > 0


def test_r1_bad_field_is_flagged_not_fatal(spark):
    d = _tmp()
    spark.createDataFrame([("1\tx\t3\t1.5\tA",), ("2\ty\tnot-int\t2.5\tB",)], "value string").write.mode("overwrite").text(d)
    back = R.read_delimited_text(spark, d, CUST).orderBy("c_custkey").collect()
    assert back[0]._bad_fields == 0 and back[1]._bad_fields == 1 and back[1].c_nationkey is None


def test_r2_csv_permissive(spark):
    src = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    d = _tmp()
    src.write.mode("overwrite").option("header", True).csv(d)
    with open(f"{d}/zz-bad.csv", "w") as fh:
        fh.write("c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment\n7,bad,not-a-number,1.0,X\n")
    got = R.read_csv(spark, d, CUST).collect()  # the corrupt column is read along with the others
    bad = [r for r in got if r._corrupt_record is not None]
    assert len(bad) == 1 and bad[0].c_name == "bad"
    good = sorted(tuple(r)[:-1] for r in got if r._corrupt_record is None)
    assert good == sorted(tuple(r) for r in src.collect())


def test_r2_empty_fields_are_empty_strings(spark):
    d = _tmp()
    schema = "id int, a string, b double, c string"
    with open(f"{d}/x.csv", "w") as fh:
        fh.write('id,a,b,c\n1,,,\n2,"","",""\n3,\\N,\\N,\\N\n4,x,1.5,"say \\"hi\\", you"\n5,short\n6,a,1,b,extra\n7,y,word,z\n')
    from pyspark.sql.types import _parse_datatype_string
    got = {r.id: r for r in R.read_csv(spark, d, _parse_datatype_string(schema)).collect()}
    assert [tuple(got[i])[1:] for i in (1, 2, 3, 4)] == [("", None, "", None), ("", None, "", None), (None, None, None, None), ("x", 1.5, 'say "hi", you', None)]
    assert got[5]._corrupt_record == "5,short" and (got[5].a, got[5].c) == ("short", None)
    assert got[6]._corrupt_record == "6,a,1,b,extra" and got[7]._corrupt_record == "7,y,word,z" and got[7].b is None


def test_r1_any_separator(spark):
    d = _tmp()
    spark.createDataFrame([("1.x^3",), ("2.y^4",)], "value string").write.mode("overwrite").text(d)
    from pyspark.sql.types import _parse_datatype_string
    assert rows(R.read_delimited_text(spark, d, _parse_datatype_string("a int, b string"), sep=".", flag_col=None)) == [(1, "x^3"), (2, "y^4")]
    assert rows(R.read_delimited_text(spark, d, _parse_datatype_string("a string, b int"), sep="^", flag_col=None)) == [("1.x", 3), ("2.y", 4)]


def test_r3_json_lines_with_schema(spark):
    src = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    d = _tmp()
    src.write.mode("overwrite").option("timestampNTZFormat", R.TS_MICROS).json(d)
    back = R.read_json_lines(spark, d, src.schema)
    assert rows(back.drop("_corrupt_record")) == rows(src)


def test_r4_regex_lines(spark):
    raw = td.loyalty_events_raw(spark, SF_SMALL)
    d = _tmp()
    raw.select(F.concat_ws("|", *raw.columns).alias("value")).write.mode("overwrite").text(d)
    back = R.read_regex_lines(spark, d)
    assert back.filter(~F.col("_matched")).count() == 0
    assert rows(back.drop("_matched")) == rows(raw)


def test_r6_r9_parquet_orc(spark):
    src = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    d1, d2 = _tmp(), _tmp()
    src.write.mode("overwrite").parquet(d1)
    src.write.mode("overwrite").orc(d2)
    assert rows(R.read_parquet(spark, d1, src.schema)) == rows(src)
    assert rows(R.read_orc(spark, d2, src.schema)) == rows(src)


def test_p1_dynamic_partition_overwrite_is_idempotent(spark):
    fs = td.fact_sales(spark, SF_SMALL).filter(F.col("sale_date") >= dt.date(2001, 7, 1))
    d = _tmp()
    P.write_partitioned(fs, d, ["sale_date"])
    before = spark.read.parquet(d).groupBy("sale_date").count()
    one_day = fs.filter(F.col("sale_date") == dt.date(2001, 7, 2))
    P.write_partitioned(one_day, d, ["sale_date"])
    P.write_partitioned(one_day, d, ["sale_date"])
    after = spark.read.parquet(d).groupBy("sale_date").count()
    assert rows(before) == rows(after)


def test_p2_p3_p5_partition_columns_and_typing(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 15, 12, 34, 56), 2024, 3, 15, "12", "x")],
                               "ts timestamp_ntz, y int, m int, d int, n string, bad string")
    out = (P.with_partition_column(df, "day", "ts", "day")
           .transform(lambda x: P.with_partition_column(x, "mon", "ts", "month"))
           .transform(lambda x: P.with_partition_column(x, "yr", "ts", "year"))
           .transform(lambda x: P.with_partition_column(x, "hr", "ts", "hour"))
           .transform(lambda x: P.with_partition_column(x, "ymd", "y,m,d", "ymd"))
           .transform(lambda x: P.with_ingest_date(x, dt.date(2024, 3, 16)))).collect()[0]
    assert (out.day, out.mon, out.yr, out.hr, out.ymd, out._ingest_date) == (
        dt.date(2024, 3, 15), dt.date(2024, 3, 1), dt.date(2024, 1, 1), "20240315_12", dt.date(2024, 3, 15),
        dt.date(2024, 3, 16))
    t = P.typed(df, T.StructType([T.StructField("n", T.LongType()), T.StructField("bad", T.LongType()),
                                  T.StructField("missing", T.DateType())])).collect()[0]
    assert (t.n, t.bad, t.missing) == (12, None, None)


def test_p4_clustered_and_snapshots(spark):
    fs = td.fact_sales(spark, SF_SMALL)
    c = P.clustered(fs, ["customer_sk"], 4)
    assert c.rdd.getNumPartitions() == 4
    root = _tmp()
    P.write_snapshot(fs.limit(10), root, 1)
    P.write_snapshot(fs.filter(F.col("quantity") > 25), root, 2)
    assert P.read_current(spark, root).count() == fs.filter(F.col("quantity") > 25).count()
