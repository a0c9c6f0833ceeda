"""Typed readers for the landing formats, all with explicit schemas
(never ``inferSchema``).

Each returns a DataFrame whose columns follow the declared StructType; a
value that does not fit its type becomes NULL through ``try_cast`` and the
row is flagged, so dirty raw data never fails a job under ANSI mode.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_TOKEN = "\\N"  # Hive's text NULL marker


def _typed(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.TimestampNTZType,)):
        return F.try_to_timestamp(c).cast("timestamp_ntz")
    if isinstance(dtype, T.BooleanType):
        low = F.lower(c)
        return F.when(low.isin("true", "1", "t", "y", "yes"), F.lit(True)).when(
            low.isin("false", "0", "f", "n", "no"), F.lit(False))
    return c.try_cast(dtype)


# R1 -------------------------------------------------------------------------
def read_delimited_text(spark: SparkSession, path: str, schema: T.StructType, sep: str = "\t",
                        null_token: str = NULL_TOKEN, flag_col: str | None = "_bad_fields") -> DataFrame:
    """Hive-style delimited text: split on ``sep`` keeping empty trailing
    fields, ``\\N`` -> NULL while ``''`` stays ``''``, then typed."""
    parts = F.split(F.col("value"), re.escape(sep), -1)  # literally, not as a pattern
    raw = [F.get(parts, i) for i in range(len(schema.fields))]
    raw = [F.when(c == F.lit(null_token), F.lit(None).cast("string")).otherwise(c) for c in raw]
    cols = [_typed(c, f.dataType).alias(f.name) for c, f in zip(raw, schema.fields)]
    df = spark.read.text(path).select(*cols, *[c.alias(f"__raw_{i}") for i, c in enumerate(raw)])
    if flag_col:
        bad = sum((F.when(F.col(f"__raw_{i}").isNotNull() & F.col(f.name).isNull(), 1).otherwise(0)
                   for i, f in enumerate(schema.fields)), F.lit(0))
        df = df.withColumn(flag_col, bad)
    return df.drop(*[f"__raw_{i}" for i in range(len(schema.fields))])


# R2 -------------------------------------------------------------------------
def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True,
             corrupt_col: str = "_corrupt_record") -> DataFrame:
    """CSV with a declared schema; lines with too few or too many fields, or
    with a value that does not fit its type, are kept with their text in
    ``corrupt_col`` instead of failing the job.  ``\\N`` is NULL; an empty
    field, quoted or not, is an empty string, and NULL in any other type."""
    strings = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields]
                           + [T.StructField(corrupt_col, T.StringType(), True)])
    # an unquoted empty field always reads as the reader's null, so that must be nothing else
    raw = (spark.read.schema(strings).option("header", header).option("mode", "PERMISSIVE").option("nullValue", "\u0001")
           .option("columnNameOfCorruptRecord", corrupt_col).option("enforceSchema", True).csv(path))
    whole = F.col(corrupt_col).isNull()
    cols, unfit = [], F.lit(False)
    for f in schema.fields:
        c = F.when(F.col(f.name) == NULL_TOKEN, F.lit(None).cast("string")).otherwise(F.when(whole, F.coalesce(F.col(f.name), F.lit(""))).otherwise(F.col(f.name)))
        value = _typed(c, f.dataType)
        if not isinstance(f.dataType, T.StringType):
            unfit = unfit | F.coalesce((c != "") & value.isNull(), F.lit(False))
        cols.append(value.alias(f.name))
    line = F.to_csv(F.struct(*[F.col(f.name) for f in schema.fields]))
    return raw.select(*cols, F.coalesce(F.col(corrupt_col), F.when(unfit, line)).alias(corrupt_col))


# R3 -------------------------------------------------------------------------
TS_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType,
                    corrupt_col: str = "_corrupt_record", timestamp_format: str = TS_MICROS) -> DataFrame:
    """NDJSON with a declared schema (microsecond timestamps by default)."""
    s = T.StructType([*schema.fields, T.StructField(corrupt_col, T.StringType(), True)])
    return (spark.read.schema(s).option("mode", "PERMISSIVE")
            .option("timestampNTZFormat", timestamp_format).option("timestampFormat", timestamp_format)
            .option("columnNameOfCorruptRecord", corrupt_col).json(path))


# R4 -------------------------------------------------------------------------
# Our line format for loyalty logs (the reference names a regex SerDe but
# not its pattern): eight '|'-separated fields, the last one free text.
LOYALTY_LINE = r"^([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$"
LOYALTY_FIELDS = ["event_ts_str", "member_id", "event_type", "points", "store_id", "tx_id", "meta_raw", "date_ts"]


def read_regex_lines(spark: SparkSession, path: str, pattern: str = LOYALTY_LINE,
                     fields: list[str] = LOYALTY_FIELDS) -> DataFrame:
    """Every group of ``pattern`` becomes a STRING column; lines that do not
    match get NULLs everywhere and ``_matched`` = false."""
    v = F.col("value")
    ok = v.rlike(pattern)
    cols = [F.when(ok, F.regexp_extract(v, pattern, i + 1)).alias(n) for i, n in enumerate(fields)]
    return spark.read.text(path).select(*cols, ok.alias("_matched"))


# R5 / R6 / R9 ---------------------------------------------------------------
def read_avro(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Avro needs the external spark-avro module on the classpath; without
    it this raises a clear error (tests use the same schema over Parquet)."""
    try:
        return spark.read.format("avro").schema(schema).load(path)
    except Exception as e:  # pragma: no cover - depends on the deployment
        raise RuntimeError("Avro source unavailable: add the spark-avro package") from e


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read
    return (r.schema(schema) if schema is not None else r).parquet(path)


def read_orc(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read
    return (r.schema(schema) if schema is not None else r).orc(path)


# R7 / R8 --------------------------------------------------------------------
def hive_table_ddl(table: str, schema: T.StructType, stored_as: str, location: str) -> str:
    """DDL for RCFile / SequenceFile landings, read through Spark's Hive
    support (``enableHiveSupport()`` sessions only)."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    if stored_as.upper() not in ("RCFILE", "SEQUENCEFILE", "ORC", "PARQUET", "TEXTFILE"):
        raise ValueError(stored_as)
    return f"CREATE EXTERNAL TABLE IF NOT EXISTS {table} ({cols}) STORED AS {stored_as.upper()} LOCATION '{location}'"


def read_hive_format(spark: SparkSession, table: str, schema: T.StructType, stored_as: str,
                     location: str) -> DataFrame:
    spark.sql(hive_table_ddl(table, schema, stored_as, location))
    return spark.table(table)
