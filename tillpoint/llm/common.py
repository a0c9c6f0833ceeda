"""Helpers shared by the operators: reading tables, sizing exchanges, and
views of Arrow text columns as flat byte arrays."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these bytes: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BATCH_BYTES = 16 << 20
#: Stand-in for a null doc_id inside kernels: after every real id.
NULL_ID = np.iinfo(np.int64).max


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Batches that Spark hands to Python hold at most ``BATCH_BYTES``,
    however long the documents are (a single row may be longer)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the checkpoint folder, read back: cuts lineage as
    a checkpoint does, and the size that Spark plans with is that of the files.
    (A checkpoint keeps the estimate of its plan, and every join multiplies
    estimates, so in a loop of joins the number itself outgrows planning.)"""
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exchange_width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sizes them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucket_of(doc_id: Column, buckets: int) -> Column:
    """Bucket of a document, by its id; rows without one go by their text."""
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def in_buckets(docs: DataFrame, buckets: int, carry: list[str] | None = None) -> DataFrame:
    """``(bucket, box)``: whole documents dealt evenly over buckets by a hash
    of their id (see :func:`bucket_of`).  A box holds the ids and texts that one batch of
    rows has for one bucket, compressed, so a shuffle of the texts takes about
    half of what rows of strings take.  The columns of ``carry`` travel along
    as one struct, ``rest``, so their names are free; others are left out."""
    bounded_batches(docs.sparkSession)

    def boxes(batches):
        how = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            tab = pa.Table.from_batches([batch])
            bucket = column(tab, "bucket").to_numpy()
            order, ends = split_by(bucket, buckets)
            tab = tab.drop_columns(["bucket"]).take(pa.array(order))
            rows = [b for b in range(buckets) if ends[b + 1] > ends[b]]
            blobs = []
            for b in rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, tab.schema, options=how) as out:
                    out.write_table(tab.slice(ends[b], ends[b + 1] - ends[b]).combine_chunks())
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "box"])

    return docs.select(
        bucket_of(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), buckets).alias("bucket"),
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        *([F.struct(*carry).alias("rest")] if carry else []),
    ).mapInArrow(boxes, "bucket int, box binary")


def unboxed(tab: pa.Table) -> pa.Table:
    """Documents of a bucket, in a fixed order whatever order they came in."""
    tabs = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in column(tab, "box")]
    return pa.concat_tables(tabs).sort_by([("doc_id", "ascending"), ("text", "ascending")])


def column(tab: pa.Table, name: str) -> pa.Array:
    col = tab.column(name) if isinstance(tab, pa.Table) else tab[name]
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    return col


def int64s(tab, name: str, null: int = NULL_ID) -> np.ndarray:
    return column(tab, name).fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)


def flat_text(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; a null is empty."""
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int):
    """``(first, last)`` document ranges of about ``most`` bytes; a longer
    document is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers in place (two multiply-xorshift rounds)."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    if len(h) < width:
        return h[:0]
    m, have = h, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def run_starts(values: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Positions where a run of equal valid values begins."""
    first = valid.copy()
    first[1:] &= (values[1:] != values[:-1]) | ~valid[:-1]
    return np.flatnonzero(first)


def is_member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each ``x`` is among the sorted ``ordered``."""
    if len(ordered) == 0:
        return np.zeros(len(x), bool)
    at = np.searchsorted(ordered, x)
    at[at == len(ordered)] = 0
    return ordered[at] == x


def pack(arr: np.ndarray) -> bytes:
    """An array of 8-byte items, compressed byte plane by byte plane."""
    raw = np.ascontiguousarray(arr).reshape(-1).view(np.uint8).reshape(-1, 8)
    return squeeze(np.ascontiguousarray(raw.T).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(stretch_out(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(dtype)


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def stretch_out(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def split_by(shard: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that groups rows by shard (stable) and each shard's bounds."""
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(n + 1))
