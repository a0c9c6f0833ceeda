"""Values that several documents share, found without bringing documents
together.

Documents are dealt over buckets.  Each bucket reports every distinct value
it holds once (with a mark if two of its documents hold it), so a value in a
third of all documents costs one entry per bucket, not one per document.
The values are dealt over shards by their top bits, a shard sorts what it
got, and every bucket hears which of its values are shared.  All exchanged
rows are packed arrays: one row per (bucket, shard).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, pack, split_by, squeeze, stretch_out, unboxed, unpack

REPORT = "shard int, bucket int, vals binary, multi binary"
SHARED = "bucket int, shard int, vals binary"
#: Bits of a value that are compared inside its shard.  Shards grow in number
#: with the data, so values that only seem shared stay as rare; they cost a
#: later comparison and nothing else.
BITS = 40


def reduced(vals: np.ndarray, shards: int) -> np.ndarray:
    """What is kept of 64-bit hashes: the shard and ``BITS`` more bits."""
    q = vals // np.uint64(shards)
    return (q & np.uint64((1 << BITS) - 1)) * np.uint64(shards) + (vals - q * np.uint64(shards))


def report_rows(bucket: int, vals: np.ndarray, multi: np.ndarray, shards: int) -> pa.Table:
    """Rows of one bucket: its sorted distinct reduced values by shard."""
    order, ends = split_by((vals % np.uint64(shards)).astype(np.int32), shards)
    vals, multi = vals[order] // np.uint64(shards), multi[order]
    at = [s for s in range(shards) if ends[s + 1] > ends[s]]
    return pa.table({
        "shard": pa.array(at, pa.int32()), "bucket": pa.array([bucket] * len(at), pa.int32()),
        "vals": pa.array([pack(vals[ends[s]:ends[s + 1]]) for s in at], pa.binary()),
        "multi": pa.array([squeeze(np.packbits(multi[ends[s]:ends[s + 1]]).tobytes()) for s in at], pa.binary())})


def distinct_with_multi(vals: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a bucket, and whether two of its documents hold
    each.  ``doc`` is the document's number in the bucket, rising."""
    order = np.argsort(vals, kind="stable")
    vals, doc = vals[order], doc[order]
    if len(vals) == 0:
        return vals, np.zeros(0, bool)
    first = np.r_[True, vals[1:] != vals[:-1]]
    starts = np.flatnonzero(first)
    last = np.r_[starts[1:], len(vals)] - 1
    return vals[starts], doc[starts] != doc[last]


def shared_in_shard(tab: pa.Table) -> pa.Table:
    """Per bucket, the values of this shard that at least two documents hold."""
    buckets = column(tab, "bucket").to_numpy()
    blobs = [unpack(b, np.uint64) for b in column(tab, "vals").to_pylist()]
    marks = [np.unpackbits(np.frombuffer(stretch_out(m), np.uint8), count=len(v)).astype(bool)
             for m, v in zip(column(tab, "multi").to_pylist(), blobs)]
    every = np.sort(np.concatenate(blobs))
    twice = every[1:][every[1:] == every[:-1]]
    known = np.unique(np.concatenate([twice, *[v[m] for v, m in zip(blobs, marks)]]))
    out_b, out_v = [], []
    for b, v in zip(buckets, blobs):
        at = np.searchsorted(known, v)
        at[at == len(known)] = 0
        hit = v[known[at] == v] if len(known) else v[:0]
        if len(hit):
            out_b.append(int(b))
            out_v.append(pack(hit))
    shard = [column(tab, "shard")[0].as_py()] * len(out_b)
    return pa.table({"bucket": pa.array(out_b, pa.int32()), "shard": pa.array(shard, pa.int32()),
                     "vals": pa.array(out_v, pa.binary())})


def shared_values(bucketed: DataFrame, values_of: Callable, shards: int) -> DataFrame:
    """``(bucket, shard, vals)`` rows.  ``values_of(documents)`` gives the
    64-bit hashes of a bucket's documents and the number of the document of
    each."""
    def report(tab: pa.Table) -> pa.Table:
        vals, doc = values_of(unboxed(tab))
        return report_rows(int(column(tab, "bucket")[0].as_py()),
                           *distinct_with_multi(reduced(vals, shards), doc), shards)

    return (bucketed.groupBy("bucket").applyInArrow(report, REPORT)
            .groupBy("shard").applyInArrow(shared_in_shard, SHARED))


def gathered(tab: pa.Table, shards: int) -> np.ndarray:
    """All shared values that a bucket heard of, reduced and sorted."""
    if tab.num_rows == 0:
        return np.zeros(0, np.uint64)
    return np.sort(np.concatenate([unpack(v, np.uint64) * np.uint64(shards) + np.uint64(s) for v, s in
                                   zip(column(tab, "vals").to_pylist(), column(tab, "shard").to_pylist())]))
