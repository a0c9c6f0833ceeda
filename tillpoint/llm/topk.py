"""Exact top-k search with block-at-a-time pruning (operator 1).

Vectors are integer term vectors: every signed component is a term, and the
score is the inner product.  The index keeps vectors in ranges of an order
that brings similar ones together; a range is a chunk, cut into blocks.  A
block holds its forward index (the vectors themselves) and, per term, the
largest and smallest component in the block.

A query visits the blocks of a chunk in the order of their summed term
maxima, an upper bound of every score inside.  It scores whole blocks until
the bound falls below its k-th best score.  It starts from a bound too: the
k-th best score within the query's own chunk, found while that was built.
Queries travel to the chunks in packed batches, vectors never travel again.

The order is fitted on ``PIVOTS`` sampled vectors; every vector is indexed
and nothing is approximate.

Defined results: vectors that are null or hold null or non-finite
components, and rows without an id, take no part; missing components of a
shorter vector count as 0; ties go to the smaller id; a query is never its
own neighbour; scores must fit into 64 bits; with fewer candidates than k, all are returned; of several
vectors under one id the smallest counts; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column

K = 5
SCALE = 256
QUERY_EVERY = 50
PIVOTS = 64
CHUNK = 8192
BLOCK = 128
QUERIES_AT_ONCE = 65_536
EXACT = float(1 << 53)
INDEX = ("part int, home long, dims int, ids binary, vecs binary, high binary, low binary, "
         "q_ids binary, q_vecs binary, q_least binary")


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)``: usable vectors as floor(scale * x), one per id."""
    x = F.col("embedding").cast("array<double>")
    usable = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    ints = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    return (embeddings.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v"))
            .groupBy("vec_id").agg(F.min("v").alias("v")))


def matrix(lists: pa.Array, dims: int = 0) -> np.ndarray:
    """Rows of integers, filled with zeros to the longest."""
    n = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    out = np.zeros((len(lists), max([dims, *n.tolist()])), np.int64)
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def widen(x: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, dims - x.shape[1]))) if x.shape[1] < dims else x


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integers: in doubles where every sum is below 2**53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.lexsort((ids, -scores))[:k]
    return scores[at], ids[at]


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<i8").tobytes()


def chunk_row(part: int, number: int, ids: np.ndarray, v: np.ndarray, k: int, every: int) -> tuple:
    cuts = np.arange(0, len(ids), BLOCK)
    high, low = np.maximum.reduceat(v, cuts), np.minimum.reduceat(v, cuts)
    asks = np.flatnonzero(ids % every == 0)
    least = np.full(len(asks), np.iinfo(np.int64).min)
    for a in range(0, len(asks), 256):
        some = asks[a:a + 256]
        scores = product(v[some], v)
        scores[np.arange(len(some)), some] = np.iinfo(np.int64).min
        if len(ids) > k:
            least[a:a + 256] = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
    return (part, (part << 20) + number, v.shape[1], packed(ids), packed(v), packed(high), packed(low),
            packed(ids[asks]), packed(v[asks]), packed(least))


def search_chunk(q_ids, q, least, ids, v, high, low, k: int):
    """Block-at-a-time search of a batch of queries in one chunk: yields
    (query position, scores, ids) of the best that may be among the k best."""
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    bounds = up @ high.T.astype(np.float64) + down @ low.T.astype(np.float64)
    slack = (up - down) @ np.maximum(np.abs(high), np.abs(low)).T.astype(np.float64)
    bounds += np.where(slack < EXACT, 0, slack * 1e-9)  # doubles are exact below 2**53; beyond it the bound is widened
    order = np.argsort(-bounds, axis=1, kind="stable")
    floor = least.copy()
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    alive = np.arange(len(q))
    for turn in range(order.shape[1]):
        block = order[alive, turn]
        open_ = bounds[alive, block] >= floor[alive]  # a tie may still win by its smaller id
        alive, block = alive[open_], block[open_]
        if not len(alive):
            break
        for b in np.unique(block):
            some = alive[block == b]
            rows = slice(b * BLOCK, (b + 1) * BLOCK)
            scores = product(q[some], v[rows])
            good = (scores >= floor[some][:, None]) & (ids[rows][None, :] != q_ids[some][:, None])
            for r in np.flatnonzero(good.any(axis=1)).tolist():
                at, s, i = some[r], scores[r][good[r]], ids[rows][good[r]]
                if at in found:
                    s, i = np.r_[found[at][0], s], np.r_[found[at][1], i]
                found[at] = s, i = best(s, i, k)
                if len(s) == k:
                    floor[at] = max(floor[at], s[-1])
    for at, (s, i) in found.items():
        yield at, s, i


def top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, chunk: int = CHUNK, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors(vec_id,
    v)`` whose id is divisible by ``every``, against all other rows."""
    vectors = vectors.checkpoint()
    total = vectors.count()
    # a bounded sample, to bring similar vectors together
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").toArrow()
    centers = matrix(column(sample, "v")).astype(np.float64)

    def cells(batches):
        for batch in batches:
            v = matrix(column(batch, "v"), centers.shape[1]).astype(np.float64)
            c = widen(centers, v.shape[1])
            near = np.argmax(v @ c.T - (c * c).sum(axis=1) / 2, axis=1) if len(c) else np.zeros(len(v), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), column(batch, "vec_id"), column(batch, "v")], ["cell", "vec_id", "v"])

    parts = max(1, -(-total // chunk))
    placed = (vectors.mapInArrow(cells, "cell int, vec_id long, v array<long>")
              .repartitionByRange(parts, "cell", "vec_id").sortWithinPartitions("cell", "vec_id"))

    def index(batches):
        part = TaskContext.get().partitionId() % parts
        number, have, rows = 0, [], 0

        def emit(tab: pa.Table):
            row = chunk_row(part, number, column(tab, "vec_id").to_numpy(), matrix(column(tab, "v")), k, every)
            kinds = [pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * 7
            names = [f.split()[0] for f in INDEX.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names)

        for batch in batches:
            while batch.num_rows:
                take = batch.slice(0, chunk - rows)
                have, rows, batch = [*have, take], rows + take.num_rows, batch.slice(chunk - rows)
                if rows == chunk:
                    yield emit(pa.Table.from_batches(have))
                    number, have, rows = number + 1, [], 0
        if rows:
            yield emit(pa.Table.from_batches(have))

    chunks = placed.mapInArrow(index, INDEX).checkpoint()
    groups = max(1, -(-total // every // QUERIES_AT_ONCE))

    def sequence(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asked = (chunks.where(F.length("q_ids") > 0)
             .select((F.col("home") % groups).cast("int").alias("batch"), "dims", "q_ids", "q_vecs", "q_least", sequence(parts).alias("part")))
    shards = chunks.select("part", "home", "dims", "ids", "vecs", "high", "low", sequence(groups).alias("batch"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]

        def ints(tab, name, r, dims=None):
            x = np.frombuffer(column(tab, name)[r].as_py(), "<i8")
            return x if dims is None else x.reshape(-1, dims) if dims else x.reshape(len(x), 0)

        for c in range(left.num_rows):
            d = column(left, "dims")[c].as_py()
            ids = ints(left, "ids", c)
            block = [ints(left, n, c).reshape(-1 if d else (len(ids) if n == "vecs" else -(-len(ids) // BLOCK)), d) for n in ("vecs", "high", "low")]
            for r in range(right.num_rows):
                e = column(right, "dims")[r].as_py()
                q_ids = ints(right, "q_ids", r)
                q = widen(ints(right, "q_vecs", r).reshape(len(q_ids), e), max(d, e))
                v, high, low = (widen(x, max(d, e)) for x in block)
                for at, s, i in search_chunk(q_ids, q, ints(right, "q_least", r), ids, v, high, low, k):
                    out[0].append(np.full(len(s), q_ids[at]))
                    out[1].append(i)
                    out[2].append(s)
        cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    hits = shards.groupBy("part", "batch").cogroup(asked.groupBy("part", "batch")).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (hits.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
