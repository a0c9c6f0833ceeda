"""Best-fit packing after dominance reduction (operator 2).

Documents become token pieces of at most ``capacity``; pieces become
sequences.  Only the number of pieces of each length matters for how many
sequences are needed, and there are at most ``capacity`` lengths, however
many documents there are.  So the packing is planned on that histogram, and
the plan is then dealt out to the pieces by Spark:

1. *Reduction* (Martello and Toth): for each length, sets of at most three
   lengths that provably dominate every other set holding it are fixed for
   good, as many as the counts allow, and leave the instance.
2. *Best fit* over what remains, longest first: each piece goes to the
   fullest sequence that takes it.  Sequences of one history are one entry.
3. *Dealing*: the pieces of a length are numbered without a global sort, by
   counts per (length, bucket) and positions inside; a piece's number finds
   its sequence and offset in the plan.

Defined results: a null or empty text is the end id alone; ties and repeated
rows are pieces like any other; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, column

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
               with_ids: bool = False) -> DataFrame:
    """Token pieces of all documents; only documents longer than ``capacity``
    are cut.  ``with_ids`` adds the ids themselves."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        from .tokens import encoder
        coder = encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = column(batch, "doc_id").to_pylist()
            rows = [[], [], [], [], [], []]
            for doc, own in zip(ids, coder.ids(column(batch, "text"))):
                raw = own.tobytes() + end
                for k, a in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[a:a + 4 * capacity]
                    for r, v in zip(rows, (doc, k, a // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)):
                        r.append(v)
            cols = [pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array([np.frombuffer(x, "<i4") for x in rows[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, PIECES + ", ids array<int>" * with_ids))


def reduce_instance(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets; ``count`` (pieces per length) keeps the rest.
    Returns ``(lengths, how many such sequences)``."""
    fixed: list[tuple[tuple[int, ...], int]] = []
    lengths = sorted(x for x in count if count[x] > 0)

    def take(items: tuple[int, ...]) -> None:
        most = min(count[x] // items.count(x) for x in set(items))
        fixed.append((items, most))
        for x in set(items):
            count[x] -= most * items.count(x)
            if count[x] == 0:
                del count[x]
                lengths.pop(bisect.bisect_left(lengths, x))

    def smallest(j: int, n: int) -> list[int]:
        """The n smallest pieces besides one of length j."""
        out: list[int] = []
        for x in lengths[:n + 1]:
            out += [x] * min(n - len(out), count[x] - (x == j))
            if len(out) == n:
                break
        return out

    def largest(limit: int, without: tuple[int, ...]) -> int:
        """The longest piece of at most ``limit`` besides those given, or 0."""
        at = bisect.bisect_right(lengths, limit) - 1
        while at >= 0 and count[lengths[at]] <= without.count(lengths[at]):
            at -= 1
        return lengths[at] if at >= 0 else 0

    def best_pair(j: int, limit: int) -> tuple[int, int]:
        """The pair (a >= b) with the largest sum up to ``limit``, a as long as can be."""
        best = (0, 0)
        for a in reversed(lengths[:bisect.bisect_right(lengths, limit)]):
            if count[a] > (a == j):
                b = largest(min(limit - a, a), (j, a))
                if b and a + b > sum(best):
                    best = (a, b)
                if sum(best) == limit or 2 * a <= sum(best):
                    break
        return best

    for j in reversed(list(lengths)):
        while count.get(j, 0):
            room = capacity - j
            small = smallest(j, 3)
            if not small or small[0] > room:
                take((j,))
                continue
            k = largest(room, (j,))
            if k == room or len(small) < 2 or sum(small[:2]) > room:
                take((j, k))  # fills the sequence, or nothing else fits beside it
                continue
            if len(small) == 3 and sum(small) <= room:
                break  # three more may fit: no short set is sure to dominate
            a, b = best_pair(j, room)
            if k >= a + b:
                take((j, k))
                continue
            above = []  # the two smallest pieces longer than b
            for x in lengths[bisect.bisect_right(lengths, b):]:
                above += [x] * (count[x] - (x == j))
                if len(above) >= 2:
                    break
            if a == k and (len(above) < 2 or sum(above[:2]) > room):
                take((j, a, b))
                continue
            break
    return fixed


def plan(count: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Per length, segments ``(first number, pieces per sequence, first
    sequence, offset)``: piece number i of the length goes to sequence
    ``first sequence + (i - first number) // per`` at ``offset + (i - first
    number) % per * length``."""
    count = dict(count)
    segments: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    opened = 0

    def put(length: int, per: int, first: int, bins: int, offset: int) -> None:
        segments[length].append((used[length], per, first, offset))
        used[length] += per * bins

    for items, bins in reduce_instance(count, capacity):
        offset = 0
        for x in dict.fromkeys(items):
            put(x, items.count(x), opened, bins, offset)
            offset += x * items.count(x)
        opened += bins

    room: dict[int, list[tuple[int, int]]] = {}  # left over -> [(first sequence, how many)]
    rooms: list[int] = []

    def keep(left: int, first: int, bins: int) -> None:
        if bins and left:
            if left not in room:
                room[left] = []
                bisect.insort(rooms, left)
            room[left].append((first, bins))

    for length in sorted(count, reverse=True):
        left_over = count[length]
        while left_over:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, bins = room[left].pop()
                if not room[left]:
                    del room[left]
                    rooms.pop(at)
            else:
                left, first = capacity, opened
                bins = -(-left_over // (capacity // length))
                opened += bins
            per = left // length
            full = min(bins, left_over // per)
            if full:
                put(length, per, first, full, capacity - left)
                keep(left - per * length, first, full)
                left_over -= full * per
            if full < bins and left_over:  # fewer left than one sequence takes
                put(length, left_over, first + full, 1, capacity - left)
                keep(left - left_over * length, first + full, 1)
                left_over, full = 0, full + 1
            keep(left, first + full, bins - full)
    return segments


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``doc_id, piece,
    length, ids_crc32, ...``), which are read three times: pass a frame that
    is stored.  The histogram of at most ``capacity`` lengths comes to the
    driver, and the plan, of a size bounded by ``capacity`` too, is broadcast."""
    spark = pieces.sparkSession
    count = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    total = sum(count.values())
    segments = plan(count, capacity)
    plans = spark.createDataFrame(
        [(x, [tuple(map(int, s)) for s in segs]) for x, segs in segments.items()],
        "p_length long, segs array<struct<lo:long,per:long,first:long,offset:long>>")
    buckets = max(1, math.isqrt(total))  # neither a bucket nor the table of a length's buckets gets large
    dealt = pieces.withColumn("p_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("c_length").orderBy("c_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = (dealt.groupBy(F.col("length").alias("c_length"), F.col("p_bucket").alias("c_bucket"))
              .agg(F.count(F.lit(1)).alias("n"))
              .select("c_length", "c_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    inside = Window.partitionBy("length", "p_bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (dealt.withColumn("at", F.row_number().over(inside) - 1)
                .join(counts, (F.col("length") == F.col("c_length")) & (F.col("p_bucket") == F.col("c_bucket")))
                .withColumn("at", F.col("at") + F.col("before")))
    placed = (numbered.join(F.broadcast(plans), F.col("length") == F.col("p_length"))
              .withColumn("seg", F.element_at(F.filter("segs", lambda s: s["lo"] <= F.col("at")), -1))
              .withColumn("step", F.col("at") - F.col("seg.lo")))

    def whole(x: Column) -> Column:
        return x.cast("long")

    return placed.select(*pieces.columns,
                         whole(F.col("seg.first") + F.floor(F.col("step") / F.col("seg.per"))).alias("sequence_id"),
                         whole(F.col("seg.offset") + F.col("step") % F.col("seg.per") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   with_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and place there.  Pieces are
    checkpointed, so texts are tokenized once."""
    return place(cut_pieces(docs, vocabulary, capacity, end_id, with_ids).checkpoint(), capacity)
