"""MinHash near-dedup by HyperMinHash (operator 7).

A document is its set of distinct word shingles.  Each shingle is hashed
once: the top bits choose one of 512 registers, and a register keeps of the
smallest hash it saw only the count of leading zeros and ten mantissa bits
(16 bits in all).  A register that no shingle chose takes the smallest value
of the whole set under a hash function of its own, so short documents have
full sketches too.

1. *Banding.*  102 bands of ten registers (every register is in two);
   documents that agree on at least two bands are candidates.  A pair at
   similarity 0.8 is missed with a probability of about 4e-4, one at 0.82
   with 4e-5 (simulated); of pairs at 0.6, 13 % are candidates, at 0.7 77 %.  Buckets of
   documents report each band key once per distinct set; shards keep keys
   that several sets have.
2. *Verification.*  A pair's full sets meet; the collision-corrected Jaccard
   estimate of the sketches sorts out hopeless pairs, then the sets
   themselves are intersected.
3. *Groups without all pairs.*  Documents of equal sets are one node.  In
   two rounds, each node is compared with a few hubs: of every band one node
   is the hub (the one that meets most others over all its bands, as the
   text does that a group was copied from; then one by hash), and a node
   tries the hubs it meets most often and is not yet connected to.  Only
   pairs that still lead from one component to another matter after that.
4. *Around a pivot.*  Many of them lie in one large group, whose nodes meet
   one popular node, their pivot.  There a node is what its set and the
   pivot's do not share.  Two sets are similar only if they have enough of
   these differences in common, and that takes at least one unless both are
   linked with the pivot.  Differences are ranked, rare ones first; a pair
   is compared if its first common one leaves enough behind it.  This drops
   no similar pair, and nodes that only have the pivot's words in common
   never meet.
5. *The rest.*  Pairs of other pivots, or none, are compared if they agree on
   two bands, all of them, so no link that matters is left out.  They are
   dealt over a grid, a row and a column per node, so a set goes to about
   twice the square root of the shards, however many pairs it is in.

Defined results: words are lower-cased (A-Z) runs of other than white space;
a text of fewer words than a shingle is one shingle; a text without words is
an empty set and linked with nothing; rows of one doc_id are one document
(of differing texts the smallest counts); a null doc_id is never linked and
always kept, with a null component; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import (NULL_ID, bucket_of, column, exchange_width, in_buckets, int64s, mix, pack, split_by, squeeze,
                     stretch_out, unboxed, unpack, written)
from .components import components
from .wordseq import sequence_hashes, split_words, word_hashes

SHINGLE = 2
SIMILAR = (80, 100)
REGISTERS = 512
MANTISSA = 10
BAND = 10
BANDS = 2 * (REGISTERS // BAND)
AGREE = 2
#: Order of the registers in the second half of the bands.
SECOND = np.arange(REGISTERS) * 227 % REGISTERS
#: How far below the threshold an estimate may be: eight standard deviations.
MARGIN = 0.15
#: Hubs that a node is compared with in each round.
PARTNERS = (4, 8)
#: Documents compared with one hub in one task.
FANOUT = 500
#: Nodes that make one a pivot.
DENSE = 50
SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
SKETCHED = "dest int, bucket int, kind int, a binary, b binary, c binary, d binary"


def shingle_sets(tab: pa.Table, size: int):
    """``(row, doc_id, sorted distinct shingle hashes)`` of a bucket."""
    ids = int64s(tab, "doc_id").tolist()
    words = split_words(pc.ascii_lower(column(tab, "text")))
    h = word_hashes(words.vocab)[:, 0][words.code]
    grams = mix(sequence_hashes(h, size))
    off = words.off.tolist()
    for r, (i, a, b) in enumerate(zip(ids, off, off[1:])):
        if b - a >= size:
            yield r, i, np.unique(grams[a:b - size + 1])
        elif b > a:
            yield r, i, mix(sequence_hashes(h[a:b], b - a) ^ np.uint64(b - a))
        else:
            yield r, i, grams[:0]


def once(tab: pa.Table) -> pa.Table:
    """The first row of each doc_id; every row without one."""
    ids = int64s(tab, "doc_id")
    return tab.filter(pa.array(np.r_[True, ids[1:] != ids[:-1]][:len(ids)] | (ids == NULL_ID)))


def compressed(low: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of 56-bit minima, 16 bits, never 0."""
    bits = np.frexp((low >> np.uint64(4)).astype(np.float64))[1].astype(np.uint64) + np.uint64(4)
    mantissa = (low << (np.uint64(65) - bits)) >> np.uint64(64 - MANTISSA)
    return ((np.uint64(57) - bits) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)


def sketch(s: np.ndarray) -> np.ndarray:
    """Registers of a sorted, distinct, non-empty set of 64-bit hashes."""
    reg = np.zeros(REGISTERS, np.uint16)
    which = (s >> np.uint64(55)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
    reg[which[first]] = compressed((s[first] & np.uint64((1 << 55) - 1)) << np.uint64(1))
    empty = np.flatnonzero(reg == 0)
    if len(empty):
        z = s[None, :] ^ SEEDS[empty][:, None]
        z *= np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(32)
        z *= np.uint64(0xD6E8FEB86659FD93)
        reg[empty] = compressed(z.min(axis=1) >> np.uint64(8))
    return reg


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Keys (one per band) of rows of registers."""
    used = REGISTERS // BAND * BAND
    rows = np.concatenate([regs[:, :used], regs[:, SECOND[:used]]], axis=1).astype(np.uint64).reshape(len(regs), BANDS, BAND)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.zeros((len(regs), 1), np.uint64)
    for j in range(BAND):
        key = key * np.uint64(0x100000001B3) + rows[:, :, j]
        key *= np.uint64(0x9E3779B97F4A7C15)
    return mix(key)


def estimate(x: np.ndarray, y: np.ndarray, n: int, m: int) -> float:
    """Jaccard similarity of two sketches, less the registers that are
    expected to agree by chance."""
    n, m = max(n, m), min(n, m)
    chance = 0.169919487159739 * REGISTERS / (1 << MANTISSA) * 4 * (n / m) / (1 + n / m) ** 2
    return max(0.0, (float(np.count_nonzero(x == y)) - chance) / REGISTERS)


def blobs(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[]] * 7
    kinds = [pa.int32()] * 3 + [pa.binary()] * 4
    return pa.table({k: pa.array(list(c), t) for k, c, t in zip(("dest", "bucket", "kind", "a", "b", "c", "d"), cols, kinds)})


def sketch_bucket(tab: pa.Table, size: int, shards: int) -> pa.Table:
    """Set sizes and set prints of all documents (kind 1, for the bucket
    itself), and band keys of one document of each distinct set by shard."""
    bucket = int(column(tab, "bucket")[0].as_py())
    seen: dict[bytes, int] = {}
    ids, sizes, prints, reps, regs = [], [], [], [], []
    for _, i, s in shingle_sets(once(unboxed(tab)), size):
        mark = xxhash.xxh3_128_digest(s.tobytes())
        ids.append(i)
        sizes.append(len(s))
        prints.append(mark)
        if len(s) and i != NULL_ID and mark not in seen:
            seen[mark] = i
            reps.append(i)
            regs.append(sketch(s))
    rows = [(shards + bucket, bucket, 1, pack(np.array(ids, np.int64)), pack(np.array(sizes, np.int64)), b"".join(prints), b"")]
    if reps:
        keys = band_keys(np.array(regs)).ravel()
        nodes = np.repeat(np.array(reps, np.int64), BANDS)
        order, ends = split_by((keys % np.uint64(shards)).astype(np.int32), shards)
        for k in range(shards):
            part = order[ends[k]:ends[k + 1]]
            if len(part):
                part = part[np.argsort(keys[part], kind="stable")]
                rows.append((k, bucket, 0, pack(keys[part]), pack(nodes[part]), b"", b""))
    return blobs(rows)


def meet(tab: pa.Table, shards: int) -> pa.Table:
    """Keys of a shard that two nodes or more have; other rows pass through."""
    dest = column(tab, "dest").to_numpy()
    cols = [column(tab, c).to_pylist() for c in ("bucket", "kind", "a", "b", "c", "d")]
    if dest[0] >= shards:
        return blobs([(int(t), *row) for t, row in zip(dest, zip(*cols))])
    keys = np.concatenate([unpack(x, np.uint64) for x in cols[2]])
    nodes = np.concatenate([unpack(x, np.int64) for x in cols[3]])
    order = np.argsort(keys, kind="stable")
    keys, nodes = keys[order], nodes[order]
    same = keys[1:] == keys[:-1]
    multi = np.r_[False, same] | np.r_[same, False]
    return blobs([(int(dest[0]), -1, 0, pack(keys[multi]), pack(nodes[multi]), b"", b"")])


def documents_of(batches):
    for batch in batches:
        for a, b, c in zip(*(column(batch, k).to_pylist() for k in "abc")):
            ids, marks = unpack(a, np.int64), np.frombuffer(c, "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64(), mask=ids == NULL_ID), pa.array(unpack(b, np.int64)),
                 pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy())], ["doc_id", "n_shingles", "p", "q"])


def members_of(batches):
    for batch in batches:
        for a, b in zip(*(column(batch, k).to_pylist() for k in "ab")):
            yield pa.RecordBatch.from_arrays([pa.array(unpack(a, np.int64)), pa.array(unpack(b, np.int64))], ["band", "doc"])


def send_sets(left: pa.Table, right: pa.Table, size: int, shards: int) -> pa.Table:
    """Sketch and set of every asked-for document of a bucket, by the shard
    where it is compared with ``hub`` (the document itself: it is the hub)."""
    if left.num_rows == 0 or right.num_rows == 0:
        return blobs([])
    tab = once(unboxed(left))
    wanted = pa.array(np.unique(column(right, "doc").to_numpy()))
    tab = tab.filter(pc.is_in(column(tab, "doc_id"), value_set=wanted))
    sets = {i: s for _, i, s in shingle_sets(tab, size)}
    groups: dict[int, list[tuple[int, int]]] = {}
    for doc, hub, shard in zip(*(column(right, c).to_pylist() for c in ("doc", "hub", "shard"))):
        groups.setdefault(shard, []).append((hub, doc))
    rows = []
    for shard, asked in groups.items():
        own = sorted({d for _, d in asked})
        rows.append((shard, 0, 0, pack(np.array(asked, np.int64)), pack(np.array([(d, len(sets[d])) for d in own], np.int64)),
                     pack(np.concatenate([sets[d] for d in own])), squeeze(b"".join(sketch(sets[d]).tobytes() for d in own))))
    return blobs(rows)


def brought(tab: pa.Table) -> tuple[dict, dict, dict]:
    """Sets and sketches of a shard's documents, and the documents of each hub."""
    sets, regs, asked = {}, {}, {}
    for a, b, c, d in zip(*(column(tab, k).to_pylist() for k in "abcd")):
        sizes, vals = unpack(b, np.int64).reshape(-1, 2), unpack(c, np.uint64)
        reg, at = np.frombuffer(stretch_out(d), np.uint16).reshape(-1, REGISTERS), 0
        for k, (doc, n) in enumerate(sizes.tolist()):
            sets[doc], regs[doc] = vals[at:at + n], reg[k]
            at += n
        for hub, doc in unpack(a, np.int64).reshape(-1, 2).tolist():
            if hub != doc:
                asked.setdefault(hub, []).append(doc)
    return sets, regs, asked


def link_shard(tab: pa.Table, similar: tuple[int, int]) -> pa.Table:
    """Pairs (hub, document) whose full sets are similar enough."""
    sets, regs, asked = brought(tab)
    out = []
    num, den = similar
    for hub, docs in asked.items():
        s, r = sets[hub], regs[hub]
        for doc in set(docs):
            t = sets[doc]
            if den * min(len(s), len(t)) < num * max(len(s), len(t)):
                continue
            if estimate(r, regs[doc], len(s), len(t)) < num / den - MARGIN:
                continue
            at = np.searchsorted(s, t)
            at[at == len(s)] = 0
            both = int(np.count_nonzero(s[at] == t))
            if den * both >= num * (len(s) + len(t) - both):
                out.append((hub, doc))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def differences(tab: pa.Table, similar: tuple[int, int]) -> pa.Table:
    """What only one of a pivot's and its node's sets holds, a row each;
    ``far``: the two are not similar enough."""
    sets, _, asked = brought(tab)
    num, den = similar
    about, each = [], []
    for pivot, docs in asked.items():
        s = sets[pivot]
        for doc in set(docs):
            t = sets[doc]
            each.append(np.setxor1d(s, t, assume_unique=True))
            both = (len(s) + len(t) - len(each[-1])) // 2
            about.append((pivot, doc, len(t), len(each[-1]), den * both < num * (len(s) + len(t) - both)))
    cols = np.repeat(np.array(about, np.int64).reshape(-1, 5), [len(e) for e in each], axis=0)
    element = np.concatenate([*each, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.table({"pivot": cols[:, 0], "node": cols[:, 1], "size": cols[:, 2], "diff": cols[:, 3],
                     "far": cols[:, 4].astype(bool), "element": element})


def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``(band, node, label)`` of the bands whose nodes are not all of one
    component."""
    now = (members.join(labels, "node", "left")
           .select("band", "node", "popular", F.coalesce("label", "node").alias("label")))
    mixed = now.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("top")).where("low <> top")
    return now.join(mixed.select("band"), "band")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    width = exchange_width(docs.sparkSession)
    buckets, shards = 4 * width, width
    dealt = in_buckets(docs, buckets)
    sketched = (dealt.groupBy("bucket").applyInArrow(lambda t: sketch_bucket(t, shingle, shards), SKETCHED)
                .groupBy("dest").applyInArrow(lambda t: meet(t, shards), SKETCHED).checkpoint())
    every = sketched.where("kind = 1").mapInArrow(documents_of, "doc_id long, n_shingles long, p long, q long")
    linkable = every.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = linkable.groupBy("p", "q", "n_shingles").agg(F.min("doc_id").alias("node"))
    nodes = linkable.join(sets, ["p", "q", "n_shingles"]).select(F.col("doc_id").alias("doc"), "node").checkpoint()

    members = (sketched.where("kind = 0").mapInArrow(members_of, "band long, doc long")
               .join(nodes, "doc").select("band", "node").distinct())
    spread = members.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("top"), F.count(F.lit(1)).alias("met"))
    members = written(members.join(spread.where("low <> top"), "band").select("band", "node", "met"))
    popular = members.groupBy("node").agg(F.sum("met").alias("popular"))
    members = written(members.join(popular, "node").select("band", "node", "popular"))

    def sent(asked: DataFrame) -> GroupedData:
        """The sets that ``asked(doc, hub, shard)`` brings together."""
        return (dealt.groupBy("bucket").cogroup(asked.withColumn("bucket", bucket_of(F.col("doc"), buckets)).groupBy("bucket"))
                .applyInArrow(lambda a, b: send_sets(a, b, shingle, shards), SKETCHED).groupBy("dest"))

    def linked(asked: DataFrame) -> DataFrame:
        """Links ``(a, b)`` among them."""
        return sent(asked).applyInArrow(lambda t: link_shard(t, similar), "a long, b long")

    def with_hubs(pairs: DataFrame) -> DataFrame:
        """``pairs(hub, node)``: a shard per hub and ``FANOUT`` of its nodes."""
        def shard(salt):
            return F.pmod(F.xxhash64("hub", salt), F.lit(shards)).cast("int").alias("shard")

        hubs = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / FANOUT).alias("salts"))
        salted = pairs.join(hubs, "hub").select("node", "hub", F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt"))
        homes = hubs.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        return (salted.select(F.col("node").alias("doc"), "hub", shard(F.col("salt")))
                .union(homes.select(F.col("hub").alias("doc"), "hub", shard(F.col("salt")))))

    def on_a_grid(pairs: DataFrame) -> DataFrame:
        side = max(1, math.isqrt(shards))

        def line(node):
            return F.pmod(F.xxhash64(node, F.lit(5)), F.lit(side))

        cell = (line("hub") * side + line("node")).cast("int").alias("shard")
        return (pairs.select(F.col("node").alias("doc"), "hub", cell)
                .union(pairs.select(F.col("hub").alias("doc"), "hub", cell).distinct()))

    tested = links = None
    now = members.withColumn("label", F.col("node"))
    for turn, partners in enumerate(PARTNERS):
        order = F.xxhash64("node", F.lit(turn)) if turn else F.struct(-F.col("popular"), "node")
        hubs = now.groupBy("band").agg(F.min_by(F.struct("node", "label"), order).alias("hub"))
        met = (now.join(hubs, "band").where("label <> hub.label")
               .groupBy("node", F.col("hub.node").alias("hub")).count().where(F.col("count") >= AGREE))
        rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("count"), "hub"))
        tries = (met.withColumn("rank", rank).where(F.col("rank") <= partners)
                 .select(F.least("hub", "node").alias("x"), F.greatest("hub", "node").alias("y"), "hub", "node"))
        if tested is not None:
            tries = tries.join(tested, ["x", "y"], "left_anti")
        tries = written(tries)
        found = written(linked(with_hubs(tries.select("hub", "node"))))
        tested = tries.select("x", "y") if tested is None else tested.union(tries.select("x", "y"))
        links = found if links is None else links.union(found)
        labels = components(links)
        now = written(unsettled(members, labels))

    def around(told: DataFrame, label: DataFrame) -> DataFrame:
        """Pairs ``(x, y)`` of one pivot and two labels that have enough differences in common, if any have."""
        num, den = similar
        often = told.groupBy("pivot", "element").agg(F.count(F.lit(1)).alias("often"))
        place = F.row_number().over(Window.partitionBy("pivot", "node").orderBy("often", "element"))
        # similar: 2 * common * (den + num) >= the sum of both slacks; room is what there is from a difference on
        rows = told.withColumn("slack", (den + num) * F.col("diff") - (den - num) * F.col("size"))
        low = rows.groupBy("pivot").agg(F.min("slack").alias("low"), F.min(F.when(F.col("far"), F.col("slack"))).alias("far_low"))
        rows = written(rows.join(often, ["pivot", "element"]).withColumn("room", 2 * (den + num) * (1 + F.col("diff") - place))
                       .where("often > 1").join(low, "pivot").join(label, "node"))
        x = rows.where("far AND room >= slack + low").select("pivot", "element", F.col("node").alias("x"), F.col("label").alias("x_label"),
                                                             F.col("slack").alias("x_slack"), F.col("room").alias("x_room"))
        y = rows.where("room >= slack + far_low").select("pivot", "element", "node", "label", "slack", "room", "far")
        return (x.join(y, ["pivot", "element"])
                .where("x_label <> label AND least(x_room, room) >= x_slack + slack AND (NOT far OR x < node)")
                .select(F.least("x", "node").alias("x"), F.greatest("x", "node").alias("y")).distinct())

    # What still leads from one component to another: all of it, without the pairs within a component.
    centre = now.groupBy("band").agg(F.max(F.struct("popular", -F.col("node"))).alias("centre"))
    pivot = now.join(centre, "band").groupBy("node").agg((-F.max("centre")["col2"]).alias("pivot"))
    dense = pivot.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= DENSE).select("pivot")
    pivot = written(pivot.join(dense, "pivot").select("node", "pivot"))
    now = written(now.join(pivot, "node", "left"))
    kinds = now.groupBy("band", "label", "pivot").agg(F.count(F.lit(1)).alias("n"))

    def largest(kind: str) -> DataFrame:
        """Of a band the kind that most nodes have, and how many."""
        return (kinds.where(F.col(kind).isNotNull()).groupBy("band", kind).agg(F.sum("n").alias("n"))
                .groupBy("band").agg(F.max(F.struct("n", F.col(kind).alias("of"))).alias(f"most_{kind}")))

    # one side of the pairs: those aside of the largest component, or of the largest group around a pivot
    by_pivot = F.coalesce(F.col("most_pivot.n") > F.col("most_label.n"), F.lit(False))
    aside = F.when(by_pivot, ~F.col("pivot").eqNullSafe(F.col("most_pivot.of"))).otherwise(F.col("label") != F.col("most_label.of"))
    now = written(now.join(largest("label"), "band").join(largest("pivot"), "band", "left")
                  .select("band", "node", "label", "pivot", aside.alias("aside")))
    rest = now.where("aside").select("band", F.col("node").alias("x"), F.col("label").alias("x_label"), F.col("pivot").alias("x_pivot"))
    across = (rest.join(now, "band").where("x_label <> label AND coalesce(x_pivot <> pivot, true) AND (NOT aside OR x < node)")
              .groupBy(F.least("x", "node").alias("x"), F.greatest("x", "node").alias("y")).count()
              .where(F.col("count") >= AGREE).select("x", "y"))
    crowded = not pivot.isEmpty()
    if crowded:
        told = written(sent(with_hubs(pivot.where("node <> pivot").select(F.col("pivot").alias("hub"), "node")))
                       .applyInArrow(lambda t: differences(t, similar), "pivot long, node long, size long, diff long, far boolean, element long"))
        links = links.union(told.where("NOT far").select("pivot", "node").distinct())
        across = written(across).union(around(told, now.select("node", "label").distinct()))
    across = written(across.join(tested, ["x", "y"], "left_anti").select(F.col("x").alias("hub"), F.col("y").alias("node")))
    if crowded or not across.isEmpty():
        labels = components(links.union(written(linked(on_a_grid(across)))))
    final = nodes.join(labels, "node", "left").select("doc", F.coalesce("label", "node").alias("component"))
    component = F.coalesce("component", "doc_id")
    return (every.join(final, F.col("doc_id") == F.col("doc"), "left")
            .select("doc_id", "n_shingles", component.alias("component_id"),
                    F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))


def one_of_each_group(docs: DataFrame, shingle: int, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The documents that :func:`near_dedup` keeps, with all their columns;
    of repeated rows of one doc_id the first by text."""
    buckets = 4 * exchange_width(docs.sparkSession)
    kept = near_dedup(docs, shingle, similar).where("kept").select(F.col("doc_id").alias("id"))
    kept = kept.where("id IS NOT NULL").withColumn("bucket", bucket_of(F.col("id"), buckets))
    schema = to_arrow_schema(docs.schema)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return schema.empty_table()
        tab = once(unboxed(left))
        ids = column(tab, "doc_id")
        tab = tab.filter(pc.or_(pc.is_null(ids), pc.is_in(ids, value_set=column(right, "id"))))
        cols = [column(tab, f.name) if f.name in ("doc_id", "text") else column(tab, "rest").field(f.name) for f in schema]
        return pa.table([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return (in_buckets(docs, buckets, others).groupBy("bucket").cogroup(kept.groupBy("bucket"))
            .applyInArrow(choose, docs.schema))
