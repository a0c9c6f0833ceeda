"""Document fingerprints by SimHash (operator 6), DataFrame functions only.

Terms are pairs of neighbouring words (the last word stands alone too),
weighted by their length.  A term's 128 hash bits vote for or against each
fingerprint bit.  The votes are counted in 64 sums: each sum holds two
counters of 32 bits, those of hash bits j and j + 32, so one pass of a
whole-stage aggregation counts all bits.

Each document is compared with an edited form of itself and with the next
document (ascending doc_id, then text; after the last comes the first).
Documents are dealt by ranges of doc_id, at approximate quantiles that are
ids of the table; the document that opens a range is also put at the end of
the range before, so every neighbour is found inside one range and the texts
are shuffled once.

:func:`within_radius` finds fingerprints within a Hamming radius: with one
block more than the radius, two such fingerprints agree on a block, so each
is put into one table per block, permuted so that this block leads.  Far
radii take fewer, wider blocks: one of them differs in at most radius / blocks
bits, and a query looks up all values of its block within so many bits.

Defined results: a null text is empty, and has the fingerprint of the empty
word; equal texts have equal fingerprints; a single document is its own next
one; null doc_ids come after all others; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, exchange_width

BITS = 128
RADIUS = 3
QUERY_EVERY = 100
#: Radius and blocks of the registered query: of the pairs of sf0.1 with a
#: Jaccard similarity of 0.8 to 1 (two-word shingles) 95.7 % lie within 23
#: bits, none within 3; pairs drawn at random that lie within 23 but not
#: within 3 are 2 in 100,000.
NEAR_RADIUS = 23
NEAR_BLOCKS = 8
BLANKS = " \t\n\x0b\x0c\r"
LAST = (1 << 63) - 1
LANES = 0x0000000100000001
LOW = 0xFFFFFFFF


def range_bounds(ids: DataFrame, ranges: int) -> list[int]:
    """Distinct ids that open ranges of about equally many rows; the first is
    the smallest id.  One bounded array comes to the driver."""
    steps = [k / ranges for k in range(ranges)]
    row = ids.agg(F.min("k").alias("least"), F.percentile_approx("k", steps, max(10_000, 10 * ranges)).alias("cuts")).first()
    return sorted({row["least"], *row["cuts"]}) if row["least"] is not None else []


def literal(values: list[int]) -> Column:
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') AS array<bigint>)")


def range_of(k: Column, bounds: list[int]) -> Column:
    """How many bounds are at most ``k``, searched in two steps."""
    wide = max(1, int(len(bounds) ** 0.5))
    coarse = F.size(F.filter(literal(bounds[::wide]), lambda b: b <= k))
    fine = F.filter(F.slice(literal(bounds), (coarse - 1) * wide + 1, F.lit(wide)), lambda b: b <= k)
    return (coarse - 1) * wide + F.size(fine)


def with_next(docs: DataFrame) -> DataFrame:
    """``(range, pos, copy, doc_id, text, next_text)``: documents in order
    inside their range, each range closed by a copy of the document after it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("k"))
    bounds = range_bounds(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("k")),
                          4 * exchange_width(docs.sparkSession)) or [0]
    at = range_of(F.col("k"), bounds)
    opens = F.array_contains(literal(bounds), F.col("k"))
    # (range, copy): a range's opening rows also close the range before; the very first close the last one
    own = F.struct(at.alias("range"), F.lit(False).alias("copy"))
    before = F.struct(F.when(at > 1, at - 1).otherwise(len(bounds)).alias("range"), F.lit(True).alias("copy"))
    rows = rows.withColumn("at", F.explode(F.when(opens, F.array(own, before)).otherwise(F.array(own))))
    order = Window.partitionBy("range").orderBy("copy", "k", "text")
    return (rows.select("at.range", "at.copy", "k", "doc_id", "text")
            .withColumn("pos", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order)))


def votes(h: Column, weight: Column) -> list[Column]:
    """32 sums, each of the weights of hash bits j (low half) and j + 32."""
    return [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LANES)) * weight) for j in range(32)]


def signs(sums: list[str], total: str) -> Column:
    """64 bits: which were voted for by more than half the weight."""
    def bit(on: Column, j: int) -> Column:
        return F.when(on, F.lit(1 << j if j < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long")

    parts = [bit(F.col(s).bitwiseAND(F.lit(LOW)) * 2 > F.col(total), j) for j, s in enumerate(sums)]
    parts += [bit(F.shiftrightunsigned(F.col(s), 32) * 2 > F.col(total), j + 32) for j, s in enumerate(sums)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def simhash(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys, f1, f2``: the fingerprint of the text of each row; ``keys``
    tell rows apart."""
    words = F.split(F.btrim(F.col(text), F.lit(BLANKS)), GAP, -1)
    terms = rows.withColumn("words", words).select(*keys, F.explode(F.arrays_zip(
        F.col("words").alias("a"), F.slice("words", F.lit(2), F.size("words")).alias("b"))).alias("t"))
    terms = terms.select(*keys, F.xxhash64("t.a", "t.b").alias("h"),
                         (F.octet_length("t.a") + F.coalesce(F.octet_length("t.b"), F.lit(0)) + 1).cast("long").alias("w"))
    terms = terms.select(*keys, "h", F.xxhash64("h").alias("g"), "w")
    named = [c.alias(f"h{j}") for j, c in enumerate(votes(F.col("h"), F.col("w")))]
    named += [c.alias(f"g{j}") for j, c in enumerate(votes(F.col("g"), F.col("w")))]
    sums = terms.groupBy(*keys).agg(F.sum("w").alias("total"), *named)
    return sums.select(*keys, signs([f"h{j}" for j in range(32)], "total").alias("f1"),
                       signs([f"g{j}" for j in range(32)], "total").alias("f2"))


def distance(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def likeness(a1: str, a2: str, b1: str, b2: str) -> Column:
    return 1.0 - distance(F.col(a1), F.col(a2), F.col(b1), F.col(b2)) / F.lit(float(BITS))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, f1, f2, e1, e2, n1, n2``: two halves
    of the fingerprints of the text, of its edited form and of the next
    document.  Window, vote and window again run in the one shuffle by range."""
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    tail = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - tail).cast("int")),
                                              F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), tail)))
    keys = ["range", "pos", "copy", "doc_id", "n_chars", "edited_sha256", "kind"]
    rows = (rows.withColumn("edited_sha256", F.sha2("edited", 256))
            .withColumn("form", F.explode(F.when(F.col("copy"), F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body"))))
                                          .otherwise(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")),
                                                             F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body"))))))
            .select("range", "pos", "copy", "doc_id", "n_chars", "edited_sha256", "form.kind", "form.body"))
    order = Window.partitionBy("range").orderBy("pos", "kind")
    both = simhash(rows, "body", keys)
    for half in ("1", "2"):  # a row's edited form follows it, and the next document follows that
        both = (both.withColumn("e" + half, F.lead("f" + half).over(order))
                .withColumn("n" + half, F.lead("f" + half, 2).over(order)))
    return both.where("kind = 0 AND NOT copy").select("doc_id", "n_chars", "edited_sha256", "f1", "f2", "e1", "e2", "n1", "n2")


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """``(q1, q2, n_near)``: how many rows of ``prints(f1, f2)`` lie within
    ``radius`` of each distinct query fingerprint, itself included.  Equal
    fingerprints are counted before the tables are built; a pair is kept in
    the first table where its blocks agree, but for ``radius // blocks`` bits
    (none with one block more than the radius, the default)."""
    blocks = blocks or radius + 1
    width = -(-BITS // blocks)
    flips = radius // blocks
    if flips and width > 63:
        raise ValueError("blocks in which bits may differ have at most 63 bits")
    masks = [sum(1 << j for j in at) for k in range(flips + 1) for at in combinations(range(width), k)]

    def block(f1: Column, f2: Column, t: int) -> Column:
        bits = [(f1, j) if j < 64 else (f2, j - 64) for j in range(t * width, min(BITS, (t + 1) * width))]
        out, done = F.lit(0).cast("long"), 0
        for half in (f1, f2):
            own = [j for h, j in bits if h is half]
            mask = sum(1 << j for j in own)
            if mask and flips:
                out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(half, own[0]).bitwiseAND(F.lit((1 << len(own)) - 1)), done))
                done += len(own)
            elif mask:
                out = F.xxhash64(out, half.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
        return out

    def agree(t: int) -> Column:
        a, b = block(F.col("f1"), F.col("f2"), t), block(F.col("q1"), F.col("q2"), t)
        return F.bit_count(a.bitwiseXOR(b)) <= flips if flips else a == b

    def tables(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(t).alias("t"), block(F.col(a), F.col(b), t).alias("v")) for t in range(blocks)])
        return df.withColumn("at", F.explode(keys)).select("*", F.col("at.t").alias(key + "_t"), F.col("at.v").alias(key + "_v")).drop("at")

    known = tables(prints.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n")), "f1", "f2", "k")
    asked = tables(queries.select(F.col("f1").alias("q1"), F.col("f2").alias("q2")).distinct(), "q1", "q2", "a")
    if flips:  # many rows that compress to few bytes: not to be broadcast
        asked = asked.withColumn("m", F.explode(literal(masks))).withColumn("a_v", F.col("a_v").bitwiseXOR(F.col("m"))).drop("m").hint("merge")
    first = F.coalesce(*[F.when(agree(t), F.lit(t)) for t in range(blocks)])
    return (asked.join(known, (F.col("a_t") == F.col("k_t")) & (F.col("a_v") == F.col("k_v"))
                       & (distance(F.col("f1"), F.col("f2"), F.col("q1"), F.col("q2")) <= radius) & (first == F.col("k_t")))
            .groupBy("q1", "q2").agg(F.sum("n").alias("n_near")))


def hexed(a: str, b: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def fingerprint_report(docs: DataFrame, radius: int = RADIUS, every: int = QUERY_EVERY, blocks: int | None = None) -> DataFrame:
    """One row per document; ``n_near`` (for doc_ids divisible by ``every``):
    how many other documents' fingerprints lie within ``radius``."""
    prints = fingerprints(docs).checkpoint()
    asked = prints.where(F.col("doc_id") % every == 0)
    near = within_radius(prints.select("f1", "f2"), asked, radius, blocks)
    is_query = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    return (prints.withColumn("asked", is_query)
            .join(near.withColumn("there", F.lit(True)),
                  F.col("asked") & (F.col("f1") == F.col("q1")) & (F.col("f2") == F.col("q2")), "left")
            .select("doc_id", "n_chars", "edited_sha256", hexed("f1", "f2").alias("fingerprint"),
                    hexed("e1", "e2").alias("edited_fingerprint"),
                    likeness("f1", "f2", "e1", "e2").alias("near_edited"),
                    F.coalesce(likeness("f1", "f2", "n1", "n2"), F.lit(1.0)).alias("near_next"),
                    (F.col("n_near") - 1).alias("n_near")))
