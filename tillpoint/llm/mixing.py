"""Mixing sources to target weights by Pareto order sampling (operator 4).

A document's size is its number of words.  The mix has ``budget`` times all
sizes; sources share it by weight, no source takes more than ``repeats``
times its own size, and what that leaves over is shared again by weight.

Documents of a source are not alike: a short one is expected more often than
a long one.  Around the source's share (target / size) a document's expected
copies move with a preference that falls with its size, as far as half the
room to 0 and to ``repeats``, and are centred so that they add up to the
target in words.  The whole part of a document's expectation is taken for
certain.  The fractions are inclusion odds of a sample without replacement of
fixed size in words: documents are ranked by the odds of a uniform number
(from a hash of the doc_id) divided by the odds of their inclusion, and taken
in this order while the words stay within the target.  Behind the cut those
that still fit are taken in the same order, and at last the one document
whose size comes nearest to what is left then, if that brings the source
nearer to its target.

Ranks are found without sorting a source: ranks fall into 2**20 slots, prefix
sums over the slots find that of the cut, and only its rows (a millionth of a
source) are ordered.  Documents
meet the numbers of their source by source and slot of the uniform number, so
no source is a hot key.

Defined results: a null or empty text has size 0 and takes nothing (its
copies are those for certain); rows equal in doc_id and size rank as one and
are taken together; null
sources are one source of their own, after all others; ties in the
ranking go by doc_id and size; an empty table gives an empty result; extra columns
are kept on request and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
REPEATS = 2
#: Slots of the uniform number (for joins) and of the rank.
SLOTS = 4096
RANKS = 1 << 20
#: Part of the room around a source's share that sizes may use, and the size of middle preference.
FAVOUR = 0.5
MIDDLE = 256
SEED = "mix"


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A number strictly between 0 and 1 from 52 bits of a hash."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit(""))))))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, repeats: int) -> DataFrame:
    """``(m_source, source_size, target)`` from ``(m_source, source_size)``,
    one row per source.  A water level: sources below their cap get
    ``weight * level``, found by prefix sums in the order in which they reach
    it.  The table of sources is small whatever the documents are."""
    number = F.row_number().over(Window.orderBy(F.col("m_source").isNull(), "m_source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int"))
    s = sizes.withColumn("m_number", number).withColumn("m_weight", weight)
    s = s.withColumn("m_cap", repeats * F.col("source_size")).withColumn("m_ratio", F.col("m_cap") / F.col("m_weight"))
    order = Window.orderBy("m_ratio", "m_number")
    below, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("m_level", (F.sum("source_size").over(every) * F.lit(float(budget))
                                 - F.coalesce(F.sum("m_cap").over(below), F.lit(0))) / F.sum("m_weight").over(rest))
    s = s.withColumn("m_open", F.col("m_level") <= F.col("m_ratio"))
    s = s.withColumn("m_level", F.min_by("m_level", F.when(F.col("m_open"), F.struct("m_ratio", "m_number"))).over(every))
    return s.select("m_source", "source_size",
                    F.coalesce(F.least(F.col("m_weight") * F.col("m_level"), F.col("m_cap").cast("double")),
                               F.col("m_cap").cast("double")).alias("target"))


def preference(size: Column) -> Column:
    """Between 0 (long) and 65536 (empty), a whole number, so that sums of it
    do not depend on their order."""
    return F.floor(F.lit(65536 * MIDDLE) / (size + MIDDLE)).cast("long")


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def ranked(d: DataFrame, repeats: int) -> DataFrame:
    """``m_whole`` copies for certain and ``m_z``, the Pareto rank between 0
    and 1 (null: no odds of another copy), for rows with their source's
    ``source_size, target, m_liked``."""
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    room = F.lit(FAVOUR) * F.least(share, F.lit(float(repeats)) - share)
    expected = share + room * (preference(F.col("size")) - F.col("m_liked")) / 65536.0
    d = d.withColumn("m_expected", expected).withColumn("m_whole", F.floor("m_expected"))
    part = F.col("m_expected") - F.col("m_whole")
    odds = (F.col("m_u") / (1 - F.col("m_u"))) / (part / (1 - part))
    return d.withColumn("m_z", F.when(part > 0, odds)).withColumn("m_z", F.col("m_z") / (1 + F.col("m_z")))


def slot(z: Column) -> Column:
    return F.least(F.floor(z * RANKS), F.lit(RANKS - 1)).cast("int")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS,
        seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``
    (words), ``copies``, and the columns of ``keep`` as one struct ``kept``."""
    def measured(extra: list[Column]) -> DataFrame:
        words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), GAP), "")).cast("long")
        rows = docs.select("doc_id", F.col("source").alias("m_source"), words.alias("size"), uniform(F.col("doc_id"), F.col("text"), seed).alias("m_u"), *extra)
        return rows.withColumn("m_home", F.floor(F.col("m_u") * SLOTS).cast("int"))

    light = measured([]).checkpoint()
    # the small tables are written too: plans that hold one another grow with every step
    homes = light.groupBy("m_source", "m_home").agg(
        F.sum("size").alias("m_words"), F.sum(F.col("size") * preference(F.col("size"))).alias("m_liking")).checkpoint()
    sizes = homes.groupBy("m_source").agg(F.sum("m_words").alias("source_size"), F.sum("m_liking").alias("m_liking"))
    targets = source_targets(sizes.select("m_source", "source_size"), weights, budget, repeats)
    liked = F.when(F.col("source_size") > 0, F.col("m_liking") / F.col("source_size")).otherwise(0.0)
    sources = (targets.join(sizes.select(F.col("m_source").alias("s_source"), "m_liking"), same("m_source", "s_source"))
               .select("m_source", "source_size", "target", liked.alias("m_liked"))).checkpoint()

    def at_home(numbers: DataFrame) -> DataFrame:
        """Numbers of every source, by source and slot."""
        n = numbers.withColumnRenamed("m_source", "k_source")
        h = homes.select(F.col("m_source").alias("h_source"), F.col("m_home").alias("k_home"))
        return n.join(h, same("k_source", "h_source")).drop("h_source")

    def meet(rows: DataFrame, numbers: DataFrame) -> DataFrame:
        return rows.join(at_home(numbers), same("m_source", "k_source") & (F.col("m_home") == F.col("k_home"))).drop("k_source", "k_home")

    d = ranked(meet(light, sources), repeats)
    d = d.select("doc_id", "m_source", "m_home", "size", "target", "m_whole", "m_z", slot(F.col("m_z")).alias("m_slot")).checkpoint()
    left = d.groupBy("m_source").agg((F.first("target") - F.sum(F.col("size") * F.col("m_whole"))).alias("left")).checkpoint()
    odds = d.where("m_z IS NOT NULL AND size > 0")

    def cut_in(rows: DataFrame, left: DataFrame) -> DataFrame:
        """``(m_source, slot, last, rest)``: where ``rows`` in order go over
        the ``left`` words of their source, and the words missing there.  A
        source whose rows all fit has none."""
        words = (rows.groupBy("m_source", "m_slot").agg(F.sum("size").alias("m_words"))
                 .join(left.withColumnRenamed("m_source", "l_source"), same("m_source", "l_source")))
        order = Window.partitionBy("m_source").orderBy("m_slot").rowsBetween(Window.unboundedPreceding, 0)
        over = words.withColumn("m_upto", F.sum("m_words").over(order)).where(F.col("m_upto") > F.col("left"))
        at = over.groupBy(F.col("m_source").alias("c_source")).agg(
            F.min("left").alias("left"), F.min("m_slot").alias("slot"), F.min_by(F.col("m_upto") - F.col("m_words"), "m_slot").alias("start"))
        # rows of that slot, in order; equal rows come together
        order = Window.partitionBy("m_source").orderBy("m_z", "doc_id", "size")
        last = (rows.join(at, same("m_source", "c_source") & (F.col("m_slot") == F.col("slot")))
                .withColumn("m_upto", F.col("start") + F.sum("size").over(order.rangeBetween(Window.unboundedPreceding, 0))))
        fits = F.col("m_upto") <= F.col("left")
        return last.groupBy("m_source", "slot").agg(
            F.max(F.when(fits, place)).alias("last"), (F.min("left") - F.coalesce(F.max(F.when(fits, F.col("m_upto"))), F.min("start"))).alias("rest"))

    def before(cut: str) -> Column:
        """Rows up to a cut; all of a source that has none."""
        c = F.col(cut)
        return c.isNull() | (F.col("m_slot") < c["slot"]) | ((F.col("m_slot") == c["slot"]) & F.coalesce(place <= c["last"], F.lit(False)))

    def as_one(cut: DataFrame, name: str) -> DataFrame:
        return cut.select("m_source", F.struct("slot", "last", "rest").alias(name))

    place = F.struct("m_z", "doc_id", "size")
    first = as_one(cut_in(odds, left), "first").checkpoint()
    # what is passed over there makes room for what still fits, in the same order
    fitting = ~before("first") & (F.col("size") <= F.col("first.rest"))
    more = meet(odds, first).where(fitting).drop("first").checkpoint()
    second = as_one(cut_in(more, first.select("m_source", F.col("first.rest").alias("left"))), "second").checkpoint()
    all_fit = more.groupBy(F.col("m_source").alias("a_source")).agg(F.sum("size").alias("fit"))
    second = second.withColumnRenamed("m_source", "b_source")
    cuts = (first.join(second, same("m_source", "b_source"), "left").join(all_fit, same("m_source", "a_source"), "left")
            .select("m_source", "first", "second", F.coalesce("second.rest", F.col("first.rest") - F.coalesce("fit", F.lit(0))).alias("m_rest"))).checkpoint()
    taken = F.col("m_z").isNotNull() & (before("first") | fitting & before("second"))
    # and the one document that then comes nearest to what is left
    far = F.abs(F.col("size") - F.col("m_rest"))
    behind = meet(odds, cuts).where(~taken & (far < F.col("m_rest")))
    filler = behind.groupBy(F.col("m_source").alias("f_source")).agg(F.min_by(place, F.struct(far.alias("far"), "m_z", "doc_id", "size")).alias("m_filler"))
    cuts = cuts.withColumnRenamed("m_source", "c_source")
    numbers = (sources.join(cuts, same("m_source", "c_source"), "left").drop("c_source", "m_rest")
               .join(filler, same("m_source", "f_source"), "left").drop("f_source")).checkpoint()
    out = ranked(meet(measured([F.struct(*keep).alias("kept")]) if keep else light, numbers), repeats)
    out = out.withColumn("m_slot", slot(F.col("m_z")))
    again = (F.col("size") > 0) & (taken | F.coalesce(place == F.col("m_filler"), F.lit(False)))
    out = out.withColumn("copies", F.col("m_whole") + F.when(again, 1).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"),
                      F.col("copies").cast("int").alias("copies"), *(["kept"] if keep else []))
