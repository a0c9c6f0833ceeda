"""Chat formatting in budgeted windows (operator 8), DataFrame functions only.

A turn is written ``<|new|role|>text<|end|>`` and a line feed.  In roles and
texts the characters that control strings need are written as two-letter
codes, so no text can open, close or imitate a turn, in this template or in
the common ones, and reading back gives the text unchanged:

    \\ as \\e    < as \\l    [ as \\b    | as \\p

A conversation is cut into windows at turns, by prefix sums of turn tokens:
with a room of half of what the budget leaves beside the history and the
system turn, turns that start in the same room share a window, and a turn
longer than the room has one of its own; so only a turn that is too long by
itself exceeds the budget.  Every later window begins with the system turn
and the last ``HISTORY`` tokens of turns before it, written ``<|old|..``.
The loss mask holds the texts of new assistant turns alone: repeated targets
are masked out, so each is learned once.

Defined results: a null text or role is empty; turns without a number come
last; ties go by role and text, and repeated rows are turns like any other;
a null conv_id is a conversation; a system turn counts as such only at the
start; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD

BUDGET = 512
HISTORY = 128
#: Tokens of a turn besides its words.
MARKS = 4
SMALLEST_ROOM = 32
#: Character, its code.
CODES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("|", "\\p"))
END = "<|end|>\n"


def escape(x: Column) -> Column:
    return reduce(lambda c, code: F.replace(c, F.lit(code[0]), F.lit(code[1])), CODES, x)


def unescape(x: Column) -> Column:
    """Each backslash of an escaped text begins a code, so the backslash's
    own code is undone last."""
    return reduce(lambda c, code: F.replace(c, F.lit(code[1]), F.lit(code[0])), reversed(CODES), x)


def written(kind: str, role: Column, text: Column) -> Column:
    return F.concat(F.lit(f"<|{kind}|"), escape(role), F.lit("|>"), escape(text), F.lit(END))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``conv_id, window, formatted, loss``: ``loss`` lists (start, length)
    in code points of the formatted text, counted from 0."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "role", "text")
    t = t.withColumn("pos", F.row_number().over(whole)).withColumn("tokens", F.regexp_count("text", F.lit(WORD)) + MARKS)
    by_pos = Window.partitionBy("conv_id").orderBy("pos")
    system = (F.col("pos") == 1) & (F.col("role") == "system")
    before = by_pos.rowsBetween(Window.unboundedPreceding, -1)
    always = by_pos.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = (t.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
         .withColumn("system", F.first(F.when(system, F.struct("role", "text", "tokens"))).over(always)))
    room = F.greatest(F.lit(SMALLEST_ROOM), F.floor((F.lit(budget - history) - F.coalesce("system.tokens", F.lit(0))) / 2))
    t = t.withColumn("place", F.floor(F.col("start") / room)).withColumn("long", F.col("tokens") > room)
    opens = (F.col("pos") == 1) | F.col("long") | F.lag("long").over(by_pos) | (F.col("place") != F.lag("place").over(by_pos))
    t = t.withColumn("opens", opens).withColumn("window", F.sum(F.col("opens").cast("long")).over(always))
    # turns of the last tokens before; only the row that opens a window uses them
    recent = Window.partitionBy("conv_id").orderBy("start").rangeBetween(-history, -1)
    old = F.collect_list(F.when(~system, written("old", F.col("role"), F.col("text")))).over(recent)
    t = t.withColumn("repeated", F.when(F.col("opens") & (F.col("window") > 1), F.concat(
        F.coalesce(written("old", F.col("system.role"), F.col("system.text")), F.lit("")), F.array_join(old, ""))).otherwise(""))
    head = F.concat(F.col("repeated"), F.lit("<|new|"), escape(F.col("role")), F.lit("|>"))
    t = (t.withColumn("piece", F.concat(F.col("repeated"), written("new", F.col("role"), F.col("text"))))
         .withColumn("at", F.char_length(head)).withColumn("size", F.char_length(escape(F.col("text")))))
    inside = Window.partitionBy("conv_id", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("at", F.col("at") + F.coalesce(F.sum(F.char_length("piece")).over(inside), F.lit(0)))
    lost = F.when(F.col("role") == "assistant", F.struct(F.col("at").cast("long").alias("start"), F.col("size").cast("long").alias("length")))
    return (t.groupBy("conv_id", "window")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("pieces"), F.sort_array(F.collect_list(lost)).alias("loss"))
            .select("conv_id", "window", F.array_join(F.col("pieces.piece"), "").alias("formatted"), "loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the formatted windows alone: ``n_turns``, the
    digest of its turns, and length and digest of what the loss mask covers."""
    segments = F.filter(F.split("formatted", F.lit(r"<\|end\|>\n")), lambda s: F.startswith(s, F.lit("<|new|")))
    said = F.transform(segments, lambda s: F.concat(
        unescape(F.substring_index(F.substr(s, F.lit(len("<|new|") + 1)), "|>", 1)), F.lit("\n"),
        unescape(F.substr(s, F.locate("|>", s) + 2)), F.lit("\n")))
    learned = F.transform("loss", lambda m: unescape(F.substr(
        F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    w = windows.select("conv_id", "window", F.size(segments).alias("n"), F.array_join(said, "").alias("said"),
                       F.array_join(learned, "").alias("learned"), F.char_length("formatted").alias("chars"))
    c = w.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
                                 F.sort_array(F.collect_list(F.struct("window", "said", "learned"))).alias("w"))
    said, learned = F.array_join(F.col("w.said"), ""), F.array_join(F.col("w.learned"), "")
    return c.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                    F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
                    F.col("formatted_chars").cast("long").alias("formatted_chars"))


#: A conversation whose texts hold the control strings of a common template.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def with_control_case(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -7, which says control strings."""
    case = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(case)
