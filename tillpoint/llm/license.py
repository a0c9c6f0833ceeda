"""License scans by ordered signature rules (operator 11), DataFrame
functions only.

``license_rules.py`` holds a few hundred patterns, each with literal keywords,
a priority and a confidence.  A text is searched only by rules whose keywords
it contains, and most texts contain none of the stems that every rule's
keywords share.  All places of a rule's pattern count; they come from the
lengths of what the pattern matches and of what stands between.

Overlapping detections are resolved by containment: a detection goes if its
interval lies within that of one with a stronger priority, or within a longer
one of the same priority, or if an earlier rule of the same priority found the
same interval.  In the order of start, descending end, priority and rule all
that can contain a detection come before it, so one pass with the furthest end
of each priority decides.  The scan of a document is one projection: nothing
is shuffled and texts do not travel.

The base phrases of the contract are found in the same way, but count
whatever else contains them.

Defined results: a null text is empty; texts without a detection have empty
labels and score 0; labels are distinct and sorted; repeated rows and null ids
are rows like any other; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import NOTICE, PRIORITIES, SEPARATOR, STEMS, WORD_CHARACTER, rules

#: Phrase, label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
RULE = "struct<order:int,label:string,priority:int,confidence:double,regex:string>"


def rule_table() -> Column:
    """The rules by their keywords, as one literal."""
    found = sorted(rules(), key=lambda r: (r.keys, r.order))
    families = [{"keys": list(keys), "rules": [{k: getattr(r, k) for k in ("order", "label", "priority", "confidence", "regex")} for r in of]}
                for keys, of in groupby(found, key=lambda r: r.keys)]
    return F.from_json(F.lit(json.dumps(families)), f"array<struct<keys:array<string>,rules:array<{RULE}>>>")


def phrase_regex(phrase: str) -> str:
    return rf"(?i)(?<!{WORD_CHARACTER}){f'[{SEPARATOR}]+'.join(phrase.split())}(?!{WORD_CHARACTER})"


def count_words(text: Column) -> Column:
    """Words of a text; splitting at gaps costs a small part of what taking
    out every word costs."""
    return F.size(F.array_remove(F.split(text, f"[{SEPARATOR}]+"), "")).cast("long")


def places(text: Column, regex: Column) -> Column:
    """``array<struct<start,end>>``: all matches, in code points."""
    matches = F.regexp_extract_all(text, regex, F.lit(0))
    between = F.split(text, regex, -1)
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda b, m: F.struct(F.char_length(b).alias("skip"), F.char_length(m).alias("size")))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def walk(acc, s):
        start = acc["at"] + s["skip"]
        return F.struct((start + s["size"]).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + s["size"]).alias("end")))).alias("out"))

    return F.when(F.size(matches) == 0, none).otherwise(
        F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), walk, lambda acc: acc["out"]))


def kept(found: Column) -> Column:
    """Detections that no other contains; ``found`` in order."""
    none = F.array().cast("array<struct<start:int,back:int,priority:int,order:int,label:string,confidence:double,end:int>>")
    ends = F.array(*[F.lit(-1)] * PRIORITIES)

    def sweep(acc, d):
        inside = F.array_max(F.slice(acc["ends"], F.lit(1), d["priority"])) >= d["end"]
        return F.struct(F.transform(acc["ends"], lambda e, i: F.when(i + 1 == d["priority"], F.greatest(e, d["end"])).otherwise(e)).alias("ends"),
                        F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(d))).alias("out"))

    return F.aggregate(found, F.struct(ends.alias("ends"), none.alias("out")), sweep, lambda acc: acc["out"])


def contains_any(low: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def license_scan(docs: DataFrame) -> DataFrame:
    """``doc_id, text, base, detections``: places of the base phrases
    (``label, start, end``) and the kept detections (``label, start, end,
    priority, confidence, rule``), in code points of the text."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("low", F.lower("text"))
    text, low = F.col("text"), F.col("low")

    def detected(rule):
        return F.transform(places(text, rule["regex"]), lambda p: F.struct(
            p["start"].alias("start"), (-p["end"]).alias("back"), rule["priority"].alias("priority"), rule["order"].alias("order"),
            rule["label"].alias("label"), rule["confidence"].alias("confidence"), p["end"].alias("end")))

    asked = F.filter(rule_table(), lambda f: F.forall(f["keys"], lambda k: F.contains(low, k)))
    found = F.flatten(F.transform(F.flatten(F.transform(asked, lambda f: f["rules"])), detected))
    detections = F.when(contains_any(low, STEMS), F.transform(kept(F.array_sort(found)), lambda x: F.struct(
        x["label"].alias("label"), x["start"].alias("start"), x["end"].alias("end"), x["priority"].alias("priority"),
        x["confidence"].alias("confidence"), x["order"].alias("rule"))))

    def phrase(words: str, label: str) -> Column:
        first, last = words.split()[-2:]
        return F.when(F.contains(low, F.lit(first)) & F.contains(low, F.lit(last)), F.transform(
            places(text, F.lit(phrase_regex(words))), lambda p: F.struct(F.lit(label).alias("label"), p["start"].alias("start"), p["end"].alias("end"))))

    def empty(kind: str) -> Column:
        return F.array().cast(f"array<struct<{kind}>>")

    base = "label:string,start:int,end:int"
    return d.select(
        "doc_id", "text", F.concat(*[F.coalesce(phrase(*p), empty(base)) for p in PHRASES]).alias("base"),
        F.coalesce(detections, empty(base + ",priority:int,confidence:double,rule:int")).alias("detections"))


def license_report(scan: DataFrame) -> DataFrame:
    """Per document of :func:`license_scan`: its words, base places and labels."""
    def word_at(start: Column) -> Column:
        return F.when(F.size("base") > 0, count_words(F.left(F.col("text"), start)))

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    base, found = F.transform("base", lambda b: b["label"]), F.transform("detections", lambda x: x["label"])
    sure = F.when(F.size("base") > 0, F.lit(NOTICE[1])).otherwise(F.lit(0.0))
    return scan.select(
        "doc_id", count_words(F.col("text")).alias("n_words"), F.size("base").cast("long").alias("n_base"),
        word_at(F.array_min(F.transform("base", lambda b: b["start"]))).alias("first_word"),
        word_at(F.array_max(F.transform("base", lambda b: b["start"]))).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, found)).alias("labels"),
        F.greatest(sure, F.coalesce(F.array_max(F.transform("detections", lambda x: x["confidence"])), F.lit(0.0))).alias("score"))
