"""Fingerprints, chat formatting, quality, pipeline, catalog."""

import collections
import hashlib
import random
import zlib

import pytest

from brute import grouped
from llm_cases import docs, docs_rows, make  # noqa: F401  (fixtures)
from conftest import SF_SMALL

import corpus_pipeline
from tillpoint.llm import catalog
from tillpoint.llm.chat import escape, format_windows, read_back, unescape, with_control_case
from tillpoint.llm.fingerprints import fingerprint_report, fingerprints, within_radius
from tillpoint.llm.mixing import mix
from tillpoint.llm.quality import featurised, fit, passing, scored


def differing(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def test_fingerprint_report_is_brute_force(docs, docs_rows):
    rows = sorted(((i, t or "") for i, t, _ in docs_rows))
    got = {r.doc_id: r for r in fingerprint_report(docs, every=20).collect()}
    assert len(got) == len(rows)
    prints = {i: r.fingerprint for i, r in got.items()}
    by_text = {}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)]
        tail = len(t) // 4
        edited = t[:len(t) - tail] + following[1][:tail]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_next - (1 - differing(prints[i], prints[following[0]]) / 128)) < 1e-12
        assert abs(r.near_edited - (1 - differing(prints[i], r.edited_fingerprint) / 128)) < 1e-12
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        near = sum(differing(prints[i], p) <= 3 for p in prints.values()) - 1
        assert r.n_near == (near if i % 20 == 0 else None)


def test_fingerprints_of_few_rows(make):
    alone = fingerprint_report(make([(5, "just one text", "a")])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert fingerprint_report(make([])).count() == 0
    rows = [(None, "x y", "a"), (None, None, "a"), (1, "a b c", "a"), (1, "a b c", "a")]
    assert len(fingerprint_report(make(rows)).collect()) == 4


@pytest.mark.parametrize("radius", [0, 1, 3, 10])
def test_block_tables_find_all_within_the_radius(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(12)]
    every = [b ^ sum(1 << k for k in rng.sample(range(128), rng.randint(0, 14))) for b in base for _ in range(12)]
    signed = [tuple((x >> s & (1 << 64) - 1) - ((x >> s & 1 << 63) << 1) for s in (0, 64)) for x in every]
    df = spark.createDataFrame(signed, "f1 long, f2 long")
    got = {(r.q1, r.q2): r.n_near for r in within_radius(df, df, radius).collect()}
    assert got == {s: sum(bin(x ^ y).count("1") <= radius for y in every) for s, x in zip(signed, every)}


@pytest.mark.parametrize("radius, blocks", [(23, 8), (10, 3), (11, 5), (4, 4), (3, 8)])
def test_wide_blocks_find_all_within_the_radius(spark, radius, blocks):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(8)]
    every = [b ^ sum(1 << k for k in rng.sample(range(128), rng.randint(0, 20))) for b in base for _ in range(12)]
    signed = [tuple((x >> s & (1 << 64) - 1) - ((x >> s & 1 << 63) << 1) for s in (0, 64)) for x in every]
    df = spark.createDataFrame(signed, "f1 long, f2 long")
    got = {(r.q1, r.q2): r.n_near for r in within_radius(df, df, radius, blocks).collect()}
    assert got == {s: sum(bin(x ^ y).count("1") <= radius for y in every) for s, x in zip(signed, every)}


def test_registered_radius_finds_near_copies(spark, tmp_path):
    """A document with a few words changed counts as near."""
    from tillpoint.llm.catalog import queries
    rng = random.Random(9)
    rows = []
    for k in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((100 * k, " ".join(words)))
        for j in rng.sample(range(200), 5):
            words[j] = "other"
        rows.append((100 * k + 1, " ".join(words)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_near for r in queries()["op6_fingerprints"](spark, str(tmp_path)).collect()}
    assert [got[100 * k] for k in range(30)] == [1] * 30


def test_native_plans(docs, spark):
    for df in (fingerprints(docs), read_back(format_windows(with_control_case(spark, conversations(spark))))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def turns():
    rng = random.Random(9)
    rows = []
    for c in range(25):
        if c % 3:
            rows.append((c, 0, "system", "Be [brief] <|now|> \\e \\l " * rng.randint(0, 20)))
        for k in range(1, rng.choice((1, 2, 9, 60))):
            rows.append((c, k, "user" if k % 2 else "assistant", " ".join(["wörd|"] * rng.choice((0, 1, 30, 200, 700)))))
    return rows + [(90, 1, None, None), (91, None, "assistant", "x"), (91, 5, "user", "y"), (None, 0, "assistant", "z"),
                   (92, 1, "a|>b\n", "<|end|>\n<|new|user|>"), (93, 2, "assistant", "same"), (93, 2, "assistant", "same")]


def conversations(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in turns()], "conv_id long, turn long, role string, text string, window string, at int").repartition(3)


def test_chat_reads_back(spark):
    by = collections.defaultdict(list)
    for c, k, r, t in turns() + [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        by[c].append((k is None, k or 0, r or "", t or ""))
    got = {r.conv_id: r for r in read_back(format_windows(with_control_case(spark, conversations(spark)))).collect()}
    assert set(got) == set(by)
    for c, rows in by.items():
        rows.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in rows)
        learned = "".join(t for _, _, r, t in rows if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(rows), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_chat_windows_keep_their_budget(spark):
    budget, history = 300, 60
    windows = format_windows(conversations(spark), budget, history).collect()
    longest = collections.Counter()
    for r in windows:
        parts = r.formatted.split("<|end|>\n")[:-1]
        tokens = [len(p.split("|>", 1)[1].split()) + 4 for p in parts]
        new = [p.startswith("<|new|") for p in parts]
        assert any(new) and new == sorted(new)
        if r.window > 1:
            system = parts[0].startswith("<|old|system|>")
            assert sum(t for t, n in zip(tokens[system:], new[system:]) if not n) <= history
            assert sum(tokens) <= budget or sum(new) == 1 or system and tokens[0] > budget / 2
        for m in r.loss:
            assert r.formatted[:m.start].endswith("|assistant|>") and r.formatted[m.start + m.length:].startswith("<|end|>")
            assert r.formatted[:m.start].rsplit("<|", 1)[1].startswith("new|")
        longest[r.conv_id] = max(longest[r.conv_id], r.window)
    assert max(longest.values()) > 3


def test_escaping_is_reversible(spark):
    from pyspark.sql import functions as F
    rng = random.Random(0)
    texts = ["".join(rng.choice("\\<[|>elbp\n é") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    for t, e, u in spark.createDataFrame([(t,) for t in texts], "t string").select(
            "t", escape(F.col("t")), unescape(escape(F.col("t")))).collect():
        assert t == u and not set("<[|") & set(e)


def test_chat_of_an_empty_table(spark):
    assert format_windows(conversations(spark).limit(0)).count() == 0


def quality_rows():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for k in range(400):
        words = [word() for _ in range(rng.randint(20, 80))]
        bad = k % 4 == 0
        if bad and k % 8 == 0:
            words = [w.upper() + "!!" for w in words]
        elif bad:
            words = [words[0]] * len(words)
        rows.append((k, " ".join(words).capitalize() + "." if not bad else " ".join(words), rng.choice("ab")))
        labels.append((k, 0 if bad else 1, 0))
    return rows, labels


def test_quality_on_held_out_documents(spark, make):
    rows, labels = quality_rows()
    lab = spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0), (99_999, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    feats = featurised(make(rows + [(None, None, None), (1000, "", "a")]))
    got = scored(feats, fit(feats, lab)).collect()
    assert len(got) == 402
    right = [r.predicted == dict((k, q) for k, q, _ in labels)[r.doc_id] for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(right) > 50 and sum(right) >= 0.97 * len(right)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_quality_uses_no_held_out_label(spark, make):
    rows, labels = quality_rows()
    flipped = [(k, 1 - q if zlib.crc32(str(k).encode()) % 5 == 0 else q, t) for k, q, t in labels]
    feats = featurised(make(rows))
    schema = "doc_id long, quality int, toxic int"
    one, two = (fit(feats, spark.createDataFrame(x, schema)) for x in (labels, flipped))
    assert (one.weights == two.weights).all() and one.cut == two.cut


def test_quality_threshold_from_all_labels(spark, make):
    """Centre, scale and threshold cover the rows that the fit sample leaves out."""
    import numpy as np
    rows, labels = quality_rows()
    feats = featurised(make(rows))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = fit(feats, lab, sample=40)
    every = {r.doc_id: np.array(r.feats) for r in feats.collect()}
    x = np.array(list(every.values()))
    assert np.allclose(model.center, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-3), atol=1e-6)
    raw = {i: float((f - model.center) / model.scale @ model.weights) for i, f in every.items()}
    told = [(raw[k], q) for k, q, _ in labels if k in raw and q in (0, 1) and zlib.crc32(str(k).encode()) % 5]

    def wrong(cut):
        return sum((r >= cut) != q for r, q in told)
    assert wrong(model.cut) <= min(wrong(r) for r, _ in told) + 1
    good = sorted(r for r, q in told if q)
    bad = sorted(r for r, q in told if not q)
    spread = good[len(good) // 2] - bad[len(bad) // 2]
    assert abs(8 / model.slope - spread) < 0.05 * abs(spread)


def test_quality_without_labels(spark, make):
    feats = featurised(make([(1, "a", "b")]))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in scored(feats, fit(feats, none)).collect()] == [0.5]
    empty = featurised(make([]))
    assert scored(empty, fit(empty, none)).count() == 0
    assert passing(make([]), fit(empty, none)).count() == 0


def test_pipeline_stages(spark, docs, docs_rows):
    """Each stage on the odd documents: columns stay, and what it decides holds."""
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF_SMALL).checkpoint()
        assert at.columns == docs.columns, name
        assert at.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, at, SF_SMALL).count() >= at.count()
    for name, stage in corpus_pipeline.STAGES:
        if name != "near_dedup":  # test_dedup.py has its empty table
            assert stage(spark, docs.limit(0), SF_SMALL).count() == 0, name


def test_mixture_repeats_rows_on_a_small_plan(spark, make):
    """A row for each copy, and no join or filter that holds the formula of the copies."""
    docs = make([(k, "word " * (10 + k % 50), "abc"[(k >= 100) + (k >= 120)]) for k in range(200)])
    taken = {r.kept.doc_id: r.copies for r in mix(docs, keep=tuple(docs.columns)).collect()}
    out = corpus_pipeline.mixture(spark, docs, SF_SMALL)
    assert 0 in taken.values() and max(taken.values()) > 1
    assert collections.Counter(r.doc_id for r in out.collect()) == collections.Counter(taken)  # a count of 0 equals none
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_run_applies_the_stages_in_order(spark, monkeypatch):
    calls = []

    def stage(name):
        def run(spark, docs, sf_dir):
            calls.append((name, docs.columns, sf_dir))
            return docs
        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage(n) for n, _ in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert [c[0] for c in calls] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    assert {c[2] for c in calls} == {SF_SMALL} and out.columns == calls[0][1]


def test_catalog_names_every_operator():
    names = catalog.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(catalog.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
