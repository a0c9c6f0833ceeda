"""Ranked search against plain scoring."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from brute import grouped, key
from llm_cases import CLASHING, docs, docs_rows, make, sentence  # noqa: F401  (fixtures)
from tillpoint.llm import search as module
from tillpoint.llm.search import Best, Chunk, Postings, lists_of, search, search_chunk, terms_of

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranks(docs, items, k):
    held = [(i, collections.Counter(plain_terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    asks = collections.defaultdict(set)
    for item, text in items:
        asks[item] |= set(plain_terms(text))
    for item, terms in asks.items():
        found = []
        for i, c in held:
            m = 10 + 90 * c.total() * n_docs // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, key(i)))
        for rank, (s, i) in enumerate(sorted(found)[:k], 1):
            yield (item, rank, None if i == math.inf else i, -s)


def items_of(docs_rows):
    texts = [t for _, t, _ in docs_rows if t]
    items = [(j, " ".join(t.split()[:25])) for j, t in enumerate(texts)]
    return items + [(900, None), (901, ""), (902, "?! ."), (903, "absent words"), (904, "ALPHA1 alpha1 Alpha1"), (905, "aa"), (905, "été7 one"),
                    (None, "two WORDS"), (906, "x" * 5000), (907, texts[4])]


def items_frame(spark, items):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in items], "item_id long, text string, term string, doc_id string, bit int").repartition(3)


@pytest.mark.parametrize("k, chunk, short, bits", [(10, 16 << 20, 32, 10), (10, 1, 4, 2), (3, 4000, 2, 1), (1000, 1, 10**9, 3), (10, 1, 0, 2)])
def test_search_is_brute_force(spark, docs, docs_rows, monkeypatch, k, chunk, short, bits):
    monkeypatch.setattr(module, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(module, "SHORT", short)
    monkeypatch.setattr(module, "WINDOW_BITS", bits)
    monkeypatch.setattr(module, "ITEMS_AT_ONCE", 20)
    items = items_of(docs_rows)
    got = search(docs, items_frame(spark, items), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert grouped(tuple(r) for r in got.collect()) == grouped(plain_ranks([r[:2] for r in docs_rows], items, k))


def test_search_ties_nulls_and_repeats(spark, make):
    rows = [(i, "same words here", "a") for i in (7, 7, 3, None, 12)] + [(50 + i, f"other text {i}", "b") for i in range(30)] + [(99, None, "c")]
    items = [(0, "words"), (0, "text"), (1, "here same"), (2, "other 3")]
    got = search(make(rows), items_frame(spark, items), 4)
    assert grouped(tuple(r) for r in got.collect()) == grouped(plain_ranks([r[:2] for r in rows], items, 4))


def test_search_empty_tables(spark, make):
    some = items_frame(spark, [(1, "words")])
    assert search(make([]), some).count() == 0
    assert search(make([(1, None, "a"), (2, "..", "a")]), some).count() == 0
    assert search(make([(1, "words", "a")]), items_frame(spark, [])).count() == 0


def made_chunk(texts):
    w = terms_of(pa.array(texts))
    keys, tf = np.unique(w.code * len(texts) + w.doc, return_counts=True)
    code, place = np.divmod(keys, len(texts))
    lists, sizes = np.unique(code, return_counts=True)
    return Chunk(np.arange(len(texts)), np.diff(w.off), w.vocab.take(pa.array(lists)).to_pylist(), sizes, place, tf, len(texts), len(w.code))


def test_short_lists_become_one_list():
    rng = random.Random(1)
    chunk = made_chunk([f"common w{rng.randrange(60)} w{rng.randrange(60)}" for _ in range(200)])
    lists = lists_of(chunk, [("common", 5), *((f"w{i}", 100 + i) for i in range(20))])
    holding = sum(chunk.size(chunk.number[f"w{i}"]) * module.SHORT > chunk.rows for i in range(20) if f"w{i}" in chunk.number)
    assert len(lists) == 2 + holding and len(lists[0].places) > 20
    assert (np.diff(lists[0].places) > 0).all()


def test_windows_below_the_floor_are_skipped(monkeypatch):
    """Later documents hold the common term alone and cannot reach the floor."""
    seen = []
    real = Postings.window
    monkeypatch.setattr(Postings, "window", lambda self, w: seen.append(w) or real(self, w))
    chunk = made_chunk([f"rare common pad{i}" for i in range(20)] + [f"common pad{i}" for i in range(5000)])
    best = Best(10)
    search_chunk(chunk, [("rare", 5000), ("common", 10)], best)
    assert set(seen) == {0} and best.ids.tolist() == list(range(10))


def test_weak_lists_are_only_probed():
    """With a floor, documents of the common term alone are never scored."""
    chunk = made_chunk([("rare common" if i % 50 == 0 else "common") + f" pad{i}" for i in range(1000)])
    lists = lists_of(chunk, [("rare", 5000), ("common", 10)])
    top = max(int(x.bounds.max()) for x in lists)
    at, s = module.search_window(lists, 0, top)
    assert set(at.tolist()) <= set(range(0, 1000, 50)) and len(at) and (s >= top).all()
