"""Top-k search, packing, mixing."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from brute import grouped, top_rows
from llm_cases import docs, docs_rows, make  # noqa: F401  (fixtures)
from tillpoint.llm.catalog import vocabulary
from tillpoint.llm.mixing import mix
from tillpoint.llm.packing import pack_documents, plan, reduce_instance
from tillpoint.llm.topk import integer_vectors, search_chunk, top_k


def vectors():
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 0.2) + (0.5 if k % 3 == d else 0) for d in range(8)]) for k in range(230)]
    rows += [(300 + k, [0.25] * 8) for k in range(60)]  # ties
    rows += [(400, None), (401, [0.1, None] + [0.0] * 6), (450, [float("nan")] * 8), (451, [float("inf")] * 8), (500, []), (550, [0.5, -0.5]),
             (600, [1e9] * 8), (-50, [0.3] * 8), (None, [9.0] * 8)]
    return rows


@pytest.mark.parametrize("chunk, k", [(8192, 5), (40, 5), (7, 3), (50, 1000)])
def test_top_k_is_brute_force(spark, chunk, k):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors()], "vec_id long, embedding array<double>, part string, v int").repartition(3)
    got = top_k(integer_vectors(df), k, 50, chunk, pivots=5)
    assert grouped(tuple(r) for r in got.collect()) == grouped(top_rows(vectors(), k, 50))


def test_top_k_edge_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert top_k(integer_vectors(spark.createDataFrame([], schema))).count() == 0
    assert top_k(integer_vectors(spark.createDataFrame([(0, [1.0])], schema))).count() == 0
    twice = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [0.5])], schema)
    assert [tuple(r) for r in top_k(integer_vectors(twice)).collect()] == [(0, 1, 1, 256 * 128)]


def test_bounds_prune_blocks():
    """A block whose bound is below the k-th best score is not scored."""
    ids = np.arange(1, 513)
    v = np.repeat(np.array([[100, 0], [1, 0], [2, 0], [0, 1]]), 128, axis=0)
    cuts = np.arange(0, 512, 128)
    seen = []
    real = v.__class__

    class Watched(real):
        def __getitem__(self, key):
            if isinstance(key, slice):
                seen.append(key.start // 128)
            return super().__getitem__(key)

    found = list(search_chunk(np.array([0]), np.array([[10, 0]]), np.array([np.iinfo(np.int64).min]), ids, v.view(Watched),
                              np.maximum.reduceat(v, cuts), np.minimum.reduceat(v, cuts), 5))
    assert seen == [0] and found[0][1].tolist() == [1000] * 5 and found[0][2].tolist() == [1, 2, 3, 4, 5]


def rooms_of_plain_best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - x)
    return len(rooms)


def least_bins(lengths, capacity):
    """Exact, for few pieces."""
    best = [len(lengths)]

    def go(rest, rooms):
        if len(rooms) >= best[0]:
            return
        if not rest:
            best[0] = len(rooms)
            return
        x = rest[0]
        for r in set(rooms):
            if r >= x:
                i = rooms.index(r)
                go(rest[1:], rooms[:i] + [r - x] + rooms[i + 1:])
        go(rest[1:], rooms + [capacity - x])

    go(sorted(lengths, reverse=True), [])
    return best[0]


def test_plan_places_every_piece_once():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice((10, 20, 50, 100))
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 150))]
        count = collections.Counter(lengths)
        bins = collections.defaultdict(list)
        for length, segments in plan(count, capacity).items():
            for i in range(count[length]):
                lo, per, first, offset = [s for s in segments if s[0] <= i][-1]
                bins[first + (i - lo) // per].append((offset + (i - lo) % per * length, length))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= capacity
        assert sum(map(len, bins.values())) == len(lengths)
        assert len(bins) <= rooms_of_plain_best_fit(lengths, capacity)


def test_reduction_keeps_an_optimum():
    """Fixed sets and an optimal packing of the rest need as few sequences as
    an optimal packing of all."""
    rng = random.Random(7)
    for _ in range(150):
        capacity = rng.choice((10, 15, 24))
        lengths = [rng.randint(2, capacity) for _ in range(rng.randint(1, 8))]
        count = dict(collections.Counter(lengths))
        fixed = sum(n for _, n in reduce_instance(count, capacity))
        rest = [x for x, n in count.items() for _ in range(n)]
        assert fixed + (least_bins(rest, capacity) if rest else 0) == least_bins(lengths, capacity)


def test_packing_round_trip(docs, docs_rows):
    from tokenizers import Tokenizer
    path = vocabulary("word_bpe_49k.json")
    full = Tokenizer.from_file(path)
    rows = pack_documents(docs, path, with_ids=True).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for i, t, _ in docs_rows:
        ids = full.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == ids
        assert [r.start for r in own] == list(range(0, len(ids), 4096))
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len(by_sequence) == math.ceil(sum(r.length for r in rows) / 4096)


def test_packing_edge_tables(make):
    path = vocabulary("word_bpe_49k.json")
    assert pack_documents(make([]), path).count() == 0
    rows = pack_documents(make([(1, None, "a"), (1, None, "a"), (None, "", "a")]), path).collect()
    assert [(r.length, r.sequence_id) for r in rows] == [(1, 0)] * 3 and sorted(r.offset for r in rows) == [0, 1, 2]


def test_tokens_of_odd_words():
    from tillpoint.llm.tokens import WordEncoder
    coder = WordEncoder(vocabulary("word_bpe_49k.json"))
    texts = ["It's o'clock, don't. U.S.A. a,b ,. .,", "ÀÉ naïve Straße İstanbul ΣΑΣ ﬁ ſ", "e\u0301 \u0301x ½ Ⅻ 1234 a1b2 ##@! \u00a0x\u2003y",
             "<|endoftext|> x<|startoftext|>y <|end", "x" * 5000 + " " + "é" * 500, "日本語 テスト 😀😀 \x00 \x85z", "word. word, WORD. Word,,", ""]
    got = list(coder.ids(pa.array(texts + [None])))
    assert len(got) == len(texts) + 1 and len(got[-1]) == 0
    for text, ids in zip(texts, got):
        assert ids.tolist() == coder.full.encode(text, add_special_tokens=False).ids, text


def test_mixing_reaches_its_targets(make):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randint(0, 60)), rng.choice("aaaabcdefg") if k % 11 else None) for k in range(3000)]
    got = mix(make(rows).repartition(4)).collect()
    assert len(got) == len(rows)
    source = {k: s for k, _, s in rows}
    size = {k: len(t.split()) for k, t, _ in rows}
    total, sums, taken, target = sum(size.values()), collections.Counter(), collections.Counter(), {}
    for r in got:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        sums[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    for r in got:
        assert r.source_size == sums[source[r.doc_id]]
    names = sorted((s for s in sums if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, open_, left = {}, set(names), 1.5 * total
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sums[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2.0 * sums[s]
            left -= want[s]
        open_ -= over
    for s in names:
        assert math.isclose(target[s], want[s], rel_tol=1e-9)
        assert abs(taken[s] - want[s]) <= 30
    again = mix(make(list(reversed(rows)))).collect()
    assert grouped(tuple(r) for r in again) == grouped(tuple(r) for r in got)


def test_odds_are_unequal_and_targets_are_met(make):
    """Short documents get more copies than long ones; every source comes as
    near to its target as one document can bring it."""
    rng = random.Random(14)
    rows = [(k, " ".join(["w"] * rng.choice((20, 30, 900, 1500))), "abc"[k % 3]) for k in range(3000)]
    got = mix(make(rows)).collect()
    words, copies = collections.Counter(), collections.defaultdict(list)
    for r in got:
        words[r.target] += r.taken
        copies[r.target, r["size"] < 100].append(r.copies)
    for target, n in words.items():
        assert abs(n - target) <= 450  # half of the shortest long document, where no short one is left
        short, long = (sum(copies[target, x]) / len(copies[target, x]) for x in (True, False))
        assert short > long + 0.1 or target >= 2 * next(r.source_size for r in got if r.target == target) - 1


def test_a_long_document_does_not_end_a_sample(make):
    """A document too long for what is left is passed over, and one that
    fits takes its place."""
    rows = [(k, "w", "a") for k in range(700)] + [(10_000, " ".join(["w"] * 300), "a")] + [(20_000 + k, " ".join(["v"] * 10), "b") for k in range(30)]
    for seed in ("mix", "x", "y", "z"):
        got = mix(make(rows), seed=seed).collect()
        for target in {r.target for r in got}:
            assert abs(sum(r.taken for r in got if r.target == target) - target) <= 5


def test_mixing_edge_tables(make, docs, docs_rows):
    assert mix(make([])).count() == 0
    assert [(r["size"], r.target, r.taken) for r in mix(make([(1, None, None), (2, "", "a")])).collect()] == [(0, 0.0, 0)] * 2
    kept = mix(docs, keep=tuple(docs.columns)).select("kept.*", "taken")
    assert kept.columns == docs.columns + ["taken"] and kept.count() == len(docs_rows)
    twice = mix(make([(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s"), (None, "c", "s")])).collect()
    assert 8 <= sum(r.taken for r in twice) <= 10  # 150 % of six words, to half a document
