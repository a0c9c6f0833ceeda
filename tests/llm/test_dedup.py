"""Substring, phrase, line and near dedup against plain versions."""

import hashlib
import random

import pytest

from brute import grouped, near_rows, phrase_rows, substring_rows
from llm_cases import docs, docs_rows, make  # noqa: F401  (fixtures)
from tillpoint.llm import near_dedup as nd
from tillpoint.llm.line_dedup import chunk_ends, chunks, line_dedup, without_repeated_lines
from tillpoint.llm.near_dedup import estimate, near_dedup, one_of_each_group, sketch
from tillpoint.llm.phrase_dedup import phrase_dedup
from tillpoint.llm.suffix_dedup import suffix_dedup

REPEATED = [(3, "one", "z"), (7, None, "z"), (None, "alone without an id " * 30, "z"), (None, "alone without an id " * 30, "z")]


def plain(df):
    return grouped(tuple(r) for r in df.collect())


@pytest.mark.parametrize("length", [50, 24, 33])
def test_suffix_dedup_is_brute_force(docs, docs_rows, length):
    assert plain(suffix_dedup(docs, length)) == grouped(substring_rows([(i, t) for i, t, _ in docs_rows], length))


@pytest.mark.parametrize("length, gram", [(13, 6), (5, 5), (2, 1)])
def test_phrase_dedup_is_brute_force(docs, docs_rows, length, gram):
    assert plain(phrase_dedup(docs, length, gram)) == grouped(phrase_rows([(i, t) for i, t, _ in docs_rows], length))


def test_repeated_rows_and_null_ids(make, docs_rows):
    rows = docs_rows + REPEATED
    pairs = [(i, t) for i, t, _ in rows]
    assert plain(suffix_dedup(make(rows))) == grouped(substring_rows(pairs, 50))
    assert plain(phrase_dedup(make(rows))) == grouped(phrase_rows(pairs, 13))


def test_kept_texts(docs):
    for r in suffix_dedup(docs, with_kept=True).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed
    for r in phrase_dedup(docs, with_kept=True).collect():
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 and len(r.kept.split()) == r.n_words - r.n_removed


def test_letters_of_the_automaton():
    import numpy as np
    from tillpoint.llm.phrase_dedup import locate
    code = np.array([-1, 3, 1, 4, 1, 5, -1, 1, 4, 1, 5, 9, 2, 6, -1, 4, 1])
    for letters in (1000, 4, 2):
        assert sorted(locate(code, np.array([2, 3]), 3, letters).tolist()) == [2, 3, 7, 8]


def test_line_dedup_is_brute_force(docs, docs_rows):
    first = {}
    split = {i: chunks(None if t is None else t.encode()) for i, t, _ in docs_rows}
    for i in sorted(split):
        lines, ends = split[i]
        for a, b in zip([0, *ends[:-1]], ends):
            if b - a > 1:
                first.setdefault(b"\n".join(lines[a:b]), (i, a))
    expected, texts = set(), {}
    for i, (lines, ends) in split.items():
        kept, cut = [], 0
        for a, b in zip([0, *ends[:-1]], ends):
            if b - a > 1 and first[b"\n".join(lines[a:b])] < (i, a):
                cut += 1
            else:
                kept += lines[a:b]
        texts[i] = b"\n".join(kept).decode()
        expected.add((i, len(lines), len(lines) - len(kept), len(ends), cut, hashlib.sha256(texts[i].encode()).hexdigest()))
    assert {tuple(r) for r in line_dedup(docs).collect()} == expected
    assert any(r[4] for r in expected)
    rest = without_repeated_lines(docs)
    assert rest.schema == docs.schema
    for r in rest.collect():
        assert r.text == (None if r.doc_id == 1 else texts[r.doc_id]) and r.n_chars == (None if r.text is None else len(r.text))
        assert r.bucket == r.kept == "x"


def repeated_pairs(pairs):
    """Lines of (doc_id, text) that a pair of neighbouring lines covers whose
    first place ends before it; one list of flags per document."""
    split = [(i, [] if t is None else t.split("\n")) for i, t in pairs]
    first = {}
    for i, lines in split:
        for a in range(len(lines) - 1):
            w = (lines[a], lines[a + 1])
            first[w] = min(first.get(w, (i, a)), (i, a))
    out = {}
    for i, lines in split:
        gone = [False] * len(lines)
        for a in range(len(lines) - 1):
            j, b = first[lines[a], lines[a + 1]]
            if j < i or j == i and b + 2 <= a:
                gone[a] = gone[a + 1] = True
        out[i] = (lines, gone)
    return out


def test_all_repeated_runs_of_lines_go(make, docs_rows):
    """Runs of any length from two lines on, wherever chunks end."""
    rows = docs_rows + [(500 + k, "\n".join([f"own {k}", "a", "b", "c", "d", "e"][:3 + k % 4] + [f"tail {k}"]), "h") for k in range(12)]
    rows += [(600, "x\nx\nx\nx\nx", "h"), (601, "y\ny\ny", "h"), (602, "p\nq\np\nq\np", "h"), (603, "q\np", "h")]
    expected = repeated_pairs([(i, t) for i, t, _ in rows])
    texts = {i: "\n".join(x for x, g in zip(*v) if not g) for i, v in expected.items()}
    df = make(rows)
    got = {r.doc_id: r for r in line_dedup(df, edges=True).collect()}
    assert {i: (r.n_lines, r.n_removed, r.kept_sha256) for i, r in got.items()} == {
        i: (len(lines), sum(gone), hashlib.sha256(texts[i].encode()).hexdigest()) for i, (lines, gone) in expected.items()}
    assert got[16].n_removed == 30 and got[505].n_removed == 3 and got[600].n_removed == 3 and got[601].n_removed == 0
    for r in without_repeated_lines(df, edges=True).collect():
        assert r.text == (None if r.doc_id == 1 else texts[r.doc_id]) and r.bucket == r.kept == "x"


def test_registered_query_takes_whole_runs(spark):
    from tillpoint.llm.catalog import queries
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    expected = {i: sum(gone) for i, (_, gone) in repeated_pairs(docs).items()}
    assert {r.doc_id: r.n_removed for r in queries()["op10_line_dedup"](spark, sf_dir).collect()} == expected


def test_chunk_boundaries_resist_shifts():
    import random
    rng = random.Random(2)
    hashes = [rng.getrandbits(64) for _ in range(400)]
    a = set(chunk_ends(hashes))
    b = {e - 3 for e in chunk_ends([1, 2, 3] + hashes)}
    assert len(a & b) > 0.9 * len(a)


def chained():
    """A chain whose neighbours are alike but whose ends are not, one that
    moves by less, and many that are alike, but not enough."""
    words = [f"w{k}" for k in range(400)]
    rows = [(1000 + k, " ".join(words[8 * k:8 * k + 100]), "s") for k in range(20)]
    rows += [(2000 + (k * 7) % 40, " ".join(f"x{w}" for w in words[5 * k:5 * k + 100]), "s") for k in range(40)]
    return rows + [(3000 + k, " ".join(words[300:360] + [f"v{k}_{j}" for j in range(40)]), "s") for k in range(30)]


def test_near_dedup_is_brute_force(make, docs_rows, monkeypatch):
    monkeypatch.setattr(nd, "FANOUT", 3)
    rows = docs_rows + chained()
    assert plain(near_dedup(make(rows))) == grouped(near_rows([(i, t) for i, t, _ in rows], 2))


def test_all_left_pairs_are_compared(make, monkeypatch):
    """Without any round of hubs, the exhaustive one finds every component."""
    monkeypatch.setattr(nd, "PARTNERS", (0,))
    rows = chained()
    assert plain(near_dedup(make(rows), 1)) == grouped(near_rows([(i, t) for i, t, _ in rows], 1))


def edited(rng, words, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words)


def test_a_dense_group_around_the_threshold(make):
    """Copies edited so far that most pairs lie between 0.6 and 0.85."""
    rng = random.Random(21)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(i, edited(rng, base, rng.choice((0.02, 0.05, 0.08, 0.12))), "a") for i in range(90)]
    want = grouped(near_rows([(i, t) for i, t, _ in rows], 2))
    assert plain(near_dedup(make(rows))) == want
    assert 5 < len({r[2] for r in want}) < 85


@pytest.mark.parametrize("partners", [(4, 8), (0,)])
def test_pairs_around_a_pivot_lose_no_link(make, docs_rows, monkeypatch, partners):
    """With pivots of few nodes, all that the hubs leave goes by its differences."""
    monkeypatch.setattr(nd, "DENSE", 3)
    monkeypatch.setattr(nd, "PARTNERS", partners)
    rng = random.Random(22)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    other = base[:100] + [f"o{k}" for k in range(50)]  # not similar to the base, but copies of it are to one another
    rows = docs_rows + chained() + [(5000 + i, edited(rng, base if i % 3 else other, rng.choice((0.02, 0.05, 0.08, 0.12))), "a") for i in range(120)]
    assert plain(near_dedup(make(rows))) == grouped(near_rows([(i, t) for i, t, _ in rows], 2))


def test_far_nodes_do_not_meet_a_whole_group(make, monkeypatch):
    """Texts without a partner, in a group around one text: few of their pairs are compared."""
    rng = random.Random(23)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(0, " ".join(base), "a")] + [(i, edited(rng, base, 0.02 if i % 4 else 0.13), "a") for i in range(1, 241)]
    pairs, grid = [], nd.written

    def noted(df):
        out = grid(df)
        if out.columns == ["hub", "node"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(nd, "written", noted)
    got = plain(near_dedup(make(rows)))
    assert got == grouped(near_rows([(i, t) for i, t, _ in rows], 2))
    alone = sum(r[2] == r[0] for r in got)
    assert alone > 30 and pairs[-1] < alone * 240 / 20


def test_rows_of_one_id_and_without_an_id(make):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(5, text, "a"), (5, text + " more", "a"), (5, "aaa first of its id", "a"), (9, "aaa first of its id", "a"), (None, text, "a"), (None, text, "b"),
            (7, text, "c"), (7, text, "c"), (8, text, "c")]
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_shingles, r.component_id, r.kept) for r in near_dedup(make(rows)).collect())
    assert got == sorted([((False, 0), 59, None, True)] * 2 + [((True, 5), 4, 5, True), ((True, 7), 59, 7, True), ((True, 8), 59, 7, False), ((True, 9), 4, 5, False)])


def test_one_of_each_group(make, docs_rows):
    df = make(docs_rows + REPEATED)
    kept = one_of_each_group(df, 2)
    assert kept.schema == df.schema
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    expected = [i for i, _, _, k in near_rows([(i, t) for i, t, _ in docs_rows], 2) if k]
    assert grouped(ids) == grouped(expected + [None, None])


def test_estimate_follows_the_similarity():
    import numpy as np
    rng = np.random.default_rng(1)
    every = np.unique(rng.integers(0, 1 << 63, 6000, dtype=np.uint64) * np.uint64(2))
    for share in (0.2, 0.5, 0.8, 0.95):
        n = 1000
        both = int(2 * n * share / (1 + share))
        a, b = np.sort(every[:n]), np.sort(np.r_[every[:both], every[n:2 * n - both]])
        true = both / (2 * n - both)
        assert abs(estimate(sketch(a), sketch(b), n, n) - true) < 0.13


def test_empty_tables(make):
    none = make([])
    for df in (suffix_dedup(none), phrase_dedup(none), line_dedup(none), without_repeated_lines(none), one_of_each_group(none, 5)):
        assert df.count() == 0


def test_tables_of_empty_texts(make):
    rows = [(1, None, "a"), (2, "", "a"), (3, " ", None)]
    assert [r.n_removed for r in suffix_dedup(make(rows)).collect()] == [0, 0, 0]
    assert [r.n_words for r in phrase_dedup(make(rows)).collect()] == [0, 0, 0]
    assert all(r.kept and r.n_shingles == 0 and r.component_id == r.doc_id for r in near_dedup(make(rows)).collect())
