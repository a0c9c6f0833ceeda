"""Conversation structure repair against a plain shortest path."""

import hashlib
import itertools
import random
import zlib

import pytest

from brute import grouped
from tillpoint.llm.structure import damaged, in_order, repaired, structure_report, traces, with_faults

WHITE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    """rows: (conv, turn, role, text)."""
    out = []

    def key(r):
        tie = (" " if r[2] is None else r[2], hashlib.sha256((" " if r[3] is None else r[3]).encode()).hexdigest())
        return (r[1] is not None, r[1] or 0, tie)

    for conv, turn, role, text in sorted(rows, key=key):
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        out += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def plain_report(conv, rows):
    rows = plain_damage(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    # best[state]: (cost, audit, texts) over edits so far; states "", s, u, a
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def better(best, state, cand):
        if state not in best or cand[:2] < best[state][:2]:
            best[state] = cand
            return True
        return False

    def inserts(best):
        again = True
        while again:
            again = False
            for s in list(best):
                c, a, t = best[s]
                again |= better(best, after[s], (c + 3, a + "I", t + [name[after[s]] + ":"]))

    best = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults):
        inserts(best)
        new = {}
        for s, (c, a, t) in best.items():
            better(new, s, (c + 4, a + "D", t))
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                if role and s + role[0] in ("s", "u", "su", "ua", "au"):
                    better(new, role[:1], (c + more, a + "K", t + [role + ":" + text]))
                better(new, after[s], (c + 3 + more, a + "R", t + [name[after[s]] + ":" + text]))
        best = new
    inserts(best)
    cost, audit, texts = min(best[s] for s in ("", "a") if s in best)
    return (conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(texts).encode()).hexdigest())


def cases():
    rng = random.Random(4)
    said = ["Yes.", "No", "Why?", "", " \t\n", "Ok!\n ", "a. b", "é", "x" * 30_000 + "."]
    rows = []
    for conv in range(120):
        for turn in range(rng.randrange(1, 12)):
            if rng.random() < 0.9:
                role = rng.choice(("system", "user", "assistant", "user", "assistant", "tool", "", "User")) if conv % 3 else ("user", "assistant")[turn % 2]
                rows.append((conv, turn, role, rng.choice(said) + ("" if conv % 2 else str(rng.randrange(9)) + rng.choice(".,"))))
    rows += [(200, t, ("user", "assistant")[(t + (t > 150)) % 2], f"turn {t}" + "." * (t % 5 > 0)) for t in range(400)]  # several blocks
    rows += [(201, t, "assistant", "") for t in range(150)] + [(202, 0, "system", "Be brief.")] * 5
    rows += [(None, 1, "user", "who."), (None, 0, "assistant", "what."), (203, None, "user", "late."), (203, None, None, None),
             (203, 4, "assistant", "end."), (204, None, "user", None), (-7, 3, "user", "x."), (-7, 3, "user", "x."), (-7, 3, "assistant", "x.")]
    return rows


def frame(spark, rows):
    data = [(*r, "x", 1, "y", "z", 2) for r in rows]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, pos string, block int, tie string, fate string, copy int")


def test_structure_report_is_brute_force(spark):
    rows = cases()
    df = frame(spark, rows).repartition(5)
    got = structure_report(df, damaged(df))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    want = [plain_report(c, of) for c, of in by.items()]
    assert grouped(tuple(r) for r in got.collect()) == grouped(want)
    assert any(len(w[7]) > 300 for w in want) and any("R" in w[7] for w in want) and any("I" in w[7] for w in want)


def test_structure_edge_tables(spark):
    empty = frame(spark, [])
    assert structure_report(empty, damaged(empty)).count() == 0
    dropped = next((c, t) for c in range(99) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    alone = frame(spark, [(*dropped, "user", "hi.")])
    assert [tuple(r) for r in structure_report(alone, damaged(alone)).collect()] == [
        (dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns_read_as_the_grammar(spark):
    df = frame(spark, cases())
    turns = repaired(with_faults(in_order(damaged(df)))).collect()
    by = {}
    for r in sorted(turns, key=lambda r: (str(r.conv_id), r.place)):
        by.setdefault(r.conv_id, []).append(r)
    for of in by.values():
        assert [r.place for r in of] == list(range(len(of)))
        left = "".join(r.role[0] for r in of if r.role is not None)
        left = left.removeprefix("s")
        assert left == "ua" * (len(left) // 2) and (left or not any(r.role for r in of))


@pytest.mark.parametrize("seed", range(3))
def test_trace_is_the_smallest_cheapest_string(seed):
    """Every choice of edits of short blocks, listed."""
    rng = random.Random(seed)
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    for _ in range(40):
        turns = tuple(4 * rng.randrange(4) + rng.randrange(4) for _ in range(rng.randrange(4)))
        found = []

        def walk(i, state, cost, audit, inserted):
            if i == len(turns):
                if state in ("", "a"):
                    found.append((cost, audit))
            if inserted < 2 and cost < 20:
                walk(i, step[state], cost + 3, audit + "I", inserted + 1)
            if i < len(turns) and cost < 20:
                role, fault = "?sua"[turns[i] // 4], turns[i] % 4
                walk(i + 1, state, cost + 4, audit + "D", 0)
                if fault in (0, 3):
                    if state + role in ("s", "u", "su", "ua", "au"):
                        walk(i + 1, role, cost + fault, audit + "K", 0)
                    walk(i + 1, step[state], cost + 3 + fault, audit + "R", 0)

        walk(0, "", 0, "", 0)
        from tillpoint.llm.structure import ACCEPT, closing_costs
        letters, end = traces(turns, closing_costs())[0]
        assert letters + traces((), ACCEPT, True)[end][0] == min(found)[1]
