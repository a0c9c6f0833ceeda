"""License scans against every pattern on every text."""

import random
import re
from re import _constants as C
from re import _parser

import pytest

from brute import grouped
from llm_cases import docs, docs_rows, make  # noqa: F401  (fixtures)
from tillpoint.llm.license import PHRASES, license_report, license_scan
from tillpoint.llm.license_rules import STEMS, rules

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PATTERNS = [(r, re.compile(r.regex, re.A)) for r in rules()]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_base(text):
    words = WORD.findall(lowered(text))
    hits = [(i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    return len(words), hits


def plain_detections(text):
    tagged = "spdx-license-identifier" in lowered(text)  # joined identifiers count in tagged texts alone
    found = [(m.start(), m.end(), r.priority, r.order, r.label, r.confidence) for r, p in PATTERNS
             if r.priority > 1 or tagged for m in p.finditer(text or "")]

    def inside(d, e):
        return e[0] <= d[0] and d[1] <= e[1] and (e[2] < d[2] or e[2] == d[2] and (e[:2] != d[:2] or e[3] < d[3]))

    return [d for d in found if not any(inside(d, e) for e in found)]


def plain_report(i, text):
    n, hits = plain_base(text)
    found = plain_detections(text)
    base = {h[1] for h in hits}
    return (i, n, len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(sorted(base)),
            ",".join(sorted(base | {d[4] for d in found})), max([0.95 if hits else 0.0, *(d[5] for d in found)]))


def sample(rng, tree):
    """A random text that a pattern matches."""
    out = ""
    for op, arg in tree:
        if op is C.LITERAL:
            out += chr(arg)
        elif op is C.NOT_LITERAL:
            out += "x"
        elif op is C.ANY:
            out += rng.choice("ab c")
        elif op is C.IN:
            if arg[0][0] is C.NEGATE:
                out += rng.choice("xyz")
            else:
                kind, what = rng.choice(arg)
                out += chr(what) if kind is C.LITERAL else rng.choice([c for c in " -,\n/" if what[0] <= ord(c) <= what[1]] or [chr(rng.randint(*what))]) if kind is C.RANGE else " "
        elif op is C.BRANCH:
            out += sample(rng, rng.choice(arg[1]))
        elif op is C.SUBPATTERN:
            out += sample(rng, arg[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, what = arg
            out += "".join(sample(rng, what) for _ in range(rng.randint(low, min(high, low + 2))))
        elif op not in (C.ASSERT_NOT, C.AT):
            raise AssertionError(op)
    return out


def samples():
    rng = random.Random(2)
    return [(r, p, f"({sample(rng, _parser.parse(r.regex))})") for r, p in PATTERNS for _ in range(4)]


def test_there_are_hundreds_of_rules():
    found = rules()
    assert len(found) >= 300 and [r.order for r in found] == list(range(len(found)))
    assert len({r.regex for r in found}) == len(found)


def test_every_match_holds_the_keywords_and_a_stem():
    for r, p, text in samples():
        assert p.search(text), (r.regex, text)
        assert all(k in lowered(p.search(text)[0]) or k in lowered(text) or k == "spdx-license-identifier" for k in r.keys), (r, text)
        assert any(s in k for k in r.keys for s in STEMS), r


def texts():
    rng = random.Random(7)
    said = [t for _, _, t in samples()]
    own = ["Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
           "Licensed under the Apache License, Version 2.0.", "under the mit license under\nthe... MIT_License! xunder the mit license", "cc by nc cc-by-nc, CC BY NCx éCC BY NC",
           "apache license version 2 apache license version 2.0 apache license version 20", "ſpdx-license-identifier: MIT", "SPDX-License-Identifier: MIT OR Apache-2.0 AND ISC",
           "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: CC-BY-NC-4.0", "İ KLICENSE mit lİcense", "", None, " ", "mit mir licence geht", "license " * 500,
           "Released under the MIT License. " * 300, "GNU Lesser General Public License version 2.1 or GNU General Public License", "😀 Licensed under the MIT License 😀 cc by nc"]
    mixed = [" ".join(rng.choice(said) if rng.random() < 0.3 else rng.choice(("alpha", "été", "the", "license", "of", "mit", "under"))for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    return own + said + mixed


def test_license_report_is_brute_force(make):
    rows = [(i, t, "a") for i, t in enumerate(texts())] + [(3, "Licensed under CC BY-NC 4.0.", "b"), (None, "MIT license", "b"), (None, None, "c")]
    got = license_report(license_scan(make(rows).repartition(4)))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert grouped(tuple(r) for r in got.collect()) == grouped(plain_report(i, t) for i, t, _ in rows)


def test_detections_have_their_places(make):
    rows = [(i, t, "a") for i, t in enumerate(texts())]
    for r in license_scan(make(rows)).collect():
        assert {(x.start, x.end, x.priority, x.rule, x.label, x.confidence) for x in r.detections} == set(plain_detections(rows[r.doc_id][1]))


def test_odd_documents_are_clean(docs, docs_rows, make):
    got = {r.doc_id: r for r in license_report(license_scan(docs)).collect()}
    assert all(r.labels == "" and r.score == 0 and r.first_word is None for r in got.values()) and len(got) == len(docs_rows)
    assert license_report(license_scan(make([]))).count() == 0


@pytest.mark.parametrize("text, labels", [
    ("Released under the MIT License.", "mit"), ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("Licensed under the Apache License, Version 2.0.", "apache-2"),
    ("GNU Lesser General Public License", "lgpl"), ("CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa"), ("BSD 3-Clause License", "bsd-3-clause"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2,mit"), ("Das Kind ging mit der Lizenz", "")])
def test_labels_of_common_notices(make, text, labels):
    assert license_report(license_scan(make([(1, text, "a")]))).first().labels == labels
