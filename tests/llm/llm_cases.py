"""Odd documents that every operator has to take, and fixtures over them."""

import random

import pytest
from pyspark.sql import Row

#: Names that the operators use inside: extra columns of the input may have them.
CLASHING = ("bucket", "box", "rest", "dest", "kind", "kept", "m_u", "size", "k", "words", "length", "piece", "id", "score", "copies")


def sentence(rng, n):
    return " ".join(rng.choice(("alpha", "beta", "Gamma", "delta,", "eps", "zeta.", "été", "größe", "x1", "##")) + str(rng.randrange(400))
                    for _ in range(n))


def edge_docs():
    """(doc_id, text, source): nulls, empty and very long texts, copies, near
    copies, shared passages, white space, one word, repeated rows, a null id."""
    rng = random.Random(5)
    base, passage, long = sentence(rng, 120), sentence(rng, 40), sentence(rng, 20_000)
    near = base.split()
    near[60] = "other"
    lines = "\n".join(sentence(rng, 6) for _ in range(30))
    docs = [(1, None, "a"), (2, "", "a"), (3, "one", None), (4, "One", "b"), (5, long, "b"), (6, long, None), (7, base, "c"), (8, " ".join(near), "c"),
            (9, base, "c"), (10, sentence(rng, 30) + " " + passage + " " + sentence(rng, 30), "d"),
            (11, passage + "\t\n" + sentence(rng, 50), "d"), (12, " \t\n ", "e"), (13, "aa " * 700, "e"), (14, "b" * 3000, "e"),
            (15, lines, "f"), (16, sentence(rng, 5) + "\n" + lines + "\n" + sentence(rng, 5), "f"), (17, "\n\n\n", "f"),
            (18, "</s> <|endoftext|> \\ [INST] | 😀 e\u0301 İ ſ", "g"), (40, "two words", "g"), (-3, passage, None), (20, sentence(rng, 300), "a")]
    docs += [(100 + k, sentence(rng, rng.randrange(1, 200)), rng.choice("abc")) for k in range(40)]
    return docs


@pytest.fixture(scope="session")
def docs_rows():
    return edge_docs()


def frame(spark, rows):
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([Row(i, t, s, len(t) if t is not None else None, *["x"] * len(CLASHING)) for i, t, s in rows], schema)


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    return frame(spark, docs_rows).repartition(3)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: frame(spark, rows)
