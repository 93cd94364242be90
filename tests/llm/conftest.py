from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, target double, rank int, key string, size string, _bucket int, pii string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns of clashing names."""

    def docs(rows, parts: int = 3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None, True, 1.0, 7, "k", "x", 1, "p") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)

    return docs


@pytest.fixture(scope="session")
def odd():
    """Null, empty, blank, very long, repeated and tied rows."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    rows = list(enumerate(prose))
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "x" * 5000), (104, "ab " * 3000), (105, prose[3]), (105, prose[3]), (106, prose[3] + " tail"), (107, "é" * 300 + " " + prose[4]), (None, prose[5]), (None, None), (108, "a b c"), (109, "A B C"), (110, "\n".join(prose[:3] * 3))]
    return rows
