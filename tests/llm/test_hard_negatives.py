from __future__ import annotations

import collections
import random

import duckdb
import pytest

from quire.llm import hard_negatives, topk

SCHEMA = "vec_id long, label long, v array<long>"


def brute(rows, every=100, positives=5, negatives=5, low=80, high=100):
    out = []
    for a, label, v in {(i, y, tuple(v)) for i, y, v in rows if i % every == 0}:
        scored = [(-sum(p * q for p, q in zip(v, w, strict=True)), i, y) for i, y, w in rows if i != a and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            window = sorted(x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(window[:negatives])]
    return collections.Counter(out)


def mined(df, **how):
    return collections.Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in hard_negatives.mine(df, **how).collect())


def crowd(rng, n, dims=4, spread=3, labels=4):
    return [(i, rng.randrange(labels), [rng.randint(-spread, spread) for _ in range(dims)]) for i in range(n)]


def test_ties_repeated_rows_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 64)
    rng = random.Random(1)
    rows = crowd(rng, 400) + [(1000 + k, k % 3, [2, 2, 2, 2]) for k in range(300)]
    rows += [(100, 1, [2, 2, 2, 2]), (100, 1, [2, 2, 2, 2]), (100, 2, [1, 2, 2, 2]), (7, 1, [2, 2, 2, 2]), (7, 1, [2, 2, 2, 2])]
    rows += [(200, 1, [5, 5]), (201, 1, [4, 5]), (202, 2, [4, 4]), (203, 2, [5, 4]), (300, 0, [0, 0, 0, 0]), (-100, 3, [1, 1, 1, 1])]
    want = brute(rows)
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(5)) == want
    assert len({k[:2] for k in want}) > 20


def test_wide_scores_take_several_rounds(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(2), [rng.randint(0, 1 << 24) for _ in range(3)]) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert mined(df) == brute(rows)
    assert mined(df, every=50, positives=2, negatives=40, low=95, high=99) == brute(rows, 50, 2, 40, 95, 99)


def test_many_candidates_in_one_bucket(spark, monkeypatch):
    """Scores that differ in their last bits only, and more ties than a round may leave."""
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 100)
    rows = [(100, 0, [1000, 1]), (1, 0, [1 << 20, 0])] + [(1000 + i, 1, [1 << 20, -(i % 50)]) for i in range(600)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, 0, [1 << 31, 1]), (1, 0, [(1 << 31) - 1, 5]), (2, 1, [(1 << 31) - 1, 4]), (3, 1, [(1 << 31) - 1, 3]), (4, 1, [(1 << 31) - 1, 6])]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    with pytest.raises(Exception, match="(?i)overflow|too large|int too|long"):
        mined(spark.createDataFrame([(0, 0, [1 << 40]), (1, 0, [1 << 40])], SCHEMA))


def test_rows_that_take_no_part(spark, small, tmp_path):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=5)], int(rng.integers(0, 10)), "x") for i in range(300)]
    rows += [(None, [1.0] * 5, 1, "x"), (400, None, 1, "x"), (500, [1.0, None, 1.0, 1.0, 1.0], 2, "x"), (600, [float("nan")] * 5, 3, "x"), (700, [float("inf")] * 5, 3, "x"), (800, [1.0] * 5, None, "x"), (900, [], 4, "x")]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = hard_negatives.op11_hard_negatives(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(hard_negatives.OP11_SQL).fetchall()
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_nothing_is_mined_from_nothing(spark):
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(100, 1, [1])], SCHEMA)).count() == 0
    assert topk.quantized(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), "label").columns == ["vec_id", "label", "v"]
