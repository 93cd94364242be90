from __future__ import annotations

import collections
import itertools
import random
import re

import duckdb
import pytest

from quire.llm import audit

LAST = 1 << 63
WORD = re.compile("[^\x20\x09-\x0d]+")


def masks(rows):
    least = {}
    for i, text, _ in rows:
        key = LAST if i is None else i
        least[text or ""] = min(least.get(text or "", LAST), key)
    out = []
    for i, text, lang in rows:
        text = text or ""
        w = WORD.findall(text)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text), (LAST if i is None else i) > least[text]]
        out.append((i, lang or "", sum(f << k for k, f in enumerate(fails))))
    return out


def counted(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    out = {}
    removed_by = collections.Counter()
    for order in itertools.permutations(range(5)):
        for part in {m[1] for m in masks(rows)}:
            left = [(i, m) for i, p, m in masks(rows) if p == part]
            every = list(left)
            for step, f in enumerate(order):
                here = [(i, m) for i, m in left if m >> f & 1]
                left = [(i, m) for i, m in left if not m >> f & 1]
                fail = sum(m >> f & 1 for _, m in every)
                removed_by[part, f] += len(here)
                out[part, "".join("ABCDE"[x] for x in order), step + 1] = [len(left), len(here), fail - len(here), sum(m == 1 << f for _, m in every), sum(i in good for i, _ in here), sum(i in toxic for i, _ in here)]
    return {k: (*v, removed_by[k[0], "ABCDE".index(k[1][k[2] - 1])]) for k, v in out.items()}


FIELDS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    out = [(i, " ".join(rng.sample(words, rng.randint(60, 150))), rng.choice(["en", "de", None, ""])) for i in range(60)]
    out += [(100 + i, out[i % 7][1] + rng.choice(["", " $", " AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA"]), "en") for i in range(60)]
    copy = " ".join(words[:120])
    out += [(1000 - i, copy, rng.choice(["en", "fr"])) for i in range(300)] + [(700, copy, "en"), (700, copy, "en"), (701, copy, None)]
    out += [(2000, None, "en"), (2001, "", None), (2002, " \n", "x"), (2003, "w " * 70_000, "en"), (2004, "w " * 70_000, "en"), (None, copy, "en"), (None, None, None), (None, "alone", "de"), (None, "alone", "de"), (2005, "é" * 50 + " ABCDEF", "fr")]
    rng.shuffle(out)
    return out


def documents(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, g, "c", 3, 1, True) for i, t, g in rows], "doc_id long, text string, lang string, part string, mask int, key int, last boolean").repartition(parts)


def failed(df):
    return collections.Counter((r.doc_id, r.part, r["mask"]) for r in audit.failures(df).collect())


def test_failures_match_brute_force(spark, rows):
    want = collections.Counter(masks(rows))
    assert failed(documents(spark, rows)) == want
    assert sum(n for (_, _, m), n in want.items() if m & 16) > 300


@pytest.mark.parametrize("shipped", [0, 1 << 20])
def test_copies_over_many_tasks(spark, rows, monkeypatch, shipped):
    """A group of copies fills several tasks, and every boundary lies within it."""
    monkeypatch.setattr(audit, "MOST_SHIPPED", shipped)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert failed(documents(spark, rows, 9)) == collections.Counter(masks(rows))
        same = [(i // 2, "one text", "en") for i in range(200)]
        assert failed(documents(spark, same, 3)) == collections.Counter(masks(same))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_audit_matches_brute_force(spark, rows):
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 1000, 3)] + [(3, 1, None), (3, 0, 0), (None, 1, 1), (9, None, 1)]
    got = audit.audit(documents(spark, rows), spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string"))
    assert got.columns == FIELDS
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == counted(rows, labels)


def test_query_matches_sql(spark, small):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    got = audit.op12_filter_audit(spark, small)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(audit.OP12_SQL).fetchall())


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(documents(spark, [], 1), labels).count() == 0
    rows = [(1, "a", "en"), (2, "a", "en")]
    assert {r.good_lost for r in audit.audit(documents(spark, rows, 1), labels).collect()} == {0}
