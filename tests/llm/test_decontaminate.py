from __future__ import annotations

import random
import re

import duckdb
import pytest

from quire.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        ids = sorted(str(i) for i in found if i is not None)
        out.append((-1 if doc is None else doc, len(w), len(hit), ids, bool(hit)))
    return sorted(out)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcé7") for _ in range(rng.randint(1, 3))) for _ in range(60)]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", ", ", "-", "_", "  "]) for _ in range(n))

    items = [(i, text(rng.randint(1, 40))) for i in range(30)] + [(2, text(12)), (31, "Zyx"), (32, "zyx WVU"), (33, "zyx wvu tsr"), (34, None), (35, "?!"), (None, "only here one two three four"), (36, "a a a a a a a a a a a a a a"), (10, text(25))]
    docs = [(i, text(rng.randint(1, 200))) for i in range(60)]
    for k in range(60):
        item = rng.choice(items)[1] or ""
        cut = rng.randrange(len(item) + 1)
        docs.append((100 + k, text(rng.randint(0, 30)) + " " + item[cut:].upper().replace("É", "é") + " " + text(rng.randint(0, 5)) + item[:cut]))
    docs += [(300, None), (301, ""), (302, "\n\t"), (303, "zyx"), (304, "zyxw"), (305, "ZYX-wvu"), (306, "a " * 500), (307, "a " * 9), (None, items[3][1]), (None, None), (308, items[0][1]), (308, items[1][1]), (308, items[1][1]), (309, "x" * 3_000_000 + " " + items[5][1]), (310, "only here one two three four five"), (311, text(30_000) + items[7][1])]
    return docs, items


def found(spark, docs, items):
    d = spark.createDataFrame([(*x, 1, "w", 5, 9) for x in docs], "doc_id long, text string, n_words int, window string, row int, at int").repartition(5)
    i = spark.createDataFrame([(*x, 1, "t") for x in items], "item_id long, text string, n int, token string").repartition(3)
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.decontaminate(d, i).collect())


def test_windows_match_brute_force(spark, tables):
    got = found(spark, *tables)
    assert got == brute(*tables)
    assert 20 < sum(r[4] for r in got) < len(got)


def test_a_full_table_and_a_shuffled_join_change_nothing(spark, tables, monkeypatch):
    """Every shingle passes a table of 64 bits; no window is shipped."""
    monkeypatch.setattr(decontaminate, "MOST_BITS", 64)
    monkeypatch.setattr(decontaminate, "MOST_WINDOWS", 0)
    docs, items = tables
    docs = [d for d in docs if d[0] != 309]
    assert found(spark, docs, items) == brute(docs, items)


def test_query_matches_sql(spark, small):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    got = decontaminate.op13_decontamination(spark, small)
    res = con.execute(decontaminate.OP13_SQL)
    assert got.columns == [c[0] for c in res.description]
    want = res.fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(r[-1] for r in want)


def test_empty_tables(spark, tables):
    docs, items = tables
    assert found(spark, [], items) == []
    assert {r[2:] [0] for r in found(spark, docs[:9], [])} == {0}
