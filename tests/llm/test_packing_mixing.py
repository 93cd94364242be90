from __future__ import annotations

import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import _tokens, mixing, packing

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_fast_ids_equal_the_plain_ones(odd):
    texts = [t or "" for _, t in odd] + ["a<|endoftext|>b", "  \n\n x", "1234567 ab's", "日本語 текст 😀‍👩", " "]
    for text in texts:
        plain = _tokens._plain("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids
        assert _tokens.encode(text).tolist() == plain


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_fast_ids_on_any_text(text):
    assert _tokens.encode(text).tolist() == _tokens._plain("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids


def test_pieces_tile_documents_and_sequences(spark, make, odd):
    rows = [(i, t) for i, t in odd if i not in (None, 105)] + [(500, "word " * 4000)]
    pieces = packing.pack(make(rows)).collect()
    texts = dict(rows)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = np.append(_tokens.encode(texts[doc] or ""), 0).astype("<u4")
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    lengths = []
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        lengths.append(at)
    assert max(lengths) <= packing.WINDOW
    assert all(n & (n - 1) == 0 for n in lengths)  # whole windows and powers of two: no padding
    assert sum(n < packing.WINDOW for n in lengths) <= 3 * 10  # those of the last window of a task


def test_packing_null_ids_repeats_and_nothing(make, odd):
    got = packing.pack(make(odd)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id: r.n for r in got}[105] == 2 * {r.doc_id: r.m for r in got}[105]
    assert packing.pack(make([])).count() == 0


def test_sum_of_squares_rule_by_brute_force():
    rng = np.random.default_rng(3)
    levels = packing.Levels(20)
    for size in rng.integers(1, 20, 400):
        before = levels.count.copy()
        best = None
        for h in range(20 - size + 1):
            if h and not before[h]:
                continue
            after = before.copy()
            after[h] -= 1 if h else 0
            if h + size < 20:
                after[h + size] += 1
            best = min(best, ((after[1:20] ** 2).sum(), -h)) if best else ((after[1:20] ** 2).sum(), -h)
        assert levels.choose(int(size)) == -best[1]
        levels.place(("x",), int(size))
        assert [len(x) for x in levels.open] == levels.count.tolist()


def test_rule_among_open_windows_by_brute_force():
    rng = np.random.default_rng(5)
    levels = packing.Levels(20)
    for size in rng.integers(1, 20, 30):
        levels.place(("x",), int(size), 0)
    for size in rng.integers(1, 20, 300):
        before, best = levels.count.copy(), None
        for h in np.flatnonzero(before[:20]):
            after = before.copy()
            after[h] -= 1
            after[(h + size) % 20] += 1  # what a cut leaves over stands in a window of its own
            rank = ((after[1:20] ** 2).sum(), h + size > 20, -h)
            best = min(best, rank) if best else rank
        assert levels.choose_open(int(size)) == -best[2]
        levels.place_rest(0, 0, int(size), np.arange(size))
    assert [len(x) for x in levels.open] == levels.count.tolist() and levels.held == levels.count.sum()


def test_nearly_all_tokens_stay_where_the_rule_put_them(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(8)
    pieces = packing.pack(docs)
    by_sequence = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("pieces"), F.sum(F.when(F.col("placed"), F.col("length")).otherwise(0)).alias("placed"))
    got = by_sequence.agg(
        F.sum("n").alias("n"),
        F.sum(F.when((F.col("n") < 1024) | (F.col("pieces") > 1), F.col("n"))).alias("shared"),
        F.sum(F.when((F.col("n") < 1024) | (F.col("pieces") > 1), F.col("placed"))).alias("placed"),
        F.sum(F.expr("case when bit_count(n) = 1 then n else 1024 end")).alias("padded"),
    ).first()
    assert got.placed >= 0.95 * got.shared > 0.1 * got.n
    assert got.padded == got.n


def test_few_open_windows_are_enough(spark, make):
    rows = [(i, "word " * (1 + 37 * i % 900)) for i in range(300)]
    for most in (0, 1, 2, 4096):
        sizes = packing.pack(make(rows, 1), most_open=most).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
        assert sum(r.n for r in sizes) == sum(r.doc_tokens for r in packing.pack(make(rows, 1)).select("doc_id", "doc_tokens").distinct().collect())
        assert sum(r.n < packing.WINDOW for r in sizes) <= 10


def water(sizes, weights):
    """Targets by repeated sharing of the excess."""
    total, target, done = sum(sizes), [0.0] * len(sizes), set()
    while True:
        left = total - sum(target[i] for i in done)
        free = [i for i in range(len(sizes)) if i not in done]
        if not free:
            return target
        for i in free:
            target[i] = left * weights[i] / sum(weights[j] for j in free)
        over = [i for i in free if target[i] > 3 * sizes[i]]
        if not over:
            return target
        for i in over:
            target[i] = 3.0 * sizes[i]
        done |= set(over)


def test_mix_meets_targets(spark, make, odd):
    rows = [(i, t, ["b", "é", None, "Z", "a", ""][k % 6] if k % 9 else "tiny") for k, (i, t) in enumerate(odd * 6)]
    docs = make(rows)
    got = mixing.mix(docs, mixing.size_of()).collect()
    assert len(got) == len(rows)
    n = lambda t: len(WORD.findall(t or ""))
    order = sorted({r[2] for r in rows if r[2] is not None}, key=lambda s: s.encode()) + [None]
    sizes = [sum(n(t) for _, t, s in rows if s == o) for o in order]
    target = water(sizes, [(5, 2, 1)[k % 3] for k in range(len(order))])
    for k, source in enumerate(order):
        own = [r for r in got if r.source == source]
        assert own[0].source_size == sizes[k] and abs(own[0].target - target[k]) < 1e-6 * max(1, target[k])
        assert all(0 <= r.copies <= 3 for r in own)
        taken = sum(r.copies * r.size for r in own)
        assert abs(taken - target[k]) <= max(3, 0.02 * target[k])
    again = mixing.mix(docs.repartition(7), mixing.size_of()).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_of_nothing(make):
    assert mixing.mix(make([]), mixing.size_of()).count() == 0
    assert [r.copies * r.size for r in mixing.mix(make([(1, ""), (2, None)]), mixing.size_of()).collect()] == [0, 0]


def test_two_margins_are_balanced(spark):
    cells = spark.createDataFrame([("a", "x", 100.0), ("a", "y", 50.0), ("b", "x", 70.0), ("b", "y", 200.0)], "source string, lang string, tokens double")
    cells = cells.withColumn("target_source", F.when(F.col("source") == "a", 200.0).otherwise(220.0)).withColumn("target_lang", F.when(F.col("lang") == "x", 210.0).otherwise(210.0))
    rows = mixing.balance(cells, ["source", "lang"]).collect()
    for key, value, want in (("source", "a", 200), ("source", "b", 220), ("lang", "x", 210), ("lang", "y", 210)):
        assert abs(sum(r.tokens * r.rate for r in rows if r[key] == value) - want) < 1e-3


def test_mixed_rows_keep_columns(make, odd):
    docs = make(odd)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0


def test_ids_of_very_long_runs_equal_the_plain_ones():
    plain = _tokens._plain("byte_bpe_50k.json")
    for text in (" " * 1_000_000, "x" + "\n" * 300_000 + "y", "a" * 1_000_000, "7" * 300_000, "#" * 300_000, "é" * 300_000, " \t" * 200_000 + "end", "w " * 200_000):
        ids = _tokens.encode(text)
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
    special = "<|endoftext|>" + " " * 20_000
    ordinary = _tokens.encode(special, ordinary=True).tolist()
    assert ordinary[:3] == _tokens.encode("<|endoftext|>", ordinary=True).tolist()[:3] and ordinary != _tokens.encode(special).tolist()


def test_a_text_of_a_million_blanks_is_packed(make):
    rows = packing.pack(make([(1, " " * 1_000_000), (2, "a")])).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == {r.doc_id: r.doc_tokens for r in rows}[1]


def test_the_fullest_windows_are_taken_out():
    levels = packing.Levels(16)
    for k in range(30):
        levels.place((k, 0, 9, np.zeros(9, "<u4")), 9)
    out = levels.fullest(20)
    assert len(out) == 20 and levels.count.sum() == 10 and sum(map(len, levels.open)) == 10


def test_pieces_tile_with_few_open_windows(spark):
    docs = spark.createDataFrame([(k, "word " * (40 + k % 13)) for k in range(300)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs, window=64, most_open=5).collect()
    ends, lengths = {}, {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == lengths.get(r.sequence_id, 0)
        lengths[r.sequence_id] = r.offset + r.length
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == ends.get(r.doc_id, 0)
        ends[r.doc_id] = r.start + r.length
    assert ends == {r.doc_id: r.doc_tokens for r in rows}
    assert sum(n < 64 for n in lengths.values()) <= 6 and max(lengths.values()) <= 64


def test_document_rates_are_tilted_by_size(spark):
    import math

    rows = [(f"{s}", float(n * k), n / 20) for s in "ab" for n, k in ((5, 40), (20, 30), (80, 10), (400, 2))]
    cells = spark.createDataFrame(rows, "source string, tokens double, z double").withColumn("target_source", F.when(F.col("source") == "a", 5000.0).otherwise(900.0))
    got = mixing.balance(cells, ["source"]).collect()
    for source, want in (("a", 5000.0), ("b", 900.0)):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.tokens * r.rate for r in own) - want) < 1e-6 * want
        assert all(abs(r.rate - min(3.0, math.exp(r.lam_source * r.z))) < 1e-9 for r in own)
        assert len({round(r.rate, 6) for r in own}) > 2
    full = mixing.balance(cells.withColumn("target_source", 3.0 * F.lit(200 + 600 + 800 + 800)), ["source"]).collect()
    assert all(r.rate == 3.0 for r in full)


def test_mix_does_not_depend_on_ids(spark):
    rows = [(None if k % 3 else k // 40, "w " * (1 + k % 50), "ab"[k % 2]) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [mixing.mixed_rows(docs.repartition(n)).groupBy("doc_id", "text").count().collect() for n in (3, 11)]
    assert sorted(map(str, got[0])) == sorted(map(str, got[1]))
