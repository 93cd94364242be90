from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from quire.llm import _hashed, quality_rules, weak_labels

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else None
    if twice is None:
        from collections import Counter

        counts = Counter(windows)
        twice = {w for w, n in counts.items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_base_figures_match_a_plain_count(spark, make, odd):
    rows = [*odd, (200, "a # b\na # b\nc <|> d\n\n\na # b"), (201, "é ñ |\né ñ |"), (202, "one two three four five one two three four five")]
    got = quality_rules.quality_rules(spark, make(rows), labels(spark, [(1, 1, 0)])).collect()
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert found == sorted((i is None, i or 0, *base(t)) for i, t in rows)
    # One class only: nothing is rejected but by the base rules.
    assert all(r.kept == (not r.base_failed) for r in got)


def test_verdict_on_labels_held_out(spark, small):
    docs, all_labels = spark.read.parquet(f"{small}/../sf0.01/documents.parquet"), spark.read.parquet(f"{small}/../sf0.01/labels.parquet")
    train, test = all_labels.filter("doc_id % 2 = 0"), all_labels.filter("doc_id % 2 = 1")
    judged = quality_rules.quality_rules(spark, docs, train).filter("not base_failed").join(test, "doc_id")
    right = judged.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int")), F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int")))).first()
    assert right[0] > 0.97 and right[1] > 0.98


def test_filter_keeps_columns_and_order_of_decisions(spark, make, odd):
    docs = make(odd)
    kept = quality_rules.filter_quality(spark, docs, labels(spark, []))
    assert kept.columns == docs.columns
    assert kept.count() == sum(not base(t)[5] for _, t in odd)


def test_empty_tables(spark, make):
    docs = make([])
    assert quality_rules.quality_rules(spark, docs, labels(spark, [])).count() == 0
    assert weak_labels.classify(docs).count() == 0


def test_labels_that_disagree_are_left_out(spark):
    rows = labels(spark, [(1, 1, 0), (1, 0, 0), (2, 0, 0), (2, 0, 1), (3, None, 0), (None, 1, 0), (4, 7, 0)])
    assert [(r.doc_id, r.target) for r in quality_rules.quality_targets(rows).collect()] == [(2, 0.0)]


def test_weak_labels_agree_with_held_labels(spark, small):
    docs, known = spark.read.parquet(f"{small}/../sf0.01/documents.parquet"), spark.read.parquet(f"{small}/../sf0.01/labels.parquet")
    judged = weak_labels.classify(docs).join(known, "doc_id")
    good, bad = judged.agg(F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))), F.avg(F.when(F.col("quality") == 0, (~F.col("kept")).cast("int")))).first()
    assert good > 0.97 and bad > 0.9


def test_weak_labels_handle_odd_rows(make, odd):
    assert weak_labels.classify(make(odd)).count() == len(odd)


def test_em_finds_an_unreliable_labeller():
    import numpy as np

    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.8
    cast = np.zeros((len(good), 4), int)
    for k, (hit, slip) in enumerate(((0.7, 0.01), (0.6, 0.02), (0.5, 0.01), (0.2, 0.2))):
        cast[:, k] = np.where(rng.random(len(good)) < np.where(good, slip, hit), weak_labels.BAD, 0)
    codes, counts = np.unique(weak_labels.pattern(cast), return_counts=True)
    post, rates, share = weak_labels.posterior(codes, counts.astype(float), 4)
    assert abs(share - 0.8) < 0.03
    assert rates[0, 0, 1] > 0.6 and abs(rates[3, 0, 1] - rates[3, 1, 1]) < 0.05
    truth = {c: good[weak_labels.pattern(cast) == c].mean() for c in codes}
    assert max(abs(post[i] - truth[c]) for i, c in enumerate(codes) if counts[i] > 400) < 0.1


def test_platt_recovers_a_slope():
    import numpy as np

    rng = np.random.default_rng(2)
    z = rng.normal(size=5000) * 3
    y = (rng.random(5000) < _hashed.sigmoid(2 * z - 1)).astype(float)
    slope, shift = _hashed.platt(z, y)
    assert slope == pytest.approx(2, abs=0.3) and shift == pytest.approx(-1, abs=0.3)


_ODD = set(b"#$%&*+/<=>@\\^_`{|}~")


def plain_votes(text):
    raw, words = (text or "").encode(), [w.encode() for w in WORD.findall(text or "")]
    n, chars, symbols, dup_lines, repeated, _ = base(text)
    per = max(n, 1)
    letters = [c for c in raw if chr(c).isalpha() and c < 128]
    solid = [c for c in raw if c not in b" \t\n\x0b\x0c\r"]
    capital = sum(65 <= c <= 90 for c in letters) / max(len(letters), 1)
    sentences = sum(w.endswith(b".") for w in words) / per
    bad = [
        n < 3, repeated / per > 0.2, dup_lines / (raw.count(b"\n") + 1) >= 0.3, symbols / per > 0.1, capital > 0.4 and len(letters) >= 20,
        chars / per < 2.5 or chars / per > 12, raw.count(b"!") / per > 0.2, len(set(words)) / per < 0.2 and n >= 30,
        sum(w[-1] in _ODD for w in words) / per > 0.2, (len(letters) + sum(c >= 128 for c in solid)) / max(len(solid), 1) < 0.92 and n >= 5,
    ]
    return [weak_labels.BAD * b for b in bad] + [weak_labels.GOOD * g for g in (n >= 40, 0.02 < sentences < 0.3)]


def plain_em(rows, rounds=200):
    """The same estimates document by document, without patterns and arrays."""
    import math

    share, good = weak_labels.SHARE, [weak_labels.SHARE] * len(rows)
    rates = [[list(c) for c in k] for k in weak_labels.BELIEF.tolist()]
    for turn in range(rounds):
        if turn:
            for c in (0, 1):
                mass = [p if c else 1 - p for p in good]
                for k in range(len(rates)):
                    for v in range(3):
                        own = sum(m for m, row in zip(mass, rows, strict=True) if row[k] == v)
                        rates[k][c][v] = (own + weak_labels.PRIOR_DOCS * weak_labels.BELIEF[k][c][v]) / (sum(mass) + weak_labels.PRIOR_DOCS)
            share = min(max(sum(good) / len(good), 1e-4), 1 - 1e-4)
        odds = [math.log(share / (1 - share)) + sum(math.log(rates[k][1][v] / rates[k][0][v]) for k, v in enumerate(row)) for row in rows]
        now = [1 / (1 + math.exp(-max(-40.0, min(40.0, o)))) for o in odds]
        moved, good = max(abs(a - b) for a, b in zip(now, good, strict=True)), now
        if turn and moved < 1e-9:
            break
    return good


def test_votes_and_posteriors_match_a_plain_version(make, odd):
    rows = [*odd, (300, "WE SHOUT! AND SHOUT! AGAIN! LOUDLY! NOW!"), (301, "a\nb c\na\nb c\na"), (302, "x# y$ z% q& r* s+ t/"), (303, "One two. " * 30)]
    got = weak_labels.classify(make(rows)).collect()
    votes = {i: plain_votes(t) for i, t in rows if i not in (None, 105)}
    for r in got:
        if r.doc_id in votes:
            assert r.pattern == sum(v * 3**k for k, v in enumerate(votes[r.doc_id])), r.doc_id
    post = dict(zip([(i, t) for i, t in rows], plain_em([plain_votes(t) for _, t in rows]), strict=True))
    want = {i: p for (i, _), p in post.items()}
    assert all(abs(r.posterior - want[r.doc_id]) < 1e-6 for r in got if r.doc_id in votes)
    assert all(r.kept == (r.probability >= weak_labels.THRESHOLD) for r in got)


def test_the_prior_washes_out_with_the_corpus():
    import numpy as np

    codes, counts = np.array([0, 1, 3, 4]), np.array([700.0, 150, 100, 50])
    shares = [weak_labels.posterior(codes, counts * k, 2)[2] for k in (1, 1000, 1_000_000)]
    assert abs(shares[1] - shares[2]) < 1e-3


def test_a_repeated_labelled_id_is_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(1, f"good words number {k}") for k in range(50)] + [(2, "bad"), (3, None)], "doc_id long, text string")
    targets = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 0.0)], "doc_id long, target double")
    one = quality_rules.train(docs, targets)
    other = quality_rules.train(docs.repartition(5), targets)
    assert (one.weights == other.weights).all() and one.bias == other.bias


def test_long_lines_that_a_polynomial_confuses_are_told_apart(make):
    word = "a"
    for _ in range(11):  # a Thue-Morse word and its complement
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    r = quality_rules.judge(make([(1, f"{word}\n{other}")]), _hashed.Model(None, 0.0), True).collect()[0]
    assert (r.n_dup_lines, r.n_words) == (0, 2)
