from __future__ import annotations

import collections
import hashlib
import random
import re

from quire.llm import _flat, jaccard, suffix

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 1 << 62


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = collections.defaultdict(lambda: LAST)
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], LAST if doc is None else doc)
    return sorted(((LAST if d is None else d), len(sets[i]), (LAST if d is None else d) if not sets[i] else least[find(i)]) for i, (d, _) in enumerate(rows))


def family(rng, words, n, edits, base_words=150):
    base = [rng.choice(words) for _ in range(base_words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append(" ".join(own))
    return out


def corpus():
    """Families larger than a group may be, a passage that most share, chains, and singles."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts = family(rng, words, 150, 6) + family(rng, words, 90, 2) + family(rng, words, 8, 3)
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(40, 200))) for _ in range(140)]
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(90)]
    chain = [rng.choice(words) for _ in range(100)]
    for _ in range(12):
        chain = [*chain[3:], *(rng.choice(words) for _ in range(3))]
        texts.append(" ".join(chain))
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 7))) for _ in range(60)]
    rng.shuffle(texts)
    return [(10 * i + 3, t) for i, t in enumerate(texts)]


def test_components_match_brute_force(make):
    rows = corpus()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(make(rows)).collect())
    assert got == components(rows)


def test_components_of_odd_rows(make, odd):
    got = sorted((LAST if r.doc_id is None else r.doc_id, r.n_shingles, LAST if r.component_id is None else r.component_id) for r in jaccard.classes(make(odd)).collect())
    assert got == components(odd)


def test_one_document_of_each_class_stays(make, odd):
    rows = [r for r in odd if r[0] is not None]
    docs = make(rows)
    left = jaccard.representatives(docs)
    assert left.columns == docs.columns
    classes = components(rows)
    empty = sum(n == 0 for _, n, _ in classes)
    kept = sorted(r.doc_id for r in left.collect())
    assert kept == sorted([*{c for _, n, c in classes if n}, *(d for d, n, _ in classes if not n)])
    assert empty and len(kept) < len(rows)


def test_nothing_links_in_an_empty_table(make):
    assert jaccard.classes(make([])).count() == 0 and suffix.dedup(make([])).count() == 0
    assert jaccard.representatives(make([])).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    assert {r.comp for r in jaccard.components(edges).collect()} == {0, 1000}


def plain_removal(rows):
    rows = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in rows:
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], i), i)
    out = []
    for i, b in rows:
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def removed(df):
    return sorted((LAST if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_removal_matches_brute_force(make, odd):
    rng = random.Random(4)
    rows = [(i, t) for i, t in odd if t is None or len(t) < 6000]
    for k in range(60):
        a, b = (rng.choice(odd)[1] or "" for _ in range(2))
        rows.append((300 + k, a[rng.randrange(len(a) + 1) :][:200] + rng.choice(["", "é", "# "]) + b[rng.randrange(len(b) + 1) :][:150]))
    rows += [(-1, "ab" * 300), (-2, "ab" * 200), (-3, "é" * 40 + "z"), (-4, "q" + "é" * 40), (-5, "y" * 900 + "é" * 25 + "y" * 70), (-6, "x" * 49), (-7, "x" * 50)]
    assert removed(suffix.dedup(make(rows))) == plain_removal(rows)


def test_removal_of_copies_keeps_the_first(make):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(5, text), (3, text), (9, "start " + text), (9, "other row of nine " + text[100:]), (1, text[40:95])]
    assert removed(suffix.dedup(make(rows))) == plain_removal(rows)
    kept = {r.doc_id: bytes(r.kept) for r in suffix.dedup(make(rows[:2]), keep_bytes=True).collect()}
    assert kept == {3: text.encode(), 5: b""}


def test_hashes_of_ranges_do_not_depend_on_their_place():
    import numpy as np

    data = np.frombuffer(b"abcabcabc", np.uint8)
    h = _flat.Hasher(data)(np.array([0, 3, 6, 0]), np.array([3, 6, 9, 4]))
    assert h[0] == h[1] == h[2] != h[3]


def test_components_of_a_large_family_in_many_parts(make):
    """More near copies than a group may hold, many of them too far from all others."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    base = [rng.choice(words) for _ in range(120)]
    texts = set()
    while len(texts) < 1300:
        own = list(base)
        at = rng.randrange(120)
        for k in range(rng.choice([0, 1, 2, 3, 4, 5, 9])):
            own[(at + 11 * k) % 120] = rng.choice(words[:40] if rng.random() < 0.5 else words)
        texts.add(" ".join(own))
    rows = [(7 * i + 1, t) for i, t in enumerate(sorted(texts, key=hash))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(make(rows)).collect())
    assert got == components(rows)
    assert 20 < len({c for *_, c in got}) < 1200


def test_rounds_of_leads_reach_all(make, monkeypatch):
    monkeypatch.setattr(jaccard, "LEADS", 4)
    monkeypatch.setattr(jaccard, "MORE_LEADS", 3)
    rows = corpus()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(make(rows)).collect())
    assert got == components(rows)


def test_a_block_finds_links_as_sets_do():
    import numpy as np

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(30)]
    block = jaccard.Block(list(range(30)), list(range(30)), sets)
    for k in range(100, 140):
        own = np.unique(rng.integers(0, 40, 30).astype(np.uint64))
        found = block.links(k, k, own)
        linked = [j for j in range(30) if 100 * len(np.intersect1d(own, sets[j])) >= 80 * len(np.union1d(own, sets[j]))]
        assert set(found) <= set(linked)
        assert {block._root(j) for j in linked} <= {block._root(k)}


def edited(rng, words, text, n):
    """A text with n words changed that share no shingle."""
    own = text.split()
    for at in rng.sample(range(5, len(own) - 5, 11), n):
        own[at] = rng.choice(words) + "x"
    return " ".join(own)


def test_a_link_is_found_though_its_group_changes_its_largest_component(spark, make, monkeypatch):
    """Components of 10, 9 and 9 members; y, a lead of the first round, links the second with the
    third then, and with x of the first, which was not compared in that round."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    monkeypatch.setattr(jaccard, "LEADS", 1)
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(5000)]

    def key(text):
        return jaccard.key_of(jaccard.shingles(*_flat.flat(pa.array([text])))[0])

    def leads(texts):
        keys = spark.createDataFrame([(key(t),) for t in texts], "a long")
        share = F.pmod(F.xxhash64("a", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30)) * 28
        return [r[0] < 1 for r in keys.select("a", share.alias("s")).select("s").collect()]

    x = " ".join(rng.choice(words) for _ in range(201))
    near = [edited(rng, words, x, 4) for _ in range(300)]
    y = near[leads(near).index(True)]
    far = [edited(rng, words, y, 4) for _ in range(50)]
    z = far[leads(far).index(False)]
    rest = [" ".join(rng.choice(words) for _ in range(201)) for _ in range(100)]
    rest = [t for t, lead in zip(rest, leads(rest), strict=True) if not lead][:25]
    members = [[x, *rest[:9]], [y, *rest[9:17]], [z, *rest[17:25]]]
    assert [len(m) for m in members] == [10, 9, 9]
    texts = [t for m in members for t in m]
    docs = make(list(enumerate(texts))).select("doc_id", "text")
    nodes = spark.createDataFrame([(key(t), i) for i, t in enumerate(texts)], "key long, doc_id long")
    large = spark.createDataFrame([(5, key(t), 197, 197) for t in texts], "token long, a long, a_n int, a_light int")
    edges = spark.createDataFrame([(key(m[0]), key(t)) for m in members for t in m[1:]], "a long, b long")
    for parts in (1, 64):
        monkeypatch.setattr(jaccard, "SLICE", parts)
        _, labels = jaccard._joined(docs, nodes, large, edges)
        assert labels.select("comp").distinct().count() == 1
    assert np.array_equal(np.unique([r.key for r in labels.collect()]), np.unique([key(t) for t in texts]))


def test_many_families_in_rounds_of_few_leads(make, monkeypatch):
    """Twenty families with groups larger than their leads; links join their components in every order."""
    monkeypatch.setattr(jaccard, "GROUP", 8)
    monkeypatch.setattr(jaccard, "LEADS", 2)
    monkeypatch.setattr(jaccard, "MORE_LEADS", 4)
    monkeypatch.setattr(jaccard, "SLICE", 3)
    rng = random.Random(31)
    texts = []
    for f in range(20):
        words = [f"{f}{''.join(rng.choice('abcdefgh') for _ in range(5))}" for _ in range(2000)]
        base = [" ".join(rng.choice(words) for _ in range(140))]
        for _ in range(40):
            base.append(edited(rng, words, rng.choice(base), rng.choice([3, 4, 5, 5])))
        texts += base
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(make(rows)).collect())
    assert got == components(rows)
    assert len({c for *_, c in got}) > 20


def test_hot_ranks_and_texts_without_ids(make, monkeypatch):
    """A passage in every document, most of them without ids: dealt over tasks, with the same result."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(suffix, "SAMPLED", 1)
    monkeypatch.setattr(suffix, "HOT", 3)
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefgh ") for _ in range(9))
    passage = " ".join(word() for _ in range(12))
    rows = [(i if i % 3 == 0 else None, f"{word()} {word()} {passage[rng.randrange(40):]} {word()} {passage[: rng.randrange(90)]}") for i in range(240)]
    rows += [(None, rows[1][1]), (None, rows[1][1]), (9, rows[0][1]), (0, rows[4][1]), (None, None), (None, "short")]
    docs = make(rows, 5)
    assert removed(suffix.dedup(docs)) == plain_removal(rows)
    texts = docs.select(F.col("doc_id").alias("doc"), "text", F.pmod(F.xxhash64("text"), F.lit(1 << 19)).alias("tag"))
    hot = suffix.hot_ranks(texts.filter("text is not null"))
    assert len(hot) > 3
    # Without an id a text has a number of its own, so that no task gets all of them.
    keys = docs.filter("doc_id is null").select((F.lit(suffix.NO_ID) + F.xxhash64("text", F.lit(1)).bitwiseAND(suffix.NO_ID - 1)).alias("doc")).distinct().count()
    assert keys > 150


def test_row_numbers_follow_the_order(spark):
    from pyspark.sql import functions as F

    from quire.llm import _frames

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v")).repartition(7)
    got = _frames.numbered(df, F.col("k").desc(), name="n").collect()
    assert all(r.n == 999 - r.k for r in got) and len(got) == 1000 and got[0].v == "x"
    assert _frames.numbered(df.limit(0), F.col("k")).count() == 0
