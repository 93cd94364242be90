from __future__ import annotations

import corpus_pipeline
import pytest

from quire.llm import _frames, jaccard, mixing, packing, pii, quality_rules


@pytest.fixture(scope="module")
def stages(spark, small):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = _frames.stored(stage(spark, docs, small), "stage")
        out.append((name, docs, after))
        docs = after
    return out


def test_names_and_columns(stages):
    assert 4 <= len(stages) <= 5
    for _, before, after in stages[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"] == before.columns


def test_quality_stage_drops_what_it_rejects(spark, small, stages):
    _, before, after = stages[0]
    verdict = quality_rules.quality_rules(spark, before, spark.read.parquet(f"{small}/labels.parquet"))
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in verdict.filter("kept").collect())


def test_one_of_each_class_stays(stages):
    _, before, after = stages[1]
    kept = sorted(r.doc_id for r in after.collect())
    assert kept == sorted(r.doc_id for r in jaccard.classes(before).filter("doc_id = component_id").collect())
    assert len(kept) < before.count()


def test_no_personal_data_is_left(stages):
    _, before, after = stages[2]
    assert after.count() == before.count()
    assert pii.digest(pii.find(after)).filter("n_email + n_ip + n_card + n_phone > 0").count() == 0


def test_mixture_takes_copies(stages):
    _, before, after = stages[3]
    want = mixing.mix(before, mixing.size_of()).agg({"copies": "sum"}).first()[0]
    assert after.count() == want


def test_packing_takes_all(stages):
    _, before, after = stages[4]
    assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}


@pytest.fixture(scope="module")
def odd_rows(odd):
    return [*odd, (600, " " * 300_000 + "x"), (601, "word " * 60_000), (602, "mail a@b.example.org now " + "and more words to keep it " * 3), (603, "mail a@b.example.org now " + "and more words to keep it " * 3)]


def test_stages_take_odd_rows_and_columns(spark, small, make, odd_rows):
    """Nulls, empty and very long texts, ties, repeated rows and columns of clashing names."""
    docs = make(odd_rows)
    for name, stage in corpus_pipeline.STAGES:
        after = _frames.stored(stage(spark, docs, small), "odd")
        if name != "packing":
            assert after.columns == docs.columns, name
        docs = after
    assert docs.count() > 0 and docs.columns == [c.split()[0] for c in packing.SCHEMA.split(", ")]


def test_each_stage_takes_all_odd_rows(spark, small, make, odd_rows):
    docs = make(odd_rows)
    for name, stage in corpus_pipeline.STAGES:
        if name == "PII":
            assert stage(spark, docs, small).count() == len(odd_rows)
        assert stage(spark, docs, small).count() > 0, name


def test_stages_take_empty_tables(spark, small, make):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, make([]), small).count() == 0


def test_near_copies_against_brute_force(spark, small, stages):
    from test_dedup import components

    _, before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, n, c in components(rows) if n})


def test_redaction_against_plain_patterns(stages):
    import re

    from test_pii import PLAIN

    _, before, after = stages[2]
    left = {r.doc_id: r.text for r in after.collect()}
    for r in before.collect():
        found = [(kind, m.group(0)) for kind, pattern, ok in PLAIN for m in re.finditer(pattern, r.text) if ok(m.group(0))]
        assert all(text not in left[r.doc_id] for kind, text in found if kind == "email")
        assert left[r.doc_id] != r.text if found else left[r.doc_id] == r.text or re.search(r"\[(IBAN|SSN)\]", left[r.doc_id])
