from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.operators import lines, outline

GOLDEN = [
    ("# Ⅰ. 기관현황", 1, "#", "Ⅰ. 기관현황"), ("## 1. 일반현황", 2, "##", "1. 일반현황"), ("### 1) 제안사 현황", 3, "###", "1) 제안사 현황"), ("#### x", 4, "####", "x"), ("##### y", 5, "#####", "y"),
    ("(1) 기관 개요", 4, "(1)", "기관 개요"), ("① 2023년 실적", 5, "①", "2023년 실적"), ("□ 대주제입니다", 6, "□", "대주제입니다"), ("❍ 중주제", 7, "❍", "중주제"), ("○중주제", 7, "○", "중주제"),
    ("- 하이픈 글머리", 8, "-", "하이픈 글머리"), ("· 가운뎃점", 9, "·", "가운뎃점"), ("※ 참고", 10, "※", "참고"), ("* 주석", 10, "*", "주석"), ("**bold**", 10, "*", "*bold**"), ("  plain text ", 0, "", "plain text"),
    ("-no blank", 0, "", "-no blank"), ("######## z", 0, "", "######## z"), ("　□　wide", 6, "□", "wide"),
]


def blocks(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return lines.blocks(lines.lines(docs)).orderBy("doc_id", "line_no").collect()


def test_golden_levels(spark):
    text = "\n".join(["first", *(g[0] for g in GOLDEN)])
    got = {r.line_no: (r.level, r.symbol, r.text) for r in blocks(spark, text)}
    assert got == {0: (0, "", "first"), **{k + 1: g[1:] for k, g in enumerate(GOLDEN)}}


def test_line_ends_and_marks(spark):
    text = "﻿﻿a\r\nb\rc\x0bd e\n\nf\n"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "\n")], "doc_id long, text string")
    got = sorted((r.doc_id, r.line_no, r.raw) for r in lines.lines(docs).collect())
    assert got == [(1, k, v) for k, v in enumerate(text.lstrip("﻿").splitlines())] + [(4, 0, "")]


@pytest.mark.parametrize(
    "text, levels",
    [
        ("# 제목\n# Ⅰ. 장", [-1, 1]),
        ("body\n# 제목\n# 둘째", [0, -1, 0]),
        ("## 절\n# 늦은 제목", [2, 0]),
        ("---\n```\n\n> quote\n  > quote", []),
        (" ---\n>no blank", [0, 0]),
        ("#  Ⅰ. two blanks", [-1]),
        ("□ \n①", [0]),
    ],
)
def test_titles_and_skipped_lines(spark, text, levels):
    assert [r.level for r in blocks(spark, text)] == levels


def test_ambiguity(spark):
    rows = blocks(spark, "□ " + "가" * 50, "□ " + "가" * 49, "요약 테이블", "수행 함", "한다.", "# Ⅰ. a\n#### 급격", "# Ⅰ. a\n### 둘", "가" * 31, "😀" * 30)
    assert [(r.doc_id, r.ambiguous) for r in rows] == [(0, True), (1, False), (2, True), (3, False), (4, False), (5, False), (5, True), (6, False), (6, False), (7, False), (8, True)]


def parents(levels):
    """The nearest earlier level below; of body the last other level."""
    out = []
    for i, level in enumerate(levels):
        before = [x for x in levels[:i] if x != 0]
        if level == 0:
            out.append(before[-1] if before else None)
        else:
            out.append(next((x for x in reversed(before) if x < level), None))
    return out


def test_parents_against_a_model(spark):
    cases: list[list[int]] = []

    @settings(max_examples=60, derandomize=True, database=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.integers(0, 10), min_size=1, max_size=25))
    def collect(levels):
        cases.append(levels)

    collect()
    marks = {0: "body line 다", 1: "# Ⅰ. x", 2: "## x", 3: "### x", 4: "#### x", 5: "##### x", 6: "□ x", 7: "❍ x", 8: "- x", 9: "· x", 10: "※ x"}
    rows = blocks(spark, *("\n".join(marks[v] for v in c) for c in cases))
    for k, case in enumerate(cases):
        own = [r for r in rows if r.doc_id == k]
        assert [r.level for r in own] == case
        assert [r.parent_level for r in own] == parents(case)


def test_context_is_of_blocks(spark):
    docs = spark.createDataFrame([(1, "a 다\n\nb 다\nc 다\nd 다\n짧은 제목\n---\ne 다")], "doc_id long, text string")
    row = lines.context(lines.blocks(lines.lines(docs))).first()
    assert (row.context_before, row.context_after) == (["b 다", "c 다", "d 다"], ["e 다"])


def test_types_round_trip(spark):
    df = spark.range(-2, 12).selectExpr("cast(id as int) as level")
    got = {r.level: r.t for r in df.select("level", lines.type_of(df.level).alias("t")).collect()}
    assert got[-1] == "H1" and got[-2] == got[11] == "body" and got[10] == "note" and got[6] == "L1"


MARKDOWN = """# intro
# Ⅰ. 장
## 1. 절
### 1) 가
### 나
#### (3) 다
(1) 적힌 번호
##### ① 라
##### 마
## 둘째 절
### 바
| 구분 | 값 | 비고 |
|---|:--|---|
| 가 | 1 | |
| 나 | | x |
텍스트 **굵게**
| only one |
- 항목
* 주
· 점
※ 참고
○ 원
####### 일곱
> 인용
```
"""


def test_markdown_grammar(spark):
    docs = spark.createDataFrame([(1, MARKDOWN)], "doc_id long, text string")
    got = [(r.type, r.text) for r in outline.paragraphs(docs).orderBy("seq").collect()]
    assert got == [
        ("H1", "Ⅰ. 장"), ("H2", "절"), ("H3", "1) 가"), ("H3", "2) 나"), ("H4", "(1) 다"), ("H4", "(1) 적힌 번호"), ("H5", "① 라"), ("H5", "② 마"), ("H2", "둘째 절"), ("H3", "1) 바"),
        ("L1", "가 — 값: 1"), ("L1", "나 — 비고: x"), ("L1", "텍스트 굵게"), ("L3", "항목"), ("note", "주"), ("L4", "· 점"), ("note", "※ 참고"), ("L2", "○ 원"),
    ]


def model_numbers(kinds):
    """Counters with resets, as a plain fold."""
    count, out = {"H3": 0, "H4": 0, "H5": 0}, []
    below = {"H1": ("H3", "H4", "H5"), "H2": ("H3", "H4", "H5"), "H3": ("H4", "H5"), "H4": ("H5",)}
    for kind, auto in kinds:
        for child in below.get(kind, ()):
            count[child] = 0
        if auto:
            count[kind] += 1
            n = count[kind]
            out.append({"H3": f"{n})", "H4": f"({n})", "H5": chr(0x245F + n) if n <= 20 else f"({n})"}[kind])
        else:
            out.append(None)
    return out


def test_numbering_against_a_model(spark):
    cases: list[list] = []

    @settings(max_examples=40, derandomize=True, database=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.sampled_from([("H1", False), ("H2", False), ("H3", True), ("H4", True), ("H5", True), ("H4", False), ("H5", False)]), max_size=30))
    def collect(kinds):
        cases.append(kinds)

    collect()
    cases.append([("H5", True)] * 23)
    rows = [(k, i, kind, "t", auto) for k, case in enumerate(cases) for i, (kind, auto) in enumerate(case)]
    got = outline.numbered(spark.createDataFrame(rows, "doc_id int, line_no int, type string, text string, auto boolean")).collect()
    for k, case in enumerate(cases):
        own = sorted((r.seq, r.text) for r in got if r.doc_id == k)
        assert [re.sub(" ?t$", "", t) or None for _, t in own] == model_numbers(case)


def test_page_breaks_contents_and_cover(spark):
    kinds = ["H2", "H1", "H2", "H2", "L1", "H1", "H2"]
    df = spark.createDataFrame([(1, i, k, f"cover {k}") for i, k in enumerate(kinds)], "doc_id int, seq int, type string, text string")
    got = [(r.h2_number, r.page_break) for r in outline.page_breaks(df).orderBy("seq").collect()]
    assert got == [(1, False), (0, True), (1, False), (2, True), (2, False), (0, True), (1, False)]
    assert outline.contents(df).count() == 6 and outline.cover_lines(df, ["L1", "none"]).count() == 1


def test_summary_table_edits(spark):
    rows = spark.createDataFrame([(1, r, c, f"{r}{c}") for r in range(4) for c in range(2)], "table_id int, row int, col int, text string")
    edits = spark.createDataFrame([(1, 1, 0, "new")], "table_id int, row int, col int, new_text string")
    got = sorted((r["row"], r.col, r.text) for r in outline.edit_summary(rows, ["11"], edits).collect())
    assert got == [(0, 0, "00"), (0, 1, "01"), (1, 0, "new"), (1, 1, "21"), (2, 0, "30"), (2, 1, "31")]


@pytest.fixture(scope="module")
def long_lines(spark):
    """Documents of some thousand lines, one of them with a null id."""
    import random

    rng = random.Random(8)
    marks = ["body line 다", "# Ⅰ. x", "# 제목", "#  Ⅰ. y", "## x", "### x", "### 1) x", "#### x", "##### x", "□ x", "❍ x", "- x", "· x", "※ x", "", "---", "□ ", "짧은 줄"]
    rows = []
    for doc, n in ((1, 4000), (2, 3), (3, 700), (None, 900)):
        weights = [rng.random() ** 3 for _ in marks]
        rows += [(doc, k, rng.choices(marks, weights)[0]) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, line_no int, raw string").repartition(5).cache()


@pytest.mark.parametrize("segment", [1, 7, 1000, 10_000])
def test_segments_give_what_windows_give(long_lines, segment):
    def same(a, b):
        assert a.columns == b.columns and a.exceptAll(b).count() == 0 == b.exceptAll(a).count() and a.count() > 1000

    same(lines.blocks(long_lines, segment=segment), lines.blocks(long_lines))
    heads = outline.classified(long_lines.withColumnRenamed("raw", "s"))
    same(outline.numbered(heads, segment), outline.numbered(heads))
    found = outline.numbered(heads)
    same(outline.page_breaks(found, segment), outline.page_breaks(found))


def test_a_long_document_takes_many_tasks(spark):
    """300,000 lines of one document: no task gets more than a segment or two."""
    rows = spark.range(300_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("line_no"), F.when(F.col("id") == 5, "# 제목").when(F.col("id") % 1000 == 999, "# Ⅰ. x").when(F.col("id") % 7 == 6, "- x").otherwise("body 다").alias("raw"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        got = lines.blocks(rows, segment=10_000)
        largest = got.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.count("*")).first()
        assert largest[0] <= 50_000 and largest[1] >= 12
        titles = got.filter("level = -1").collect()
        assert [r.line_no for r in titles] == [5]
        assert got.filter("level = 1").count() == 300
        assert {r.parent_level for r in got.filter("line_no > 1000 and level = 8").select("parent_level").distinct().collect()} == {1}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_large_documents_are_told_by_their_text(spark):
    docs = spark.createDataFrame([(1, "# 제목\n□ a\n" * 50), (2, "# 제목\n- b"), (3, None)], "doc_id long, text string")
    whole = lines.blocks(lines.lines(docs))
    parts = lines.blocks_of(docs, most=100, segment=3)
    assert parts.exceptAll(whole).count() == 0 == whole.exceptAll(parts).count()
