"""What keeps the seconds and the memory of large tables: values against plain ones, and shapes of plans."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import scans
from quire.functions import text as X
from quire.operators import lines, outline, resolve
from quire.plans import files, further, queries
from quire.sources import containers, packages


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_trimmed_signs_are_the_blanks(spark):
    signs = spark.createDataFrame([(chr(k),) for k in range(1, 0x10000) if not 0xD800 <= k < 0xE000], "c string")
    got = {r.c for r in signs.filter(F.col("c").rlike(f"(?U)^{X.BLANK}$")).collect()}
    assert got == set(X.BLANKS)
    assert "regexp" not in plan_of(spark.range(1).select(X.strip(F.col("id").cast("string")))).lower()


@pytest.mark.parametrize("segment", [None, 3])
def test_counts_since_a_reset_with_equal_numbers(spark, segment):
    rows = [(k, at, what) for k in (1, 2, None) for at, what in [(0, "i"), (1, "r"), (1, "i"), (1, "i"), (2, "i"), (4, "b"), (4, "i"), (5, "x"), (9, "i"), (13, "r"), (13, "x"), (14, "i"), (20, "i")]]
    df = spark.createDataFrame(rows, "doc_id int, line_no int, what string")
    counts = {"n": (F.col("what").isin("r", "b"), F.col("what").isin("i", "b"))}
    got = scans.since(df, counts, segment).select("doc_id", "line_no", "what", "n").collect()

    def plain(doc, at):
        resets = [a for d, a, w in rows if d == doc and w in "rb" and a <= at]
        return sum(1 for d, a, w in rows if d == doc and w in "ib" and (not resets or a >= max(resets)) and a <= at)

    assert sorted(map(tuple, got), key=repr) == sorted(((d, a, w, plain(d, a)) for d, a, w in rows), key=repr)


def test_counts_share_one_sort(spark, small):
    assert plan_of(queries.auto_numbering(spark, small)).count("Sort [") == 2  # one for the manuscript's line numbers
    assert plan_of(queries.page_breaks(spark, small)).count("Sort [") == 2


def test_segments_make_their_rows_once(spark, small):
    df = lines.blocks(spark.createDataFrame([(1, 0, "a")], "doc_id int, line_no int, raw string"), segment=5)
    df.collect()
    plan = plan_of(df).split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 2


def test_what_is_decided_on_is_written_without_texts(spark, small):
    assert set(queries._levels(spark, small).columns) == {"doc_id", "line_no", "level", "ambiguous"}


def test_majority_is_the_vote(spark):
    df = spark.range(400).select(F.lit(1).alias("doc_id"), F.col("id").alias("line_no"), F.when(F.col("id") % 7 > 0, (F.col("id") % 11).cast("int")).alias("near"), *((F.xxhash64("id", F.lit(k)) % 4 + 4).cast("int").alias(f"d{k}") for k in range(5)))
    own = df.select("doc_id", "line_no", resolve.majority([F.col(f"d{k}") for k in range(5)], F.col("near")).alias("v")).select("doc_id", "line_no", "v.level", "v.votes")
    draws = df.select("doc_id", "line_no", "near", F.posexplode(F.array(*(f"d{k}" for k in range(5)))).alias("draw", "level"))
    assert sorted(own.collect()) == sorted(resolve.vote(draws).collect())


def test_ensemble_vote_needs_no_aggregate(spark, small):
    assert "Aggregate" not in plan_of(queries.ensemble_vote(spark, small))


def test_only_the_rule_of_the_first_sign(spark):
    signs = list(lines.MARKS) + ["a", " ", ">", "\u3000"]
    rests = ["", " ", " x", "x", "1) x", "1)x", "12) ", "- x", "# x", "## Ⅰ", "\u3000x"]
    raws = [(pad + s * n + r,) for pad in ("", " ", "\u3000") for s in signs for n in (1, 2, 3) for r in rests]
    df = spark.createDataFrame(raws, "raw string").distinct()
    old = F
    for level, pattern in lines.RULES:
        old = old.when(lines._has(F.col("raw"), pattern), level)
    skipped = F.lit(False)
    for pattern in lines.SKIPPED:
        skipped = skipped | lines._has(F.col("raw"), pattern)
    assert df.filter(~lines.level_of(F.col("raw")).eqNullSafe(old.otherwise(lines.BODY)) | ~lines.skipped(F.col("raw")).eqNullSafe(skipped)).collect() == []


XMLS = ["<a/>", '<ns0:a xmlns:ns0="u">&amp;lt;b</ns0:a>', ' \u3000<?xml version="1.0"?><a/>', "<a>&amp;amp;amp; ns1 &amp;</a>", '<a treatAsChar="1" horzRelTo="COLUMN" vertsize="12345" ns2:k="v"/>', '<a vertsize="123"/>', ""]


@pytest.mark.parametrize("tables", [False, True])
def test_repair_step_by_step_is_the_whole_repair(spark, tables):
    xml = F.col("x")
    for pattern, to in packages.PREFIXES:
        xml = F.regexp_replace(xml, pattern, to)
    for name in packages.ENTITIES:
        xml = F.replace(xml, F.lit(f"&amp;{name};"), F.lit(f"&{name};"))
    for pattern, to in packages.FLOWING if tables else ():
        xml = F.regexp_replace(xml, pattern, to)
    head = F.lit('<?xml version="1.0" encoding="UTF-8"?>\n')
    want = F.when(F.regexp_replace(xml, f"(?U)^{X.BLANK}+", "").startswith("<?xml"), xml).otherwise(F.concat(head, xml))
    df = spark.createDataFrame([(x,) for x in XMLS], "x string")
    part = F.lit("Contents/section0.xml" if tables else "Contents/header.xml")
    by_rows = packages.repaired(df.select(F.col("x").alias("path"), part.alias("part"), F.encode("x", "UTF-8").alias("data"))).select("path", F.decode("data", "UTF-8"))
    expected = sorted(map(tuple, df.select("x", want).collect()))
    assert sorted(map(tuple, df.select("x", packages.repair(F.col("x"), tables)).collect())) == expected
    assert sorted(map(tuple, by_rows.collect())) == expected


def test_paragraphs_are_read_in_one_walk():
    p = "<p><run><t>a</t><t/><x><t>b</t></x></run></p><p><t>c</t></p><p/><p><run><t>d</t><tbl><tr><tc><p><run><t>e</t></run></p></tc></tr></tbl></run><run/></p><p><x><run><t>f</t></run></x></p><p><run><tbl><t>g</t></tbl></run></p><q/><p><run><t>h</t></run><run><t>i</t></run><t>j</t></p>"
    tree = ET.fromstring(f'<s xmlns="u">{p}</s>')
    want = [(i, packages._own_text(n), packages._texts(n), len(packages._tables(n))) for i, n in enumerate(packages._children(tree, "p"))]
    assert list(packages._paragraph_rows(tree)) == want and len(want) == 7


def test_repair_is_written_once_in_the_plan(spark):
    parts = spark.createDataFrame([("a", "Contents/section0.xml", bytearray(b"<a/>"))], "path string, part string, data binary")
    plan = packages.repaired(parts).filter("data is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xmlns:ns") == 1


def test_package_documents_need_no_line_numbers(spark, small):
    plan = files.manuscript.documents(spark, small)
    assert "Window" not in plan_of(plan) and plan.count() == queries.raw_lines(spark, small).select("doc_id").distinct().count()


def test_many_small_packages_share_a_task():
    found = [(f"p/{k}", 5_000) for k in range(4_000)]
    assert len(containers.planned(found)) < 10
    spread = containers.planned(found, tasks=32)
    assert 32 <= len(spread) <= 40 and [f for s in spread for f in s.files] == found
    assert len(containers.planned(found[:5], tasks=32)) == 1
    large = containers.planned([("a", 10), ("b", 200 << 20), ("c", 10)], tasks=4)
    assert [(s.files[0][0], s.lo, s.hi) for s in large] == [("b", at << 20, (at + 64) << 20 if at < 192 else None) for at in (0, 64, 128, 192)] + [("a", 0, None)]


def test_small_parts_are_handed_on_together(tmp_path):
    sizes = [10] * 40 + [3 << 20] * 2 + [10] * 40
    for k, size in enumerate(sizes):
        with zipfile.ZipFile(tmp_path / f"{k:03}.hwpx", "w") as z:
            z.writestr("mimetype", b"m")
            z.writestr("Contents/section0.xml", bytes([k]) * size)
    reader = containers._Reader({"path": f"file://{tmp_path}"}, ["path", "part", "data"])
    batches = [b for s in reader.partitions() for b in reader.read(s)]
    rows = [r for b in batches for r in b.to_pylist()]
    assert [(r["path"][-8:-5], r["part"], len(r["data"])) for r in rows] == [(f"{k:03}", part, n) for k, size in enumerate(sizes) for part, n in (("mimetype", 1), ("Contents/section0.xml", size))]
    assert len(batches) < 10 and all(b.num_rows == 1 for b in batches if any(len(r["data"]) > containers.BATCH_BYTES for r in b.to_pylist()))


def test_signs_of_flowing_tables():
    fits = ['a treatAsChar="1"', 'horzRelTo="COLUMN" b', 'vertsize="12345"']
    assert all(any(re.search(p, x) for p, _ in packages.FLOWING) and any(s in x for s in packages.FLOWING_SIGNS) for x in fits)
    assert len(packages.FLOWING_SIGNS) == len(packages.FLOWING) and all(p.startswith(s) for (p, _), s in zip(packages.FLOWING, packages.FLOWING_SIGNS, strict=True))


def test_section_properties_come_first_and_cost_no_union(spark):
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x<"), ("b", 1, "z")], "path string, seq int, text string").selectExpr("*", "null as para", "null as char", "null as style")
    properties = spark.createDataFrame([("a", "<hp:secPr/>"), ("c", "<hp:secPr k='1'/>")], "path string, xml string")
    df = packages.section_xml(rows, properties=properties)
    got = {r.path: bytes(r.data).decode().partition(">")[2].partition(">")[2] for r in df.collect()}
    p = lambda inner: f'<hp:p paraPrIDRef="0" styleIDRef="0"><hp:run charPrIDRef="0">{inner}</hp:run></hp:p>'
    t = lambda text: p(f"<hp:t>{text}</hp:t>")
    assert got == {k: v + "</hs:sec>" for k, v in {"a": p("<hp:secPr/>") + t("x&lt;") + t("y"), "b": t("z"), "c": p("<hp:secPr k='1'/>")}.items()}
    assert "Union" not in plan_of(df)


def test_package_documents_are_found_once(spark, small, monkeypatch):
    seen = {}
    monkeypatch.setattr(files.builder, "build", lambda documents, *_: seen.update(plan=plan_of(documents)) or documents)
    monkeypatch.setattr(files.builder, "write", lambda *_: None)
    files._written(spark, small)
    assert "lineitem" not in seen["plan"] and "Scan ExistingRDD" in seen["plan"]


def test_unwanted_lines_go_before_sorting(spark):
    kinds = ("H1", "H2", "H3", "H4", "H5", "L1", "note")
    rows = [(doc, at, kinds[(at * at + doc * at // 3 + doc) % 7], f"t{at % 5}", at % 3 > 0) for doc in range(6) for at in range(80)]
    df = spark.createDataFrame(rows, "doc_id int, line_no int, type string, text string, auto boolean").withColumn("auto", F.expr("auto and type in ('H3', 'H4', 'H5')"))
    whole, words = outline.numbered(df), ("t3", "2)")
    for held, then in (((), outline.contents), (words, lambda d: outline.cover_lines(d, words))):
        for segment in (None, 7):
            got = then(outline.numbered(df, segment, held)).collect()
            assert got and sorted(got) == sorted(then(whole).collect())
    few = outline.numbered(df, words=())
    assert few.count() == df.filter("type like 'H%'").count() < df.count()


@pytest.mark.parametrize("query", [queries.page_breaks, further.contents_lines, further.cover_lines])
def test_queries_of_heads_sort_few_lines(spark, small, query):
    plan = query(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    kept = plan.index("IN (H1,H2,H3,H4,H5)") if "IN (H1,H2,H3,H4,H5)" in plan else plan.index("INSET H1, H2, H3, H4, H5")
    assert plan.index("Window") < kept < plan.rindex("Window")  # the tree goes downwards: below the counts, above the line numbers
    if query is queries.page_breaks:
        assert r"^\d+\." not in plan  # its lines' texts are not made


def test_many_parts_are_not_broadcast(spark, small, monkeypatch):
    few, documents = queries.raw_lines(spark, small).collect(), files.manuscript.documents(spark, small).count()
    monkeypatch.setattr(files.manuscript, "MOST_PARTS", 10)
    for made, n in ((queries.raw_lines, len(few)), (files.manuscript.documents, documents)):
        df = made(spark, small)
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == n
    assert sorted(queries.raw_lines(spark, small).collect()) == sorted(few)
