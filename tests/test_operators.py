from __future__ import annotations

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import checklist, events, forms, resolve, styles, transcripts, verify
from quire.plans import queries
from quire.sources import catalog, jsonio


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(
    "response, want",
    [
        ('[{"line_no": 1, "level": 2, "reason": "r"}]', [(1, 2)]),
        ('```json\n[{"line_no": 1, "level": 2}]\n```', [(1, 2)]),
        ('Sure: [{"line_no": 1, "level": 2}] done', [(1, 2)]),
        ('[{"line_no": 1, "level": 99}]', []),
        ('[{"line_no": 1, "level": 2}, {"line_no": 2, "level": 0}, {"line_no": 3, "le', [(1, 2), (2, 0)]),
        ('[{"line_no": "7", "level": 7.9}, {"line_no": "7.9", "level": 1}, 5, {"level": 1}, {"line_no": null, "level": 1}]', [(7, 7)]),
        ('{"line_no": 1, "level": 2}', []),
        ('{"items": [{"line_no": 1, "level": -1}]}', [(1, -1)]),
        ('[{"line_no": 1, "level": 2, "reason": "a } b"}, {"line_no": 2, "level": 3', [(1, 2)]),
        ("", []), (None, []), ("nothing", []),
    ],
)
def test_recovery(response, want):
    assert [(d["line_no"], d["level"]) for d in resolve.recover(response)] == want


def test_prompts_resolver_and_merge(spark):
    blocks = spark.createDataFrame([(1, 0, 0, "짧은", "짧은", True), (1, 1, 6, "x", "□ x", False), (2, 0, 1, "y", "# Ⅰ. y", False)], "doc_id int, line_no int, level int, text string, raw string, ambiguous boolean")
    asked = resolve.prompts(blocks, "A", "Z")
    row = asked.first()
    assert asked.count() == 1 and row.prompt[0] == "A" and row.prompt[-1] == "Z"
    assert json.loads(row.prompt[1:-1]) == [{"line_no": 0, "current_level": 0, "raw": "짧은", "context_before": [], "context_after": ["□ x"]}]
    answered = resolve.resolve(asked, lambda df: df.withColumn("response", F.lit('[{"line_no": 0, "level": 3}, {"line_no": 0, "level": 2}, {"line_no": 9, "level": 1}]')))
    merged = resolve.merge(blocks, resolve.decisions(answered))
    assert sorted((r.doc_id, r.line_no, r.level, r.outcome) for r in merged.collect()) == [(1, 0, 2, "changed"), (1, 1, 6, None), (2, 0, 1, None)]
    dry = resolve.merge(blocks, resolve.decisions(answered), dry_run=True)
    assert resolve.outcomes(dry).first().changed == 1 and dry.filter("line_no = 0 and doc_id = 1").first().level == 0


def test_costs(spark):
    calls = spark.createDataFrame([("gpt-4o", 1_000_000, 0, 0), ("never heard", 0, 1_000_000, 0)], "model string, tokens_in long, tokens_out long, tokens_think long")
    got = {r.model: (r.usd, r.krw, r.batch_usd, r.mean_price_in) for r in resolve.cost_report(calls).collect()}
    assert got == {"gpt-4o": (2.5, 3375.0, 1.25, 2.5), "never heard": (0.3, 405.0, 0.15, 0.0)}


@pytest.mark.parametrize(
    "label, want",
    [("설립년도", ("number", "년")), ("총 원", ("number", "명")), ("발행일", ("date", "")), ("전화번호", ("text", "")), ("회사 주소", ("multiline", "")), ("금액", ("number", "원")), ("E-Mail", ("text", "")), ("", ("text", "")), ("건수", ("number", "건"))],
)
def test_hints(spark, label, want):
    assert tuple(one(spark, label, forms.hint)) == want


def test_segments(spark):
    texts = ["before", "[서식 1] a", "x", "[ 서식2 ] b", "[서식 1] again", "y"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, "no header")], "doc_id int, para_index int, text string")
    got = [(r.doc_id, r.para_index, r.form_id, r.segment) for r in forms.segment(df).orderBy("doc_id", "para_index").collect()]
    assert got == [(1, 1, "form_1", 1), (1, 2, "form_1", 1), (1, 3, "form_2", 2), (1, 4, "form_1", 3), (1, 5, "form_1", 3), (2, 0, "form_0", 0)]


def table_cells(spark, rows=4):
    return spark.createDataFrame([(1, 0, t, r, c, f"{t}{r}{c}") for t in range(2) for r in range(rows) for c in range(2)], "doc_id int, para_index int, table_idx int, row int, col int, text string")


def test_row_edits_fold_in_order(spark):
    ops = spark.createDataFrame([(1, 0, 0, 0, 1, "duplicate"), (1, 0, 0, 1, 0, "delete"), (1, 0, 0, 2, 99, "delete"), (1, 0, 0, 3, 0, "twirl")], "doc_id int, para_index int, table_idx int, seq int, source_row int, op string")
    out = forms.apply_row_ops(table_cells(spark), ops)
    first = sorted((r["row"], r.col, r.text, r.was_row) for r in out.filter("table_idx = 0 and col = 0").collect())
    assert [(a, c, d) for a, _, c, d in first] == [(0, "010", 1), (1, "", None), (2, "020", 2), (3, "030", 3)]
    assert out.filter("table_idx = 1").count() == 8
    edits = spark.createDataFrame([(1, 0, 0, 2, 0, "new"), (1, 0, 0, 0, 0, "lost")], "doc_id int, para_index int, table_idx int, row int, col int, new_text string")
    done = forms.update_cells(out.drop("was_row"), forms.remap_edits(edits, out))
    assert [r.text for r in done.filter("table_idx = 0 and col = 0").orderBy("row").collect()] == ["010", "", "new", "030"]


def test_shapes(spark):
    assert {(r.n_rows, r.n_cols) for r in forms.table_shape(table_cells(spark)).collect()} == {(4, 2)}


DATES = [
    ("a_2026-03-15.pdf", "2026-03-15"), ("a_2026.03.15.pdf", "2026-03-15"), ("a_20260315.pdf", "2026-03-15"), ("260315_a.pdf", "2026-03-15"), ("990315_a.pdf", "1999-03-15"), ("2026-13-15_20260316.pdf", "2026-03-16"),
    ("0000-01-01.pdf", None), ("plain.pdf", None), ("2026-02-30.pdf", None), ("x/2020-01-01/plain.pdf", None),
]


@pytest.mark.parametrize("name, want", DATES)
def test_dates_in_names(spark, name, want):
    assert one(spark, name, checklist.date_in_name) == (dt.date.fromisoformat(want) if want else None)


@pytest.mark.parametrize(
    "text, want",
    [("발급일: 2026년 3월 15일", "2026-03-15"), ("2026. 3. 15.", "2026-03-15"), ("2026-03-15", "2026-03-15"), ("20260315", "2026-03-15"), ("2020-01-01 접수, 발행일 2026 년 3 월 15 일", "2026-03-15"), ("발행일 " + "x" * 90 + "2026-03-15 2025-01-01", "2026-03-15"), ("2026-13-01", None), ("none", None)],
)
def test_dates_in_texts(spark, text, want):
    assert one(spark, text, checklist.date_in_text) == (dt.date.fromisoformat(want) if want else None)


def test_checklist_from_files_to_plan(spark):
    required = spark.createDataFrame([(0, "a", "A/B", True, 30, ["tax"]), (1, "b", "B", True, None, ["gone"]), (2, "c", "A_B", False, 5, ["TAX-2"]), (3, "d", "D", True, 1, ["plain"])], "seq int, id string, name string, is_required boolean, max_age_days int, hints array<string>")
    files = spark.createDataFrame([("f/tax_20260101.pdf",), ("f/Tax 2_20260301.pdf",), ("f/plain.doc",), ("f/other.txt",)], "path string")
    texts = spark.createDataFrame([("f/plain.doc", "발급일 2026-03-09"), ("f/tax_20260101.pdf", "2030-01-01")], "path string, text string")
    df = checklist.status(checklist.best(checklist.matches(required, checklist.dated(files, texts))), F.lit("2026-03-10").cast("date"))
    got = {r.id: (r.path, r.status, r.age_days, r.n_matches, r.issued_source) for r in df.collect()}
    assert got == {"a": ("f/Tax 2_20260301.pdf", "ok", 9, 2, "filename"), "b": (None, "missing", None, 0, None), "c": ("f/Tax 2_20260301.pdf", "warning", 9, 2, "filename"), "d": ("f/plain.doc", "ok", 1, 1, "text")}
    assert tuple(checklist.rollup(df).first()) == (2, 1, 1, 0, False)
    planned = checklist.plan(df)
    assert [(r.number, r.target) for r in planned.orderBy("seq").collect()] == [(1, "01_A_B.pdf"), (3, "03_A_B.pdf"), (4, "04_D.doc")]
    assert sorted(r.path for r in checklist.unmatched(files, planned).collect()) == ["f/other.txt", "f/tax_20260101.pdf"]
    again = checklist.plan(df, F.lit("same.pdf"))
    assert [r.target for r in again.orderBy("seq").collect()] == ["same.pdf", "same_1.pdf", "same_2.pdf"]
    assert checklist.report(df).first().report.count("\n") == 3


def test_dashboard(spark):
    now = 1_700_000_000.0
    rows = [(now, events.IMPRESSION, "coupang")] * 1000 + [(now, events.CLICK, "coupang")] * 30 + [(now - 90 * 86400, events.CLICK, "coupang"), (0.0, events.CLICK, "x"), (now + 9e6, events.FAILED, ""), (now, "other", "x")]
    df = spark.createDataFrame(rows, "ts double, event string, channel string")
    got = {r.channel: (r.impressions, r.clicks, r.load_failures, r.ctr, r.revenue_krw) for r in events.dashboard(df, F.timestamp_seconds(F.lit(now - 30 * 86400))).collect()}
    assert got == {"coupang": (1000, 30, 0, 0.03, 600.0), "unknown": (0, 0, 1, 0.0, 0.0), None: (1000, 30, 1, 0.03, 600.0)}
    assert tuple(events.dashboard(df.limit(0), F.lit("2020-01-01").cast("timestamp")).first())[1:] == (0, 0, 0, 0.0, 0.0)


def test_transcripts(spark):
    def rec(pos, kind, content, meta=False, boundary=False):
        return ("s", pos, kind, meta, boundary, json.dumps(content, ensure_ascii=False))

    rows = [
        rec(0, "user", "old ask"), rec(1, "system", "", boundary=True), rec(2, "user", "meta", meta=True), rec(3, "user", "<command-name>x"), rec(4, "user", [{"type": "text", "text": "## new ask sk-ant-" + "A" * 24 + "\nmore"}]),
        rec(5, "assistant", [{"type": "tool_use", "name": "Bash", "input": {"command": "git show 0123456789abcdef"}}, {"type": "tool_use", "name": "Edit", "input": {"file_path": "b.py"}}]),
        rec(6, "assistant", [{"type": "text", "text": "done"}, {"type": "tool_use", "name": "Edit", "input": {"path": "a.py"}}, {"type": "text", "text": " "}]),
    ]
    df = spark.createDataFrame(rows, "session_id string, pos int, type string, is_meta boolean, is_boundary boolean, content string")
    s = transcripts.signals(df).first()
    assert s.first_user_message.startswith("## new ask <REDACTED>") and s.last_assistant_text == "done" and s.topic == "new ask <REDACTED>" and s.slug == "new_ask_REDACTED"
    assert {(r.tool, r.n) for r in transcripts.tool_counts(df).collect()} == {("Bash", 1), ("Edit", 2)}
    assert transcripts.files_touched(df).first().files == ["a.py", "b.py"] and transcripts.commits(df).first().ids == ["0123456789"]
    assert transcripts.current(spark.createDataFrame([rec(i, "user", "x") for i in range(300)], df.schema)).count() == 200


def test_styles(spark):
    own = spark.createDataFrame([("char", 3), ("char", 10)], "group string, id long")
    other = spark.createDataFrame([("char", 9), ("char", 10), ("para", 2)], "group string, id long")
    ids = styles.new_ids(own, other)
    assert sorted(map(tuple, ids.collect())) == [("char", 9, 11), ("char", 10, 12), ("para", 2, 0)]
    content = spark.createDataFrame([("char", 9, "a"), ("char", 5, "b")], "group string, id long, v string")
    assert sorted(map(tuple, styles.rewrite_ids(content, ids).collect())) == [("char", 5, "b"), ("char", 11, "a")]
    assert one(spark, "59528", styles.paper) == "A4" and one(spark, "72000", styles.paper) == "254mm" and one(spark, "8504", lambda c: styles.millimetres(c, 1.0)) == 30.0


def test_verification(spark):
    parts = spark.createDataFrame([
        (1, "Contents/section0.xml", '<p vertsize="12000"/><ns0:p/>treatAsChar="1"'), (1, "Contents/section1.xml", ""), (1, "Contents/header.xml", ""), (1, "Contents/content.hpf", "section0"),
        (2, "Contents/section0.xml", ""),
    ], "doc_id int, part string, xml string")
    f = {r.doc_id: r for r in verify.part_figures(parts).collect()}
    assert (f[1].has_section, f[1].has_header, f[1].has_manifest, f[1].has_second, f[1].as_char, f[1].prefixes, f[1].tall_lines, f[1].unreferenced) == (True, True, True, True, 1, 1, 1, 1)
    assert not f[2].has_manifest and f[2].unreferenced == 1
    results = verify.run(verify.part_figures(parts).withColumn("placeholder", F.lit(None).cast("boolean")).withColumn("double_bullets", F.lit(0)), verify.COMMON)
    assert verify.grade(results).filter("doc_id = 2").first().passed == 4
    assert one(spark, "a/정량_제안.hwpx", verify.document_type) == "quantitative" and one(spark, "정량/x.hwpx", verify.document_type) == "qualitative"
    assert verify.keyword_figures(spark.createDataFrame([(1, "a b")], "doc_id int, text string"), ["a", "c"]).first().keywords_found is False


TEXT_CASES = [
    (X.looks_like_text, "", False), (X.looks_like_text, "우편번호 : 30148", True), (X.looks_like_text, "捤獥汤捯", False),
    (X.clean_controls, "捤獥\x01\x02우편\r\nb  c", " 우편\n\nb c"), (X.drop_noise_tokens, "捤獥 ab  知之爲知之不知爲不知是知也", "ab  知之爲知之不知爲不知是知也"),
    (X.safe_int, "1,234.9", 1234), (X.safe_int, "-7.9", -7), (X.safe_int, "x", 0), (X.semver, "v0.16.0-rc1", [0, 16, 0]), (X.semver, "2", [2, 0, 0]), (X.semver, "", [0, 0, 0]), (X.semver, "1.2.3.4", [1, 2, 3]),
    (lambda c: X.url_file_name(c, F.lit("d")), "https://x.org/a/b%20c+d.pdf?q=1", "b c+d.pdf"), (lambda c: X.url_file_name(c, F.lit("d")), "https://x.org/", "d"),
    (lambda c: X.circled_number(c.cast("int")), "20", "⑳"), (lambda c: X.circled_number(c.cast("int")), "21", "(21)"), (X.tier_rank, "Pro", 1), (X.tier_rank, "none", 0),
    (X.mask_email, "a@b.com, john.doe@x.org", "a***@b.com, j***@x.org"), (X.escape_html, "<a & 'b'>\t", "&lt;a &amp; &#x27;b&#x27;&gt;&nbsp;&nbsp;&nbsp;&nbsp;"), (lambda c: X.truncate(c, 3), "abcdef", "abc\n\n[... 이하 3 문자 생략]"), (lambda c: X.truncate(c, 6), "abcdef", "abcdef"),
    (X.topic, "\n## - `x` y\nz", "x` y"), (X.topic, "  ", "Session memory"), (X.slug, "a  b! 한글", "a_b_한글"), (X.safe_file_name, 'a<b>:c"', "a_b__c_"),
    (X.token_tier, "h.eyJ0aWVyIjoicHJvIn0.s", "pro"), (X.token_tier, "h.e30.s", "free"), (X.token_tier, "broken", "free"), (X.redact_secrets, "key AIza" + "x" * 30, "key <REDACTED>"), (X.strip, "　 a\x1f ", "a"),
]


@pytest.mark.parametrize("f, text, want", TEXT_CASES)
def test_text_functions(spark, f, text, want):
    assert one(spark, text, f) == want


def test_sensitive_keys(spark):
    df = spark.createDataFrame([({"API_KEY": "x", "home": "y", "dbPassword": "z"},)], "m map<string,string>")
    assert df.select(X.filter_sensitive(F.col("m")).alias("m")).first().m == {"API_KEY": "[Filtered]", "home": "y", "dbPassword": "[Filtered]"}


def test_required_documents(spark):
    items = [
        {"id": " a ", "name": "A", "max_age_days": 0, "filename_hints": ["x ", "", 3]}, {"id": "b"}, 5, {"id": "", "name": "n"}, {"id": "c", "name": "C", "is_required": False, "max_age_days": "90", "description": " d "},
        {"id": "d", "name": "D", "is_required": "false"}, {"id": "e", "name": "E", "max_age_days": "soon"}, {"id": 7, "name": "seven", "max_age_days": None},
    ]
    df = spark.createDataFrame([(1, json.dumps({"documents": items})), (2, "no json"), (3, "[]"), (4, None)], "tender int, response string")
    got = [(r.tender, r.id, r.name, r.is_required, r.max_age_days, r.hints, r.description) for r in jsonio.required_documents(df).orderBy("seq").collect()]
    assert got == [(1, "a", "A", True, None, ["x", "3"], ""), (1, "c", "C", False, 90, [], "d"), (1, "d", "D", True, None, [], ""), (1, "7", "seven", True, None, [], "")]


def test_log_skips_what_is_no_object(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts": 1.5, "event": "a"}\n5\nbroken {\n\n{"ts": 2, "event": "b", "x": 1}\n{"ts": \n')
    got = sorted((r.ts, r.event) for r in jsonio.read_log(spark, str(tmp_path), "ts double, event string").collect())
    assert got == [(1.5, "a"), (2.0, "b")]
    jsonio.append_log(spark.createDataFrame([(3.0, "c")], "ts double, event string"), str(tmp_path / "out"))
    jsonio.append_log(spark.createDataFrame([(4.0, "d")], "ts double, event string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path / "cat"))
    assert c.rows().count() == 0
    assert c.add("a", "A", "f.hwpx", "2026-01-01") == "f.hwpx" and c.add("b", "B", "f.hwpx", "2026-01-02") == "f_1.hwpx"
    for bad in (("a", "C"), ("c", "A")):
        with pytest.raises(ValueError):
            c.add(*bad, "g", "2026-01-01")
    with pytest.raises(ValueError):
        c.remove("a")
    c.set_default("b")
    c.remove("a")
    with pytest.raises(KeyError):
        c.set_default("a")
    assert [(r.id, r.is_default) for r in c.rows().collect()] == [("b", True)]
    names = spark.createDataFrame([("doc_v002.hwpx",), ("doc_v010_x.hwpx",), ("else_v099",)], "name string")
    assert catalog.next_version(names, "doc", ".hwpx").first().name == "doc_v011.hwpx"
    base = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    assert sorted(map(tuple, catalog.overlaid(base, base.limit(1).withColumn("value", F.lit("9"))).collect())) == [("a", "9"), ("b", "2")]


def test_releases(spark):
    from quire.functions import releases

    df = spark.createDataFrame([("0.9.0", "1.0.0", None, "0.8.0", "0.9.0", "p", "f"), ("0.7.0", "0.7.0", "", "0.8.0", None, "p", "f"), ("0.9.0", "2", "bad", None, "0.9.1", "p", None), ("1", "1.0.1", None, None, None, None, "f")], "cur string, new string, err string, least string, frm string, patch string, full string")
    c = F.col
    got = df.select(releases.update_available(c("cur"), c("new"), c("err")), releases.choose_asset(c("cur"), c("least"), c("frm"), c("patch"), c("full"))).collect()
    assert [tuple(r) for r in got] == [(True, "p"), (False, "f"), (False, "p"), (True, "f")]
    row = df.limit(1).select(releases.notice("by {x} at {y}.", x=c("cur"), y=c("err")), releases.is_generated(F.lit("None")), releases.is_generated(c("patch")), releases.digest(c("patch"))).first()
    assert tuple(row)[:3] == ("by 0.9.0 at .", False, True) and len(row[3]) == 64


def test_ensembles(spark):
    draws = spark.createDataFrame([(1, 0, None, 100, 10, 0, 1.0, 2.0), (1, 1, None, 100, 10, 10, 1.0, 2.0), (2, 0, "x", 5, 5, 5, 1.0, 1.0), (2, 1, None, 50, 5, 0, 1.0, 2.0), (3, 0, "x", 0, 0, 0, 1.0, 1.0)], "doc_id int, draw int, error string, tokens_in long, tokens_out long, tokens_think long, price_in double, price_out double")
    extra = spark.createDataFrame([(1, 200, 30, 0, 3.0, 4.0)], "doc_id int, tokens_in long, tokens_out long, tokens_think long, price_in double, price_out double")
    got = {r.doc_id: tuple(r)[1:] for r in resolve.ensemble(draws, extra).collect()}
    assert got == {1: (2, "aggregated", 400, 60, 2.0, 3.0), 2: (1, "single", 50, 5, 1.0, 2.0), 3: (0, "failed", 0, 0, 0.0, 0.0)}


def test_functions_in_sql(spark):
    import struct

    from quire.functions import sql
    from quire.sources import records

    sql.register(spark)
    text = "가나".encode("utf-16-le")
    data = struct.pack("<I", records.PARAGRAPH_TEXT | 3 << 10 | len(text) << 20) + text
    rows = spark.sql("select * from stream_records(:data)", args={"data": bytearray(data)}).collect()
    assert [tuple(r) for r in rows] == [(records.PARAGRAPH_TEXT, 3, 4, "가나")]
    assert spark.sql("""select parse_response('[{"line_no": 1, "level": 2}]')[0].level as v""").first().v == 2


def test_numbering_is_switched_off_for_some_styles(spark):
    from quire.sources import packages

    xml = '<hh:paraPr id="8"><a/><hh:heading type="NUMBER" x="1"/></hh:paraPr><hh:paraPr id="9"><b/></hh:paraPr><hh:paraPr id="1"><hh:heading type="NUMBER"/></hh:paraPr>'
    assert one(spark, xml, packages.without_numbering) == xml.replace("NUMBER", "NONE", 1)


def test_secrets_anywhere_in_a_text_are_hidden(spark, tmp_path):
    secret = "ghp_" + "c" * 32
    texts = ["x" * 200 + " " + secret + " " + "y" * 200, "x" * 40 + " " + secret + " " + "y" * 200, "x" * 200 + " " + secret + " y", "no secret " * 30, ""]
    spark.createDataFrame([(5 * i + 4, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.redacted, r.n_chars) for r in queries.redact_secrets(spark, str(tmp_path)).collect()}
    want = [t.replace(secret, "<REDACTED>") + " sk-short" for t in texts]
    assert got == {5 * i + 4: (hashlib.md5(t.encode()).hexdigest(), len(t)) for i, t in enumerate(want)}


def test_form_segments_returns_every_segmented_paragraph(spark, small):
    want = {(r.doc_id, r.para_index): (r.form_id, r.form_label, r.segment, r.r % 4 == 1) for r in forms.segment(queries._paragraphs(spark, small)).collect()}
    rows = queries.form_segments(spark, small).collect()
    assert len(rows) == len(want) and {(r.doc_id, r.para_index): (r.form_id, r.form_label, r.segment, r.is_table) for r in rows} == want
    places = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.para_index)):
        at = places.setdefault((r.doc_id, r.segment), [])
        assert r.form_table_ordinal == (len(at) if r.is_table else None)
        at += [1] * r.is_table


def test_responses_read_in_place_equal_recovered_ones(spark):
    texts = [
        '[{"line_no": 1, "level": 2, "reason": "r"}, {"line_no": 4, "level": -1, "reason": ""}]', ' [{"line_no": 1, "level": 2, "reason": "r"}]\n', '[{"line_no": 1, "level": 2}]', '[{"line_no": 1, "level": 99, "reason": "r"}]',
        '[{"line_no": "7", "level": 7.9, "reason": "r"}]', '[{"line_no": 1, "level": 2, "reason": "a [x] b"}]', '[{"line_no": 1, "level": 2, "reason": "r"}] [{"line_no": 2, "level": 2, "reason": "r"}]',
        '[{"line_no": 1, "level": 2, "reason": "r"}, {"li', '[]', '{"items": [{"line_no": 1, "level": 3, "reason": "x"}]}', None, "", '[{"line_no": 1, "level": 2, "reason": 5}]', '[{"line_no": 1, "level": 2, "reason": "r"},]',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, response string")
    got = {r.doc_id: [(d.line_no, d.level, d.reason) for d in r.parsed] for r in resolve.parsed_responses(df).collect()}
    assert got == {i: [(d["line_no"], d["level"], d["reason"]) for d in resolve.recover(t)] for i, t in enumerate(texts)}
    assert sorted(r.doc_id for r in resolve.unreadable(df).collect()) == [i for i, t in enumerate(texts) if not resolve.recover(t)]


def test_unreadable_responses_are_counted(spark):
    counted = spark.createDataFrame([(1, 5, 1, 1, 2, 1), (2, 4, 0, 0, 3, 1)], "doc_id int, total_ambiguous long, changed long, confirmed long, no_decision long, over_cap long")
    got = sorted(map(tuple, resolve.with_failures(counted, spark.createDataFrame([(2,), (9,)], "doc_id int")).collect()))
    assert got == [(1, 5, 1, 1, 2, 1, 0), (2, 4, 0, 0, 0, 1, 3)]


def test_events_for_the_log(spark):
    row = spark.range(1).select(events.impression(F.lit("adsense"), F.lit(1.5), slot="top").alias("i"), events.click(F.lit("coupang"), F.lit(2.0), partner=F.lit("p9")).alias("c"), events.load_failure(F.lit("x"), F.lit("r" * 300), F.lit(3.0)).alias("f")).first()
    assert tuple(row.i) == (1.5, "ad_impression", "adsense", "", "top") and tuple(row.c) == (2.0, "ad_click", "coupang", "p9", "")
    assert len(row.f.reason) == 120


def test_many_hints_run_through_one_automaton(spark, monkeypatch):
    """As the pairwise test tells; hints in one group or in many; no loop over pairs in the plan."""
    import random

    from quire.operators import checklist

    rng = random.Random(3)
    letters = "abc_ -가"
    files = [(f"/in/{''.join(rng.choice(letters) for _ in range(rng.randint(1, 12)))}.pdf", k) for k in range(300)] + [(None, 900), ("/in/.x", 901)]
    required = [(k, [("".join(rng.choice(letters) for _ in range(rng.randint(0, 4)))).upper() for _ in range(rng.randint(0, 5))] or None) for k in range(80)]
    f = spark.createDataFrame(files, "path string, size_bytes long").repartition(3)
    r = spark.createDataFrame(required, "seq int, hints array<string>")
    want = r.join(f, checklist.has_keyword(F.col("path"), F.col("hints")), "left").select("seq", "size_bytes")
    for most in (1 << 24, 30, 1):
        monkeypatch.setattr(checklist, "MOST_HINT_CHARS", most)
        got = checklist.matches(r, f)
        assert got.columns == ["seq", "hints", "path", "size_bytes"] and got.schema["seq"].dataType == r.schema["seq"].dataType
        assert got.select("seq", "size_bytes").exceptAll(want).count() == 0 == want.exceptAll(got.select("seq", "size_bytes")).count()
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert checklist.matches(r.filter("seq < 0"), f).count() == 0


def test_a_hundred_thousand_hints(spark, small):
    from quire.operators import checklist

    orders = spark.read.parquet(f"{small}/orders.parquet").select(F.concat(F.lit("/in/order_"), "o_orderkey", F.lit("_x.pdf")).alias("path"), "o_orderkey")
    required = spark.range(100_000).select(F.col("id").alias("seq"), F.array(F.concat(F.lit("order "), "id", F.lit("_X"))).alias("hints"))
    got = checklist.matches(required, orders).filter("path is not null")
    want = orders.filter("o_orderkey < 100000").count()
    assert got.count() == want and got.filter("seq <> o_orderkey").count() == 0


def test_plans_of_several_tenders(spark):
    from quire.operators import checklist

    rows = [(t, s, f"n{s % 2}", f"/in/{s}.pdf" if s != 1 else None) for t in ("a", "b") for s in range(4)]
    got = checklist.plan(spark.createDataFrame(rows, "tender string, seq int, name string, path string"), F.lit("same.pdf"), ["tender"])
    assert sorted(map(tuple, got.collect())) == [(t, s, s + 1, f"/in/{s}.pdf", f"same{m}.pdf") for t in ("a", "b") for s, m in ((0, ""), (2, "_1"), (3, "_2"))]


def test_writers_of_a_catalog_lose_nothing(spark, tmp_path):
    """Several writers at once: all entries are there, under names of their own; a double one fails once."""
    from concurrent.futures import ThreadPoolExecutor

    from quire.sources.catalog import Catalog, put_if_absent

    with ThreadPoolExecutor(4) as pool:
        names = list(pool.map(lambda k: Catalog(spark, str(tmp_path)).add(str(k), f"n{k}", "form.hwpx", "2024-01-01"), range(6)))
    rows = Catalog(spark, str(tmp_path)).rows().collect()
    assert sorted(r.id for r in rows) == list("012345") and sum(r.is_default for r in rows) == 1
    assert sorted(names) == sorted(r.file for r in rows) == ["form.hwpx", *(f"form_{k}.hwpx" for k in range(1, 6))]

    def double(_):
        try:
            return Catalog(spark, str(tmp_path)).add("x", "x", "x", "2024-01-01")
        except ValueError:
            return None

    with ThreadPoolExecutor(3) as pool:
        assert sorted(pool.map(double, range(3)), key=str) == [None, None, "x"]
    assert not put_if_absent(spark, str(tmp_path / "log/000000000000.json"), "other")


def test_versions_go_on(spark):
    from quire.sources.catalog import versioned

    names = spark.createDataFrame([("a_240101_v007.hwpx",), ("old_v003.hwpx",), ("none.hwpx",)], "name string")
    got = versioned(spark.createDataFrame([("y",), ("x",), ("y",)], "path string"), names, "draft", "240102")
    assert sorted(map(tuple, got.collect())) == [("x", "draft_240102_v008.hwpx"), ("y", "draft_240102_v009.hwpx")]
    assert versioned(spark.createDataFrame([("x",)], "path string"), names.limit(0), "d", "t").first().name == "d_t_v001.hwpx"


def test_a_report_has_all_its_rows_in_order(spark):
    from quire.operators import events

    rows = [(1.0, events.CLICK, "b"), (1.0, events.CLICK, "adsense"), (1.0, events.IMPRESSION, "a")]
    since = F.timestamp_seconds(F.lit(0))
    got = events.ordered(events.dashboard(spark.createDataFrame(rows, "ts double, event string, channel string"), since)).collect()
    assert [(r["rank"], r.channel, r.clicks) for r in got] == [(1, "adsense", 1), (2, "a", 0), (3, "b", 1), (4, None, 2)]
    empty = events.dashboard(spark.createDataFrame([], "ts double, event string, channel string"), since).collect()
    assert [tuple(r) for r in empty] == [(None, 0, 0, 0, 0.0, 0.0)]


def fold(n, ops):
    """Row edits one after the other on a plain list of (source, copied)."""
    rows = [(r, False) for r in range(n)]
    for at, op in ops:
        if 0 <= at < len(rows):
            if op == "delete":
                del rows[at]
            elif op == "duplicate":
                rows.insert(at + 1, (rows[at][0], True))
    return rows


def test_row_edits_by_runs_are_the_fold():
    import random

    rng = random.Random(2)
    for case in range(60):
        n = rng.choice([0, 1, 2, 7, 50])
        ops = [(rng.randint(-1, n + 3), rng.choice(["delete", "duplicate", "duplicate", "other"])) for _ in range(rng.choice([0, 5, 700]))]
        rows = forms.Rows(n)
        for op in ops:
            rows.edit(*op)
        got = [(first + k, copied) for _, first, length, copied in rows.runs() for k in range(length)]
        assert got == fold(n, ops), case
        assert [at for at, *_ in rows.runs()] == [sum(m for _, _, m, _ in list(rows.runs())[:k]) for k in range(len(list(rows.runs())))]


def test_a_hundred_thousand_row_edits(spark):
    import random

    rng = random.Random(4)
    n, ops = 20_000, [(k, rng.randrange(20_000), rng.choice(["delete", "duplicate"])) for k in range(100_000)]
    cells = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(0).alias("para_index"), F.lit(0).alias("table_idx"), F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), F.concat(F.lit("t"), "id").alias("text"))
    edits = spark.createDataFrame([(1, 0, 0, *op) for op in ops], "doc_id int, para_index int, table_idx int, seq int, source_row int, op string")
    got = sorted((r["row"], r.was_row, r.text) for r in forms.apply_row_ops(cells, edits).collect())
    want = [(k, None if copied else source, "" if copied else f"t{source}") for k, (source, copied) in enumerate(fold(n, [op[1:] for op in ops]))]
    assert got == want


def plain_objects(text):
    """Objects behind the first bracket, depth and quotes told character by character."""
    found, at, decoder = [], text.find("["), json.JSONDecoder()
    while at >= 0 and (at := text.find("{", at)) >= 0:
        try:
            value, at = decoder.raw_decode(text, at)
            found.append(value)
            continue
        except ValueError:
            pass
        depth, quoted, escaped, end = 0, False, False, -1
        for i in range(at, len(text)):
            c = text[i]
            if escaped or c == "\\":
                escaped = not escaped
            elif c == '"':
                quoted = not quoted
            elif not quoted and c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    end = i + 1
                    break
        if end < 0:
            break
        at = end
    return found


def test_recovery_of_random_cuts_and_of_long_responses():
    import random
    import time

    rng = random.Random(6)
    whole = json.dumps([{"line_no": k, "level": k % 11, "reason": rng.choice(['a } "b" \\ {', "plain", "\\", '"', "한글"])} for k in range(40)], ensure_ascii=False)
    for _ in range(600):
        text = whole[rng.randrange(40) : rng.randrange(len(whole))]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(['"', "{", "}", "\\", "[", "x", ""]) + text[at + rng.randrange(3) :]
        assert resolve._objects(text) == plain_objects(text), text

    def seconds(n):
        damaged = "[" + ", ".join('{"line_no": %d, "level": 1 "reason": "broken"}' % k for k in range(n)) + ', {"line_no": 1, "level": 1}'
        began = time.process_time()
        assert len(resolve._objects(damaged)) == 1
        return len(damaged), time.process_time() - began

    (short, a), (long, b) = seconds(20_000), seconds(230_000)
    assert long > 10_000_000 and b < 3 * a * long / short + 1
