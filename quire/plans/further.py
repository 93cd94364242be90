"""Queries for the plain operators, each with DuckDB SQL that states its own constants."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import releases
from quire.functions import text as X
from quire.operators import checklist, events, forms, lines, outline, resolve, styles, transcripts, verify
from quire.plans import oracle, queries
from quire.plans.manuscript import raw_lines, table
from quire.sources import shared


def _pick(values, k):
    return F.get(F.array(*map(F.lit, values)), k.cast("int"))


def dashboard_top(spark, sf_dir):
    return events.ordered(queries.channel_dashboard(spark, sf_dir)).select("rank", "channel", "clicks", "revenue_krw")


def _calls(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    name = _pick(("Bash", "Read", ""), F.col("turn") % 3)
    given = F.create_map(F.lit("file_path"), F.concat(F.lit("/src/"), F.col("turn") % 7, F.lit(".py")), F.lit("command"), F.concat(F.lit("git show "), F.sha1(F.col("conv_id").cast("string"))))
    content = F.to_json(F.array(F.struct(F.lit("tool_use").alias("type"), name.alias("name"), given.alias("input"))))
    boundary = (F.col("conv_id") % 4 == 0) & (F.col("turn") == 2)
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), F.col("role").alias("type"), F.lit(False).alias("is_meta"), boundary.alias("is_boundary"), content.alias("content"))


def tool_calls(spark, sf_dir):
    return transcripts.tool_counts(_calls(spark, sf_dir))


def touched_files(spark, sf_dir):
    return transcripts.files_touched(_calls(spark, sf_dir)).select("session_id", F.array_join("files", ",").alias("files"))


def commit_ids(spark, sf_dir):
    return transcripts.commits(_calls(spark, sf_dir)).select("session_id", F.array_join("ids", ",").alias("ids"))


def sensitive_keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    env = F.create_map(F.lit("API_KEY"), "c_name", F.lit("Region"), "c_mktsegment", F.lit("userPassword"), "c_name", F.lit("tokens"), "c_mktsegment")
    return c.select("c_custkey", F.explode(X.filter_sensitive(env)).alias("name", "value"))


def contents_lines(spark, sf_dir):
    return outline.contents(queries._outline(spark, sf_dir, ())).select("doc_id", "seq", "type", "text")


def cover_lines(spark, sf_dir):
    words = ("cold", "Ⅰ")
    return outline.cover_lines(queries._outline(spark, sf_dir, words), words).select("doc_id", "seq", "text")


def summary_edits(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"])
    cells = F.array(F.struct(F.lit(0).alias("col"), F.concat("l_returnflag", F.lit("-"), F.col("l_linenumber") % 3).alias("text")), F.struct(F.lit(1).alias("col"), F.col("l_linenumber").cast("string").alias("text")))
    items = items.groupBy("l_orderkey", "l_linenumber").agg(F.lit("A").alias("l_returnflag"))
    rows = items.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").cast("int").alias("row"), F.inline(cells))
    edits = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("table_id"), F.lit(0).alias("row"), F.lit(1).alias("col"), F.concat(F.lit("new "), "o_orderkey").alias("new_text"))
    return outline.edit_summary(rows, ("-2",), edits.distinct())


def style_entries(spark, sf_dir):
    found = styles.style_dict(queries.style_fallback(spark, sf_dir))
    return found.select("template", F.explode("styles").alias("type", "s")).select("template", "type", "s.para", "s.char", "s.style")


def table_shapes(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 10").alias("doc_id"), F.col("l_linenumber").alias("para_index"), F.lit(0).alias("table_idx"), (F.col("l_suppkey") % 7).alias("row"), (F.col("l_partkey") % 5).alias("col"))
    return forms.table_shape(cells)


def dated_by_text(spark, sf_dir):
    files = queries._files(spark, sf_dir)
    k = F.col("o_orderkey")
    told = F.when(k % 2 == 0, F.concat(F.lit("발행일 2011-0"), k % 9 + 1, F.lit("-1"), k % 10)).otherwise("no date")
    texts = table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 4").select(F.concat(F.lit("/in/"), F.col("o_custkey") % 10, F.lit("/profile_"), k, F.lit(".docx")).alias("path"), told.alias("text"))
    return checklist.dated(files, texts).select("path", "size_bytes", F.date_format("issued_date", "yyyy-MM-dd").alias("issued_date"), "issued_source")


def checklist_report(spark, sf_dir):
    return checklist.report(queries._status(spark, sf_dir))


def _parts(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    body = F.concat(F.repeat(F.lit('<hp:tbl treatAsChar="1"/>'), (k % 4).cast("int")), F.repeat(F.lit("<ns1:t/>"), (k % 5).cast("int")), F.lit('<x vertsize="'), F.repeat(F.lit("9"), (k % 7).cast("int")), F.lit('"/>'))
    manifest = F.concat(F.lit("<item>section0</item>"), F.when(k % 2 == 0, "<item>section1</item>").otherwise(""))
    part = lambda name, xml, there: F.when(there, F.struct(F.lit(name).alias("part"), xml.alias("xml")))
    every = F.array(
        part("mimetype", F.lit("application"), F.lit(True)),
        part("Contents/section0.xml", body, k % 11 != 0),
        part("Contents/section1.xml", F.lit("</ns2:q>"), k % 3 == 0),
        part("Contents/header.xml", F.lit(None).cast("string"), k % 7 != 0),
        part("Contents/content.hpf", manifest, k % 5 != 0),
    )
    return c.select(k.alias("doc_id"), F.inline(F.array_compact(every)))


def package_figures(spark, sf_dir):
    return verify.part_figures(_parts(spark, sf_dir))


def package_checks(spark, sf_dir):
    wanted = ("File Structure", "Manifest Integrity", "Namespace Pollution", "Table treatAsChar", "Lineseg Anomaly", "Resume Section")
    checks = [c for c in (*verify.COMMON, *verify.QUANTITATIVE) if c.name in wanted]
    return verify.run(verify.part_figures(_parts(spark, sf_dir)), checks)


def company_keywords(spark, sf_dir):
    return verify.keyword_figures(table(spark, sf_dir, "documents"), ("the", "and"))


def document_types(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.concat(_pick(("/정량/plan_", "/a/정량평가_", "/a/QUANTITATIVE-", "/quantitative/x"), F.col("c_custkey") % 4), F.col("c_custkey"), F.lit(".hwpx"))
    return c.select("c_custkey", verify.document_type(name).alias("document_type"))


def clean_controls(spark, sf_dir):
    text = F.concat("text", F.lit("\r\x01x  y\t\t"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.clean_controls(text)).alias("clean"))


def asset_choice(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    current = F.concat(F.lit("v1."), k % 3, F.lit("."), k % 5, F.lit("-rc"))
    chosen = releases.choose_asset(current, F.when(k % 2 == 0, "1.1.0"), F.when(k % 7 < 3, "1.1.3"), F.when(k % 4 != 0, F.concat(F.lit("patch"), k)), F.when(k % 6 != 0, F.concat(F.lit("full"), k)))
    return p.select("p_partkey", chosen.alias("asset"), releases.update_available(current, F.when(k % 8 != 0, "1.2"), F.when(k % 9 == 0, "gone")).alias("update"))


def url_file_names(spark, sf_dir):
    k = F.col("page_id")
    url = F.when(k % 4 == 0, F.concat(F.lit("http://h.example/a/b%20c"), k, F.lit(".pdf?x=1#y"))).when(k % 4 == 1, F.concat(F.lit("http://h.example/d/e+f"), k)).when(k % 4 == 2, "http://h.example/x/").otherwise("http://h.example/x/q%3Az")
    return table(spark, sf_dir, "pages").select("page_id", X.url_file_name(url, F.lit("file")).alias("name"))


def tiers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    tier = _pick(("pro", "team", "free", "gold"), k % 4)
    claims = F.when(k % 3 == 0, F.concat(F.lit('{"custom_claims":{"tier":"'), tier, F.lit('"}}'))).otherwise(F.concat(F.lit('{"tier":"'), tier, F.lit('"}')))
    body = F.rtrim(F.translate(F.base64(F.encode(claims, "UTF-8")), "+/", "-_"), F.lit("="))
    token = F.concat(F.lit("h."), body, F.when(k % 5 != 0, ".s").otherwise(""))
    return c.select("c_custkey", X.token_tier(token).alias("paid"), X.tier_rank(F.upper(tier)).alias("tier_rank"))


def html_escaped(spark, sf_dir):
    text = F.concat("text", F.lit("\t<a href='x'>\"&amp;\"</a>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.escape_html(text)).alias("escaped"))


def notices(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    said = releases.notice("{lang}: {n} characters from {who}", lang=F.col("lang"), n=F.col("n_chars").cast("string"), who=F.when(F.col("doc_id") % 3 != 0, F.col("source")))
    backend = _pick(("", "None", "gemini", "OFF", "local"), F.col("doc_id") % 5)
    return d.select("doc_id", said.alias("notice"), releases.is_generated(backend).alias("generated"))


def content_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", releases.digest(F.col("text")).alias("sha256"))


def failed_parses(spark, sf_dir):
    blocks = queries._levels(spark, sf_dir)
    counted = resolve.outcomes(resolve.merge(blocks, queries._decided(blocks).filter("doc_id % 5 <> 2")), most=40)
    answer = F.when(F.col("doc_id") % 5 == 2, _pick(("no array", "", "[]"), F.col("doc_id") % 3)).otherwise('[{"line_no": 0, "level": 1, "reason": "r"}]')
    return resolve.with_failures(counted, resolve.unreadable(blocks.select("doc_id").distinct().select("doc_id", answer.alias("response"))))


def log_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    channel, slot = _pick(("coupang", "adsense"), F.col("event_id") % 2), F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("string"))
    rows = e.select("event_id", events.impression(channel, F.col("event_id") / 2, slot=slot).alias("i"), events.click(channel, F.col("event_id") / 2, partner=slot).alias("c"))
    return rows.select("event_id", F.inline(F.array("i", "c")))


def font_remap(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    own = p.filter("p_size < 25").select(F.col("p_brand").alias("group"), (F.col("p_partkey") % 40).alias("id"), (F.col("p_partkey") % 40).cast("string").alias("name"))
    other = p.filter("p_size >= 25").select(F.col("p_brand").alias("group"), (F.col("p_partkey") % 90).alias("id"), F.expr("string(p_partkey % 90 div 2)").alias("name"))
    return styles.font_ids(own, other)


def character_css(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    made = p.select(k, F.when(k % 3 != 0, F.col("p_brand")).alias("font"), ((k % 7) * 2.5).alias("pt"), (k % 2 == 0).alias("b"), (k % 5 == 0).alias("i"), F.when(k % 4 != 1, k % 11 == 0).alias("u"), ((k % 4) / 2 - 0.5).alias("em"))
    return made.select("p_partkey", styles.char_css("font", "pt", "b", "i", "u").alias("char_css"), styles.para_css("em").alias("para_css"))


def dry_run_levels(spark, sf_dir):
    blocks = shared.cut(queries._blocks(spark, sf_dir))
    merged = resolve.merge(blocks, queries._decided(blocks), dry_run=True)
    return merged.groupBy("level").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "changed").alias("changed"))


def round_trip_types(spark, sf_dir):
    df = raw_lines(spark, sf_dir).select(((F.col("r") + F.col("line_no")) % 14 - 2).cast("int").alias("level"))
    kind = lines.type_of(F.col("level"))
    return df.groupBy("level").agg(F.count("*").alias("n")).select("level", kind.alias("type"), lines.level_of_type(kind).alias("back"), "n")


_CURRENT = """c as (select *, max(turn) filter (conv_id % 4 = 0 and turn = 2) over (partition by conv_id) as mark, row_number() over (partition by conv_id order by turn desc) as back from conversations),
s as (select * from c where role = 'assistant' and case when mark is not null then turn > mark else back <= 200 end)"""
_PACKAGES = """p as (select c_custkey as doc_id, c_custkey as k, c_custkey % 11 <> 0 as s0, c_custkey % 3 = 0 as s1, c_custkey % 7 <> 0 as h, c_custkey % 5 <> 0 as m from customer),
f as (select doc_id, s0 or s1 as has_section, h as has_header, m as has_manifest, s1 as has_second, case when s0 then k % 4 else 0 end::bigint as as_char,
  (case when s0 then k % 5 else 0 end + s1::int)::bigint as prefixes, (s0 and k % 7 >= 5)::bigint as tall_lines,
  ((s0 and not m)::int + (s1 and not (m and k % 2 = 0))::int)::int as unreferenced from p)"""
_CONTROLS = r"regexp_replace(regexp_replace(text || chr(13) || chr(1) || 'x  y' || chr(9) || chr(9) || doc_id, '[\n\r]', chr(10), 'g'), '[\x00-\x09\x0b\x0c\x0e-\x1f]', ' ', 'g')"

SQL = {
    "dashboard_top": f"""with {oracle.DASH}, t as (select channel, clicks, round(revenue, 6) as revenue_krw from earned union all select null, coalesce(sum(clicks), 0), round(coalesce(sum(revenue), 0), 6) from earned)
select row_number() over (order by channel is null, revenue_krw desc, channel)::int as rank, channel, clicks::bigint as clicks, revenue_krw from t""",
    "tool_calls": f"with {_CURRENT} select conv_id as session_id, (['Bash', 'Read', 'unknown'])[turn % 3 + 1] as tool, count(*) as n from s group by all",
    "touched_files": f"with {_CURRENT} select conv_id as session_id, string_agg(distinct '/src/' || (turn % 7) || '.py', ',' order by '/src/' || (turn % 7) || '.py') as files from s group by 1",
    "commit_ids": f"with {_CURRENT} select distinct conv_id as session_id, substr(sha1(conv_id::varchar), 1, 10) as ids from s",
    "sensitive_keys": "select c_custkey, unnest(['API_KEY', 'Region', 'userPassword', 'tokens']) as name, unnest(['[Filtered]', c_mktsegment, '[Filtered]', '[Filtered]']) as value from customer",
    "contents_lines": f"with {oracle.OUTLINE} select doc_id, seq, type, text from outline where type in ('H1', 'H2', 'H3')",
    "cover_lines": f"with {oracle.OUTLINE} select doc_id, seq, text from outline where contains(text, 'cold') or contains(text, 'Ⅰ')",
    "summary_edits": """with i as (select distinct l_orderkey as t, l_linenumber as r from lineitem), l as (select t, dense_rank() over (partition by t order by r) - 1 as row, r from i where r % 3 <> 2)
select t as table_id, row::int as row, 0 as col, 'A-' || (r % 3) as text from l union all select t, row::int, 1, case when row = 0 and t % 3 = 0 and t in (select o_orderkey from orders) then 'new ' || t else r::varchar end from l""",
    "style_entries": f"""with s as ({oracle.SQL['style_fallback']}) select template, (['body', 'H1', 'H2', 'H3', 'H4', 'H5', 'L1', 'L2', 'L3', 'L4', 'note'])[level + 1] as type, para, char, style from s where level >= 0""",
    "table_shapes": "select l_orderkey // 10 as doc_id, l_linenumber as para_index, 0 as table_idx, max(l_suppkey % 7) + 1 as n_rows, max(l_partkey % 5) + 1 as n_cols from lineitem group by 1, 2",
    "dated_by_text": f"""with {oracle.FILES} select path, size_bytes, case when issued is not null then strftime(issued, '%Y-%m-%d') when size_bytes % 10 = 4 then '2011-0' || (size_bytes % 9 + 1) || '-1' || (size_bytes % 10) end as issued_date,
  case when issued is not null then 'filename' when size_bytes % 10 = 4 then 'text' else 'unknown' end as issued_source from dated""",
    "checklist_report": f"with {oracle.FOUND} select string_agg(printf('%02d', seq) || ' | ' || name || ' | ' || status || ' | ' || coalesce(path, '-'), chr(10) order by seq) as report from judged",
    "package_figures": f"with {_PACKAGES} select * from f",
    "package_checks": f"""with {_PACKAGES}, c as (select doc_id, unnest([{{'n': 'File Structure', 'c': 'common', 'p': has_section and has_header and has_manifest}}, {{'n': 'Manifest Integrity', 'c': 'common', 'p': unreferenced = 0}},
  {{'n': 'Namespace Pollution', 'c': 'advanced', 'p': prefixes = 0}}, {{'n': 'Table treatAsChar', 'c': 'advanced', 'p': as_char = 0}}, {{'n': 'Lineseg Anomaly', 'c': 'advanced', 'p': tall_lines = 0}}, {{'n': 'Resume Section', 'c': 'quantitative', 'p': has_second}}]) as x from f)
select doc_id, x.n as name, x.c as category, x.p as passed from c""",
    "company_keywords": "select doc_id, contains(text, 'the') and contains(text, 'and') as keywords_found from documents",
    "document_types": "select c_custkey, case when c_custkey % 4 in (1, 2) then 'quantitative' else 'qualitative' end as document_type from customer",
    "clean_controls": f"with t as (select doc_id, {_CONTROLS} as text from documents) select doc_id, md5(regexp_replace({oracle._NOISE}, ' {{2,}}', ' ', 'g')) as clean from t",
    "asset_choice": """with v as (select p_partkey as k, [1, p_partkey % 3, p_partkey % 5] as now from part),
a as (select *, k % 4 <> 0 and (k % 2 = 1 or now >= [1, 1, 0]) and (k % 7 >= 3 or now >= [1, 1, 3]) as fits, case when k % 4 <> 0 then 'patch' || k end as patch, case when k % 6 <> 0 then 'full' || k end as whole from v)
select k as p_partkey, case when fits then patch else coalesce(whole, patch) end as asset, k % 8 <> 0 and k % 9 <> 0 and [1, 2, 0] > now as update from a""",
    "url_file_names": "select page_id, case page_id % 4 when 0 then 'b c' || page_id || '.pdf' when 1 then 'e+f' || page_id when 2 then 'file' else 'q_z' end as name from pages",
    "tiers": "select c_custkey, case when c_custkey % 5 = 0 then 'free' else (['pro', 'team', 'free', 'free'])[c_custkey % 4 + 1] end as paid, ([1, 2, 0, 0])[c_custkey % 4 + 1] as tier_rank from customer",
    "html_escaped": """with t as (select doc_id, text || chr(9) || '<a href=''x''>"&amp;"</a>' as t from documents)
select doc_id, md5(replace(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), chr(9), '&nbsp;&nbsp;&nbsp;&nbsp;')) as escaped from t""",
    "notices": "select doc_id, lang || ': ' || n_chars || ' characters from ' || case when doc_id % 3 <> 0 then source else '' end as notice, doc_id % 5 in (2, 4) as generated from documents",
    "content_digests": "select doc_id, sha256(text) as sha256 from documents",
    "failed_parses": f"""with {oracle.BLOCKS}, d as (select *, case when doc_id % 5 = 2 then null when line_no % 10 = 0 then level when line_no % 5 = 0 then (level + line_no) % 12 - 1 end as decided, row_number() over (partition by doc_id order by line_no) > 40 as over from blocks where ambiguous)
select doc_id, count(*) as total_ambiguous, count(*) filter (decided <> level and not over) as changed, count(*) filter (decided = level and not over) as confirmed,
  case when doc_id % 5 = 2 then 0 else count(*) filter (decided is null and not over) end as no_decision, count(*) filter (over) as over_cap, case when doc_id % 5 = 2 then count(*) filter (not over) else 0 end as failed_parse from d group by doc_id""",
    "log_events": """with e as (select event_id, event_id / 2 as ts, (['coupang', 'adsense'])[event_id % 2 + 1] as channel, case when event_id % 3 <> 0 then user_id::varchar else '' end as s from events)
select event_id, ts, 'ad_impression' as event, channel, '' as partner_id, s as ad_slot from e union all select event_id, ts, 'ad_click', channel, s, '' from e""",
    "font_remap": """with o as (select distinct p_brand as g, p_partkey % 40 as id, (p_partkey % 40)::varchar as name from part where p_size < 25), t as (select g, max(id) as top from o group by g),
f as (select distinct p_brand as g, p_partkey % 90 as id, (p_partkey % 90 // 2)::varchar as name from part where p_size >= 25),
n as (select f.g, f.name, min(f.id) as first from f left join o on o.g = f.g and o.name = f.name where o.id is null group by all), r as (select n.g, name, coalesce(top, 0) + row_number() over (partition by n.g order by first) as new_id from n left join t on t.g = n.g)
select f.g as "group", f.id as old_id, coalesce(o.id, r.new_id) as new_id from f left join o on o.g = f.g and o.name = f.name left join r on r.g = f.g and r.name = f.name""",
    "character_css": """with p as (select p_partkey, p_partkey as k, p_brand from part) select p_partkey, array_to_string(list_filter([
  case when k % 3 <> 0 then 'font-family: ''' || p_brand || ''', ''맑은 고딕'', sans-serif' end, case when k % 7 <> 0 then 'font-size: ' || printf('%.1f', k % 7 * 2.5) || 'pt' end, case when k % 2 = 0 then 'font-weight: bold' end,
  case when k % 5 = 0 then 'font-style: italic' end, case when k % 4 <> 1 and k % 11 = 0 then 'text-decoration: underline' end], lambda x: x is not null), '; ') as char_css, case when k % 4 = 2 then 'margin-left: 0.5em' when k % 4 = 3 then 'margin-left: 1.0em' else '' end as para_css from p""",
    "dry_run_levels": f"""with {oracle.BLOCKS}, d as (select *, case when line_no % 10 = 0 then level when line_no % 5 = 0 then (level + line_no) % 12 - 1 end as decided from blocks)
select level, count(*) as n, count(*) filter (ambiguous and decided <> level) as changed from d group by level""",
    "round_trip_types": f"""with {oracle.manuscript.SQL}, l as (select ((r + line_no) % 14 - 2)::int as level, count(*) as n from raw_lines group by 1), t as (select *, case level when -1 then 'H1' when 0 then 'body' when 1 then 'H1' when 2 then 'H2' when 3 then 'H3' when 4 then 'H4' when 5 then 'H5' when 6 then 'L1' when 7 then 'L2' when 8 then 'L3' when 9 then 'L4' when 10 then 'note' else 'body' end as type from l)
select level, type, case type when 'H1' then 1 when 'H2' then 2 when 'H3' then 3 when 'H4' then 4 when 'H5' then 5 when 'L1' then 6 when 'L2' then 7 when 'L3' then 8 when 'L4' then 9 when 'note' then 10 else 0 end as back, n from t""",
}

QUERIES = {name: globals()[name] for name in SQL}
