"""Queries whose operators work on containers, record streams, headers and long documents: their
inputs are made of the given tables, written where need be, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import forms, lines, outline, verify
from quire.plans import manuscript, oracle, queries
from quire.plans.manuscript import raw_lines, table
from quire.sources import builder, containers, headers, packages, records, shared

HEAD = f'<hh:head xmlns:hh="{packages.SPACES["hh"]}"><hh:refList>'
#: A template's section: section properties, the forms of two headings, and text that goes.
SECTION = (
    f'<hs:sec xmlns:hs="{packages.SPACES["hs"]}" xmlns:hp="{packages.SPACES["hp"]}"><hp:p><hp:run><hp:secPr/></hp:run></hp:p><hp:p><hp:run><hp:t>h1</hp:t></hp:run></hp:p>'
    "<hp:p><hp:run><hp:t>h2</hp:t></hp:run></hp:p><hp:p><hp:run><hp:t>old</hp:t></hp:run></hp:p></hs:sec>"
)
TEMPLATE = {"mimetype": "application/hwp+zip", "Contents/header.xml": HEAD + "</hh:refList></hh:head>", "Contents/section0.xml": SECTION, "Contents/content.hpf": "<opf:package><opf:manifest></opf:manifest></opf:package>"}


def _written(spark, sf_dir) -> str:
    """The folder of packages made of all manuscripts."""
    found = queries._outline(spark, sf_dir)
    null = F.lit(None).cast("string")
    path = F.concat(F.lit("m"), "doc_id", F.lit(".hwpx")).alias("path")
    paragraphs = found.select(path, "seq", "type", "text", null.alias("para"), null.alias("char"), null.alias("style"))
    # Every step of the build asks for the documents: they are found once.
    documents = shared.cut(manuscript.documents(spark, sf_dir).select(path)).select("path", F.lit("t").alias("template"))
    templates = spark.createDataFrame([("t", k, bytearray(v.encode()), None) for k, v in TEMPLATE.items()], packages.PARTS)
    folder = shared.fresh_dir(spark, "packages")
    builder.write(builder.build(documents, paragraphs, templates), folder)
    return folder


def _doc(path: Column) -> Column:
    return F.regexp_extract(path, r"m(\d+)\.hwpx$", 1).cast("long")


def package_texts(spark, sf_dir) -> DataFrame:
    parts = containers.read(spark, _written(spark, sf_dir), "*.hwpx").filter("part = 'Contents/section0.xml'")
    found = packages.paragraphs(parts).filter("para_index > 0")
    return found.groupBy(_doc(F.col("path")).alias("doc_id")).agg(F.count("*").alias("n_paragraphs"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_index", "all_text"))), lambda r: r["all_text"]), "\n")).alias("text"))


def package_verified(spark, sf_dir) -> DataFrame:
    parts = containers.read(spark, _written(spark, sf_dir), "*.hwpx")
    figures = verify.part_figures(packages.as_xml(parts).withColumn("doc_id", _doc(F.col("path"))))
    names = ("File Structure", "Manifest Integrity", "Namespace Pollution", "Table treatAsChar", "Lineseg Anomaly")
    return verify.run(figures, [c for c in verify.COMMON if c.name in names])


def _little(number: Column, n: int) -> Column:
    """A number as bytes, the lowest first."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(number, 8 * k).bitwiseAND(255)), 2, "0") for k in range(n))))


def record_texts(spark, sf_dir) -> DataFrame:
    """Streams of records: of each brand the names of its parts, with a record of another tag behind each."""
    part = table(spark, sf_dir, "part")
    data = F.encode(F.concat("p_name", F.lit(" ")), "UTF-16LE")
    record = F.concat(_little(F.lit(records.PARAGRAPH_TEXT) + F.shiftleft(F.octet_length(data).cast("long"), 20), 4), data, _little(F.lit(5 + (2 << 20)).cast("long"), 4), F.unhex(F.lit("4142")))
    rows = part.groupBy(F.col("p_brand").alias("path"), F.concat(F.lit("BodyText/Section"), F.col("p_size") % 12).alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", record.alias("r")))), lambda x: F.hex(x["r"])).alias("all"))
    streams = rows.select("path", "name", F.unhex(F.array_join("all", "")).alias("data"))
    header = part.select(F.col("p_brand").alias("path"), F.lit("FileHeader").alias("name"), F.unhex(F.repeat(F.lit("00"), 40)).alias("data")).distinct()
    found = records.texts(streams.unionByName(header), None)
    return found.select(F.col("path").alias("p_brand"), F.md5("text").alias("text"), "source", "error")


def segmented_levels(spark, sf_dir) -> DataFrame:
    """Blocks by segments of a few lines, as for documents larger than a task."""
    rows = lines.blocks(raw_lines(spark, sf_dir).select("doc_id", "line_no", "raw"), segment=37)
    return rows.select("doc_id", "line_no", "level", "ambiguous", "parent_level")


def segmented_numbers(spark, sf_dir) -> DataFrame:
    rows = raw_lines(spark, sf_dir).select("doc_id", "line_no", F.trim("raw").alias("s"))
    found = outline.page_breaks(outline.numbered(outline.classified(rows), 23), 23)
    return found.select("doc_id", "seq", "type", "text", "h2_number", "page_break")


def merged_headers(spark, sf_dir) -> DataFrame:
    """Headers of brands: the small parts' styles take over those of the large ones."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")

    def header(rows: DataFrame) -> DataFrame:
        char = F.concat(F.lit('<hh:charPr id="'), k, F.lit('"><hh:fontRef hangul="'), F.col("p_size") % 7, F.lit('"/></hh:charPr>'))
        para = F.concat(F.lit('<hh:paraPr id="'), k, F.lit('" name="'), F.col("p_size"), F.lit('"/>'))
        font = F.concat(F.lit('<hh:fontface id="'), F.col("p_size") % 7, F.lit('" name="font '), F.col("p_size") % 7, F.lit('"/>'))
        join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "")
        own = rows.groupBy(F.col("p_brand").alias("path")).agg(join(font).alias("f"), join(char).alias("c"), join(para).alias("p"))
        xml = F.concat(F.lit(HEAD + "<hh:fontfaces>"), "f", F.lit("</hh:fontfaces><hh:charProperties>"), "c", F.lit("</hh:charProperties><hh:paraProperties>"), "p", F.lit("</hh:paraProperties></hh:refList></hh:head>"))
        return own.select("path", F.lit(builder.HEADER).alias("part"), F.encode(xml, "UTF-8").alias("data"))

    own, other = header(part.filter("p_size < 15")), header(part.filter("p_size >= 30"))
    runs = F.array_join(F.collect_list(F.concat(F.lit('<hp:p paraPrIDRef="'), k, F.lit('"><hp:run charPrIDRef="'), k, F.lit('"/></hp:p>'))), "")
    body = F.concat(F.lit(f'<hs:sec xmlns:hs="{packages.SPACES["hs"]}" xmlns:hp="{packages.SPACES["hp"]}">'), runs, F.lit("</hs:sec>"))
    section = part.filter("p_size >= 40").groupBy(F.col("p_brand").alias("path")).agg(F.encode(body, "UTF-8").alias("data")).select("path", F.lit("Contents/section0.xml").alias("part"), "data")
    merged = headers.merge(own, other, section).filter(F.col("part") == builder.HEADER)
    found = headers.nodes(merged).filter("kind <> 'fontface' or id >= 7 or name is not null")
    return found.groupBy(F.col("path").alias("p_brand"), "kind").agg(F.count("*").alias("n"), F.max("id").alias("last_id"), F.sum("id").alias("sum_id"))


def row_edits(spark, sf_dir) -> DataFrame:
    """Tables of order lines: each table's second row twice, then its first goes, then a row that is not there."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("para_index"), F.lit(0).alias("table_idx"), (F.col("l_linenumber") - 1).cast("int").alias("row"), F.col("l_partkey").alias("k"))
    cells = items.groupBy("doc_id", "para_index", "table_idx", "row").agg(F.min("k").cast("string").alias("text")).withColumn("col", F.lit(0))
    ops = F.array(*(F.struct(F.lit(n).alias("seq"), F.lit(at).alias("source_row"), F.lit(op).alias("op")) for n, at, op in ((0, 1, "duplicate"), (1, 0, "delete"), (2, 99, "delete"))))
    edits = cells.filter("doc_id % 3 <> 0").select("doc_id", "para_index", "table_idx").distinct().select("*", F.inline(ops))
    return forms.apply_row_ops(cells, edits).select("doc_id", "row", "text", "was_row")


QUERIES = {f.__name__: f for f in (package_texts, package_verified, record_texts, segmented_levels, segmented_numbers, merged_headers, row_edits)}

SQL = {
    "package_texts": f"with {oracle.OUTLINE} select doc_id, count(*) as n_paragraphs, md5(string_agg(text, chr(10) order by seq)) as text from outline group by doc_id",
    "package_verified": f"with {manuscript.SQL} select distinct doc_id, unnest(['File Structure', 'Manifest Integrity', 'Namespace Pollution', 'Table treatAsChar', 'Lineseg Anomaly']) as name, unnest(['common', 'common', 'advanced', 'advanced', 'advanced']) as category, true as passed from raw_lines",
    "record_texts": "with s as (select p_brand, p_size % 12 as n, string_agg(p_name || ' ', '' order by p_partkey) as t from part group by all) select p_brand, md5(string_agg(regexp_replace(t, ' {2,}', ' ', 'g'), chr(10) order by n)) as text, 'body' as source, null::varchar as error from s group by p_brand",
    "segmented_levels": f"with {oracle.BLOCKS} select doc_id, line_no, level, ambiguous, parent_level from blocks",
    "segmented_numbers": f"""with {oracle.OUTLINE}, c as (select *, count(*) filter (type = 'H1') over (partition by doc_id order by seq) as chapter from outline),
n as (select *, count(*) filter (type = 'H2') over (partition by doc_id, chapter order by seq) as h2_number from c)
select doc_id, seq, type, text, h2_number, type = 'H1' or (type = 'H2' and h2_number >= 2) as page_break from n""",
    "merged_headers": """with o as (select p_brand as b, p_partkey as k, p_size % 7 as f from part where p_size < 15), t as (select p_brand as b, p_partkey as k, p_size % 7 as f from part where p_size >= 40),
top as (select b, max(k) as top from o group by b),
ids as (select b, 'charPr' as kind, k as id from o union all select b, 'paraPr', k from o
  union all select t.b, x.kind, top + row_number() over (partition by t.b, x.kind order by t.k) from t join top using (b), (values ('charPr'), ('paraPr')) x(kind)),
mine as (select distinct b, f from o), fresh as (select distinct b, f from t where b in (select b from top) and not exists (select 1 from mine m where m.b = t.b and m.f = t.f)),
fonts as (select b, 'fontface' as kind, f as id from mine union all select f.b, 'fontface', (select max(m.f) from mine m where m.b = f.b) + row_number() over (partition by f.b order by f.f) from fresh f)
select b as p_brand, kind, count(*) as n, max(id)::bigint as last_id, sum(id)::bigint as sum_id from (select * from ids union all select * from fonts) group by all""",
    "row_edits": """with c as (select l_orderkey as doc_id, (l_linenumber - 1)::int as row, min(l_partkey)::varchar as text from lineitem group by all),
n as (select doc_id, max(row) as last from c group by doc_id)
select doc_id, row, text, row as was_row from c where doc_id % 3 = 0
union all select doc_id, (case when row = 1 then 0 else row end)::int, text, row from c where doc_id % 3 <> 0 and row >= 1
union all select doc_id, 1, '', null from c where doc_id % 3 <> 0 and row = 1""",
}
