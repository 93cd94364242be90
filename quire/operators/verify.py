"""Checks of finished documents as one wide aggregate, unpivoted, and rolled up to a grade.

A check is a name, a category and a condition over figures that one pass has collected; more
can be added to the list.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the checks look for.
PLACEHOLDERS = ("0.  0.", "월    일")
DOUBLE_BULLETS = ("□ □", "○ ○", "❍ ❍", "― ―", "- - ")
CHAPTERS = ("Ⅰ", "Ⅱ", "Ⅲ", "Ⅳ")
SYMBOLS = ("□", "○", "―", "※")
FORMAL = ("임", "음", "함", "됨")
VAGUE = ("할 수 있", "가능하다", "것이다")
EMPTY_CELLS = ("", "-", "(빈칸)")
LINES_PER_PAGE = 35


def occurrences(text: Column, part: str) -> Column:
    """How often a part stands in a text, without overlaps."""
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def text_figures(texts: DataFrame) -> DataFrame:
    """Figures of whole document texts (doc_id, text): counts of marks and endings."""
    text = F.col("text")
    total = lambda parts: sum((occurrences(text, p) for p in parts), F.lit(0.0)).cast("long")
    holds = lambda parts: sum((F.contains(text, F.lit(p)).cast("int") for p in parts), F.lit(0))
    return texts.select(
        "doc_id",
        (holds(PLACEHOLDERS) > 0).alias("placeholder"),
        total(DOUBLE_BULLETS).alias("double_bullets"),
        holds(CHAPTERS).alias("chapters"),
        holds(SYMBOLS).alias("symbols"),
        total(FORMAL).alias("formal"),
        total(VAGUE).alias("vague"),
    )


def part_figures(parts: DataFrame) -> DataFrame:
    """Figures of packages from their parts (doc_id, part, xml)."""
    part, xml = F.col("part"), F.coalesce(F.col("xml"), F.lit(""))
    first = part == "Contents/section0.xml"
    section = part.rlike(r"^Contents/section.*\.xml$")
    held = lambda signs: F.contains(xml, F.lit(signs))
    figures = parts.groupBy("doc_id").agg(
        F.bool_or(F.contains(part, F.lit("section"))).alias("has_section"),
        F.bool_or(part == "Contents/header.xml").alias("has_header"),
        F.bool_or(part == "Contents/content.hpf").alias("has_manifest"),
        F.bool_or(part == "Contents/section1.xml").alias("has_second"),
        F.sum(F.when(first & held('treatAsChar="1"'), F.regexp_count(xml, F.lit('treatAsChar="1"'))).otherwise(0)).alias("as_char"),
        F.sum(F.when(part.endswith(".xml") & (held("<ns") | held("</ns")), F.regexp_count(xml, F.lit(r"</?ns\d+:"))).otherwise(0)).alias("prefixes"),
        F.sum(F.when(first & held('vertsize="'), F.regexp_count(xml, F.lit(r'vertsize="\d{5,}"'))).otherwise(0)).alias("tall_lines"),
        F.collect_set(F.when(section, F.regexp_replace(part, r"^Contents/|\.xml$", ""))).alias("_sections"),
        F.max(F.when(part == "Contents/content.hpf", xml)).alias("_manifest"),
    )
    missing = F.filter("_sections", lambda s: ~F.contains(F.coalesce("_manifest", F.lit("")), s))
    return figures.withColumn("unreferenced", F.size(missing)).drop("_sections", "_manifest")


def fill_rates(cells: DataFrame) -> DataFrame:
    """(doc_id, total_cells, filled_cells, table_stats): the first five tables in words."""
    filled = ~F.coalesce("text", F.lit("")).isin(*EMPTY_CELLS)
    tables = cells.groupBy("doc_id", "table_no").agg(F.count("*").alias("n"), F.count_if(filled).alias("full"))
    said = F.concat(F.lit("Table"), F.col("table_no") + 1, F.lit(": "), F.col("full"), F.lit("/"), F.col("n"))
    rows = F.slice(F.array_sort(F.collect_list(F.struct("table_no", said.alias("said")))), 1, 5)
    return tables.groupBy("doc_id").agg(F.sum("n").alias("total_cells"), F.sum("full").alias("filled_cells"), F.array_join(F.transform(rows, lambda r: r["said"]), ", ").alias("table_stats"))


def keyword_figures(texts: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """(doc_id, keywords_found): whether all keywords stand in the text; none asked for is fine."""
    found = F.forall(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.col("text"), k)) if keywords else F.lit(True)
    return texts.select("doc_id", found.alias("keywords_found"))


@dataclass(frozen=True)
class Check:
    name: str
    category: str
    passes: Callable[[], Column]


COMMON = (
    Check("File Structure", "common", lambda: F.expr("has_section and has_header and has_manifest")),
    Check("Manifest Integrity", "common", lambda: F.expr("unreferenced = 0")),
    Check("Date Fields", "common", lambda: F.expr("not placeholder")),
    Check("Namespace Pollution", "advanced", lambda: F.expr("prefixes = 0")),
    Check("Table treatAsChar", "advanced", lambda: F.expr("as_char = 0")),
    Check("Lineseg Anomaly", "advanced", lambda: F.expr("tall_lines = 0")),
    Check("Bullet Duplication", "advanced", lambda: F.expr("double_bullets = 0")),
)
QUALITATIVE = (
    Check("Chapter Structure", "qualitative", lambda: F.expr("chapters >= 3")),
    Check("Symbol System", "qualitative", lambda: F.expr(f"symbols = {len(SYMBOLS)}")),
    Check("Writing Style", "qualitative", lambda: F.expr("formal > 20 and vague < 5")),
    Check("Page Count", "qualitative", lambda: (F.col("paragraphs") / LINES_PER_PAGE).between(10, 55)),
)
QUANTITATIVE = (
    Check("Table Fill Rate", "quantitative", lambda: F.expr("coalesce(filled_cells / nullif(total_cells, 0), 0) >= 0.5")),
    Check("Resume Section", "quantitative", lambda: F.expr("has_second")),
    Check("Company Data", "quantitative", lambda: F.expr("keywords_found")),
)


def run(figures: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """(doc_id, name, category, passed): a row for each document and check; what cannot be told has failed."""
    rows = F.array(*(F.struct(F.lit(c.name).alias("name"), F.lit(c.category).alias("category"), F.coalesce(c.passes(), F.lit(False)).alias("passed")) for c in checks))
    return figures.select("doc_id", F.inline(rows))


def grade(results: DataFrame) -> DataFrame:
    """(doc_id, passed, total, rate, grade, ok)."""
    df = results.groupBy("doc_id").agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))
    rate = F.round(F.when(F.col("total") > 0, F.col("passed") / F.col("total") * 100).otherwise(0.0), 4)
    df = df.withColumn("rate", rate)
    rate = F.col("rate")
    return df.withColumn("grade", F.when(rate >= 90, "Excellent").when(rate >= 70, "Good").when(rate >= 50, "Fair").otherwise("Poor")).withColumn("ok", rate >= 70)


def document_type(path: Column) -> Column:
    """Which further checks a file asks for, by its name."""
    name = F.lower(F.element_at(F.split(path, r"[/\\\\]", -1), -1))
    return F.when(F.contains(name, F.lit("정량")) | F.contains(name, F.lit("quantitative")), "quantitative").otherwise("qualitative")
