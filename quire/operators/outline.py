"""The second grammar: markdown paragraphs, numbering with resets, tables, page breaks.

Unlike `lines`, it splits at line feeds only, strips both ends, drops heads it does not know
and takes an unmarked line for a first-level item.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import scans
from quire.functions import text as T
from quire.functions.frames import once

_B = T.BLANK

# Marks that a paragraph style adds by itself.
AUTO_PREFIXES = {"L1": r"^[□■]\s*", "L2": r"^[❍○]\s*", "L3": r"^[-–—]\s*", "L4": r"^[·•]\s*", "note": r"^\*\s*"}

HEADS = ("H1", "H2", "H3", "H4", "H5")


def _u(pattern: str) -> str:
    return f"(?U){pattern}"


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, seq, type, text): `seq` orders them; numbers and table rows are worked in."""
    raw = docs.select("doc_id", F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "_raw"))
    rows = raw.select("doc_id", "line_no", T.strip(F.col("_raw")).alias("s"))
    return numbered(classified(rows).unionByName(tables(rows)))


def classified(rows: DataFrame) -> DataFrame:
    """(doc_id, line_no, type, text, auto): lines outside tables; `auto` heads are yet to be numbered."""
    # Each sign is looked at before the pattern that it begins; steps of their own keep the code that
    # Spark generates small enough for the JVM to compile.
    s = F.col("s")
    rows = once(rows.select("doc_id", "line_no", s.alias("_s")), s=F.col("_s"))
    left_out = (s == "") | s.startswith("---") | s.startswith("```") | s.startswith("> ") | _is_row(s)
    is_head = s.startswith("#")
    bare = F.ltrim(s, F.lit("#"))
    df = once(
        rows.filter(~left_out),
        _hashes=F.when(is_head, F.length(s) - F.length(bare)).otherwise(0),
        _head=F.when(is_head, T.strip(bare)),
        _plain=F.when(F.contains(s, F.lit("**")), F.regexp_replace(s, r"\*\*(.*?)\*\*", "$1")).otherwise(s),
    )
    hashes, head, plain = F.col("_hashes"), F.col("_head"), F.col("_plain")
    df = once(df, _sign=F.left(plain, F.lit(1)))
    sign = F.col("_sign")
    circled = sign.between("①", "⑳")
    marked = F.when((sign == "(") & plain.rlike(_u(rf"^\(\d+\){_B}+.+")), "H4").when(circled & plain.rlike("^[①-⑳]."), "H5").when(sign == "□", "L1")
    marked = marked.when(sign.isin("○", "❍"), "L2").when(sign == "·", "L4").when(sign == "※", "note")
    marked = marked.when(s.startswith("- "), "L3").when(s.startswith("* "), "note").otherwise("L1")
    kind = F.when(is_head, F.when((hashes == 1) & F.left(head, F.lit(1)).isin(*"ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ"), "H1").when(hashes.between(2, 5), F.concat(F.lit("H"), hashes))).otherwise(marked)
    df = once(df, type=kind).filter(F.col("type").isNotNull())
    heads = F.when(hashes == 2, F.regexp_replace(head, _u(rf"^\d+\.{_B}*"), "")).when(hashes == 3, F.regexp_replace(head, _u(rf"^\d+\){_B}*"), ""))
    heads = heads.when(hashes == 4, F.regexp_replace(head, _u(rf"^\(\d+\){_B}*"), "")).when(hashes == 5, F.regexp_replace(head, rf"^[①-⑳]{_B}*", "")).otherwise(head)
    bullets = (s.startswith("- ") | s.startswith("* ")) & ~(circled | sign.isin(*"□○❍·※"))
    value = F.when(is_head, heads).when(bullets & F.col("type").isin("L3", "note"), T.strip(F.substr(s, F.lit(3)))).otherwise(plain)
    # The last step is a plain projection: who does not ask for texts has none made.
    return df.select("doc_id", "line_no", "type", value.alias("text"), (is_head & hashes.between(3, 5)).alias("auto"))


def _is_row(s: Column) -> Column:
    return s.startswith("|") & s.endswith("|")


def _cells(row: Column) -> Column:
    parts = F.split(row, r"\|", -1)
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), T.strip)


def tables(rows: DataFrame) -> DataFrame:
    """Rows of pipe tables as items `first — head: value, …`; runs of lines are islands of their numbers."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    found = rows.filter(_is_row(F.col("s"))).withColumn("island", F.col("line_no") - F.row_number().over(order))
    island = Window.partitionBy("doc_id", "island").orderBy("line_no")
    found = found.withColumn("header", _cells(F.first("s").over(island))).withColumn("at", F.row_number().over(island))
    found = found.filter((F.col("at") > 1) & ~F.col("s").rlike(_u(r"^\|[\s\-|:]+\|$"))).withColumn("cells", _cells(F.col("s")))
    n = F.least(F.size("header"), F.size("cells"))
    pairs = F.zip_with(F.slice("header", F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice("cells", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda h, v: F.when(v != "", F.concat(h, F.lit(": "), v)))
    details = F.array_join(F.filter(pairs, lambda x: x.isNotNull()), ", ")
    first = F.coalesce(F.get("cells", 0), F.lit(""))
    return found.select("doc_id", "line_no", F.lit("L1").alias("type"), F.when(details != "", F.concat(first, F.lit(" — "), details)).otherwise(first).alias("text"), F.lit(False).alias("auto"))


def numbered(df: DataFrame, segment: int | None = None, words: Sequence[str] | None = None) -> DataFrame:
    """Numbers heads of levels 3 to 5.  A head of a higher level, written number included,
    begins anew; a written number does not count on.  `segment` as in `lines.blocks`.

    With `words`, lines below the heads, which neither count nor begin anew, go before any sorting
    unless they hold one of these."""
    if words:
        df = once(df.withColumnRenamed("text", "_text"), text=F.col("_text")).drop("_text")
    if words is not None:
        df = df.filter(F.col("type").isin(*HEADS) | holds(words))
    resets = {"H3": ("H1", "H2"), "H4": ("H1", "H2", "H3"), "H5": ("H1", "H2", "H3", "H4")}
    kind = F.col("type")
    out = scans.since(df, {f"_{level}": (kind.isin(*above), (kind == level) & F.col("auto")) for level, above in resets.items()}, segment)
    mark = F.when(kind == "H3", F.concat(F.col("_H3"), F.lit(")"))).when(kind == "H4", F.concat(F.lit("("), F.col("_H4"), F.lit(")"))).otherwise(T.circled_number(F.col("_H5")))
    value = F.when(F.col("auto"), F.concat(mark, F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    return out.select("doc_id", F.col("line_no").alias("seq"), "type", value.alias("text"))


def strip_prefixes(kind: Column, text: Column) -> Column:
    """Text without the mark that its paragraph's style adds."""
    out = F
    for name, pattern in AUTO_PREFIXES.items():
        out = out.when(kind == name, F.regexp_replace(text, _u(pattern), ""))
    return out.otherwise(text)


def page_breaks(df: DataFrame, segment: int | None = None) -> DataFrame:
    """Adds h2_number within the last H1 and page_break: before every H1 and from the second H2 on."""
    df = scans.since(df, {"h2_number": (F.col("type") == "H1", F.col("type") == "H2")}, segment, order="seq")
    return df.withColumn("page_break", (F.col("type") == "H1") | ((F.col("type") == "H2") & (F.col("h2_number") >= 2)))


def contents(df: DataFrame) -> DataFrame:
    """Paragraphs for a table of contents."""
    return df.filter(F.col("type").isin("H1", "H2", "H3"))


def cover_lines(df: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Paragraphs that hold one of the keywords."""
    return df.filter(holds(keywords))


def holds(keywords: Sequence[str]) -> Column:
    return reduce(or_, (F.contains(F.col("text"), F.lit(k)) for k in keywords), F.lit(False))


def edit_summary(rows: DataFrame, drop: Sequence[str], edits: DataFrame) -> DataFrame:
    """Table rows (table_id, row, col, text) without those rows of which a cell holds a word of
    `drop`; `edits` (table_id, row, col, new_text) refer to rows as numbered after that."""
    hit = rows.filter(F.exists(F.array(*map(F.lit, drop)), lambda k: F.contains(F.col("text"), k))) if drop else rows.limit(0)
    left = rows.join(hit.select("table_id", "row").distinct(), ["table_id", "row"], "left_anti")
    left = left.withColumn("row", (F.dense_rank().over(Window.partitionBy("table_id").orderBy("row")) - 1).cast(rows.schema["row"].dataType))
    return left.join(edits, ["table_id", "row", "col"], "left").select("table_id", "row", "col", F.coalesce("new_text", "text").alias("text"))
