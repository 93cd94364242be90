"""Manuscript lines: splitting, classification by ordered rules, title, ambiguity, parents.

Every operator is a DataFrame function over (doc_id, line_no, raw) or over its own output
(blocks).  All windows of one call partition by document and order by line, so they share
one exchange and one sort.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import scans
from quire.functions import text as T
from quire.functions.frames import once

TITLE, BODY = -1, 0
_B = T.BLANK
_ROMAN = "ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ"

# The levels' patterns in the order in which they are tried.
RULES = (
    (1, rf"^#(?!#){_B}+[{_ROMAN}].*$"),
    (2, rf"^##(?!#){_B}+.+$"),
    (3, rf"^###(?!#){_B}+.+$"),
    (4, rf"^####(?!#){_B}+.+$"),
    (5, rf"^#####{_B}+.+$"),
    (4, rf"^{_B}*\(\d+\){_B}+.+$"),
    (5, rf"^{_B}*[①-⑳]{_B}*.+$"),
    (6, rf"^{_B}*□{_B}*.+$"),
    (7, rf"^{_B}*[❍○◯]{_B}*.+$"),
    (8, rf"^{_B}*-{_B}+.+$"),
    (9, rf"^{_B}*·{_B}*.+$"),
    (10, rf"^{_B}*[*※]{_B}*.+$"),
)
#: What stands before the text of a line, and the text.
SYMBOL = rf"^(?:(?=#)|{_B}*(?!#))(#{{1,5}}(?={_B})|\(\d+\)(?={_B})|[①-⑳]|□|[❍○◯]|-(?={_B})|·|[*※]){_B}*(.*)$"
#: Signs with which a line that any rule may fit begins, behind blanks or (the first) at once.
MARKS = "#(①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳□❍○◯-·*※"
TITLE_PATTERN = rf"^#{_B}+(?![{_ROMAN}]).+$"
SKIPPED = (rf"^{_B}*$", "^---+$", "^```", rf"^{_B}*>{_B}")
SENTENCE_ENDINGS = ("임", "음", "함", "됨", ".", "다", "요")
TYPES = {-1: "title", 0: "body", 1: "H1", 2: "H2", 3: "H3", 4: "H4", 5: "H5", 6: "L1", 7: "L2", 8: "L3", 9: "L4", 10: "note"}

LONG = 50
JUMP = 2
SHORT = 30


def _has(column: Column, pattern: str) -> Column:
    return column.rlike(f"(?U){pattern}")


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_no, raw): all lines, numbered from 0 within their document."""
    return docs.select("doc_id", F.posexplode(T.split_lines(T.drop_byte_order_marks(F.col(text)))).alias("line_no", "raw"))


def skipped(raw: Column) -> Column:
    """Blank lines, rules of hyphens at the line's start, code fences and quotations."""
    return _skipped(raw, T.strip(raw))


def _skipped(raw: Column, bare: Column) -> Column:
    blank, rule, fence, quotation = SKIPPED
    return (bare == "") | (raw.startswith("---") & _has(raw, rule)) | (raw.startswith("```") & _has(raw, fence)) | (bare.startswith(">") & _has(raw, quotation))


def level_of(raw: Column) -> Column:
    """The level of the first rule that fits, else body.  Rules are tried on lines with their mark only."""
    return _level(raw, F.left(T.strip(raw), F.lit(1)))


def _level(raw: Column, mark: Column) -> Column:
    """The level of a line whose first sign, blanks left out, is `mark`: only its own rule is tried."""
    hashes = marked = F
    for level, pattern in RULES:
        if pattern.startswith("^#"):
            hashes = hashes.when(_has(raw, pattern), level)
        else:
            marked = marked.when(mark.isin(*(m for m in MARKS[1:] if any(re.search(pattern, m + rest) for rest in (" x", "1) x")))) & _has(raw, pattern), level)
    by_mark = F.when(F.startswith(raw, F.lit("#")), hashes.otherwise(BODY)).when(mark.isin(*MARKS[1:]), marked.otherwise(BODY))
    return by_mark.otherwise(BODY)


def parts_of(raw: Column, level: Column) -> Column:
    """struct(symbol, text): what stands before the text of a line with a level, and the stripped text."""
    symbol, text = (F.regexp_extract(raw, f"(?U){SYMBOL}", k) for k in (1, 2))
    none = F.struct(F.lit("").alias("symbol"), T.strip(raw).alias("text"))
    return F.when(level == BODY, none).when(symbol != "", F.struct(symbol.alias("symbol"), T.strip(text).alias("text"))).otherwise(none)


def title_candidate(text: Column) -> Column:
    """Whether a body line is short and does not end like a sentence."""
    bare = F.rtrim(text, F.lit(" .,!?~"))
    return (F.length(text).between(1, SHORT)) & (bare != "") & ~F.right(bare, F.lit(1)).isin(*SENTENCE_ENDINGS)


def blocks(rows: DataFrame, long: int = LONG, segment: int | None = None) -> DataFrame:
    """Classified lines: (doc_id, line_no, level, symbol, text, raw, ambiguous, parent_level).

    A document has one title at most: its first line that looks like one, if nothing but body
    precedes it; later ones stay body with their mark.  Other lines without text are dropped.
    With `segment`, documents are cut into so many lines, for those that no task can hold.
    """
    raw = F.col("raw")
    df = once(rows, _bare=T.strip(raw))
    df = once(df, _titled=raw.startswith("#") & _has(raw, TITLE_PATTERN), _skipped=_skipped(raw, F.col("_bare"))).filter("_titled or not _skipped")
    df = once(df, level=_level(raw, F.left("_bare", F.lit(1)))).drop("_bare")
    df = once(df, _parts=parts_of(raw, F.col("level")))
    level, text = F.col("level"), F.col("_parts.text")
    # What is asked of the text is told before the sort, so that texts go through it only where they are returned.
    df = once(df, _symbol=F.col("_parts.symbol"), _text=text, _empty=text == "", _large=level.between(1, 10) & (F.length(text) >= long), _small=(level == BODY) & title_candidate(text)).drop("_parts")
    # The title is its document's first line that looks like one, unless another line with a level comes before;
    # what looks like a title and comes later changes nothing.
    counts = (level != BODY) & ~F.col("_empty") & ~F.col("_titled")
    df = scans.least(df, {"_first_title": F.when(F.col("_titled"), F.col("line_no")), "_first_other": F.when(counts, F.col("line_no"))}, segment)
    is_title = (F.col("line_no") == F.col("_first_title")) & (F.col("_first_other").isNull() | (F.col("_first_title") < F.col("_first_other")))
    df = df.withColumn("_is_title", F.coalesce(is_title, F.lit(False)))
    df = df.filter(F.col("_is_title") | ~(F.col("_empty") | F.col("_skipped")))
    df = df.withColumn("level", F.when(F.col("_is_title"), TITLE).otherwise(level))
    df = _parents(df, segment, {"_heading": F.when(level.between(1, 5), level)})
    jumps = level.between(1, 5) & (level - F.col("_heading") > JUMP)
    df = df.withColumn("ambiguous", F.coalesce(F.col("_large") | jumps | F.col("_small"), F.lit(False)) & (level != TITLE))
    title = parts_of(raw, F.lit(1))
    symbol, text = (F.when(F.col("_is_title"), title[name]).otherwise(F.col(f"_{name}")).alias(name) for name in ("symbol", "text"))
    return df.select("doc_id", "line_no", "level", symbol, text, "raw", "ambiguous", "parent_level")


def blocks_of(docs: DataFrame, text: str = "text", most: int = 1 << 24, segment: int = 1 << 17) -> DataFrame:
    """Blocks of documents; those of more than `most` characters are scanned by segments."""
    size = F.coalesce(F.length(text), F.lit(0))
    large = blocks(lines(docs.filter(size > most), text), segment=segment)
    return blocks(lines(docs.filter(size <= most), text)).unionByName(large)


def with_parents(df: DataFrame, segment: int | None = None) -> DataFrame:
    """Adds parent_level: of a body line that of the last other block, else the nearest lower level before."""
    return _parents(df, segment, {})


def _parents(df: DataFrame, segment: int | None, more: Mapping[str, Column]) -> DataFrame:
    """The same, with `more` last values out of the same scan."""
    level = F.col("level")
    lowers = [k for k in range(TITLE, 10) if k != BODY]
    # The line's number and, as its last digits, its level: the largest is the nearest.
    at = lambda k: F.col("line_no").cast("long") * 16 + (k - TITLE)
    df = scans.last(df, {**{f"_at{k}": F.when(level == k, at(k)) for k in lowers}, "_other": F.when(level != BODY, level), **more}, segment)
    nearest = F.greatest(*(F.when(level > k, F.col(f"_at{k}")) for k in lowers)).bitwiseAND(15) + TITLE
    parent = F.when(level == TITLE, F.lit(None)).when(level == BODY, F.col("_other")).otherwise(nearest)
    return df.withColumn("parent_level", parent.cast("int")).drop("_other", *(f"_at{k}" for k in lowers))


def type_of(level: Column) -> Column:
    """The paragraph type of a level; a title is an H1, an unknown level body."""
    names = F.create_map(*(F.lit(x) for k, v in TYPES.items() for x in (k, "H1" if k == TITLE else v)))
    return F.coalesce(F.try_element_at(names, level), F.lit("body"))


def level_of_type(kind: Column) -> Column:
    names = F.create_map(*(F.lit(x) for k, v in TYPES.items() for x in (v, k)))
    return F.coalesce(F.try_element_at(names, kind), F.lit(BODY))


def is_heading(level: Column) -> Column:
    return level.between(1, 5)


def is_bullet(level: Column) -> Column:
    return level.between(6, 10)


def histogram(df: DataFrame) -> DataFrame:
    """(type, n) of all blocks."""
    return df.groupBy(type_of(F.col("level")).alias("type")).agg(F.count("*").alias("n"))


def context(df: DataFrame, before: int = 3, after: int = 1) -> DataFrame:
    """Ambiguous blocks with the raw lines of the blocks around them."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    shown = F.when(F.col("raw") == "", F.col("text")).otherwise(F.col("raw"))
    df = df.withColumn("context_before", F.collect_list(shown).over(order.rowsBetween(-before, -1)))
    return df.withColumn("context_after", F.collect_list(shown).over(order.rowsBetween(1, after))).filter("ambiguous")
