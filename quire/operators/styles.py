"""Styles of a template: levels matched by name, then by size, then by default; ids merged and rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T
from quire.operators import lines

# Style names and the levels they stand for.
NAMES = {
    "제목1": 1, "제목 1": 1, "Heading 1": 1,
    "제목2": 2, "제목 2": 2, "Heading 2": 2,
    "제목3": 3, "제목 3": 3, "Heading 3": 3,
    "본문1": 4, "제목4": 4, "본문2": 5, "제목5": 5,
    "□ 4칸": 6, "❍ 5칸": 7, "- 6칸": 8, "· 7칸": 9, "* 9칸": 10,
    "바탕글": 0,
}
# Font sizes in points and the levels that may have them, in order.
SIZES = {20.0: [1], 18.0: [2, 3], 16.0: [4], 15.0: [5, 6, 7, 8, 9], 13.0: [10]}
UNITS_PER_MM = 283.4646


def by_name(styles: DataFrame) -> DataFrame:
    """(template, level, para, char, style, name) from styles (template, seq, id, name, char, para):
    for each level the first style, in document order, with one of its names."""
    dim = F.broadcast(styles.sparkSession.createDataFrame(list(NAMES.items()), "_name string, level int"))
    found = styles.join(dim, T.strip(F.col("name")) == F.col("_name"))
    first = Window.partitionBy("template", "level").orderBy("seq")
    return found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("template", "level", "para", "char", F.col("id").alias("style"), "name")


def by_size(chars: DataFrame, named: DataFrame) -> DataFrame:
    """(template, level, char): the k-th level without a named style takes the k-th character id of its size.

    `chars` is (template, seq, id, height_pt).
    """
    places = F.array(*(F.struct(F.lit(s).alias("height_pt"), F.lit(n).alias("seq_level"), F.lit(lv).alias("level")) for s, levels in SIZES.items() for n, lv in enumerate(levels)))
    spine = chars.select("template").distinct().select("template", F.inline(places))  # ten rows a template
    open_ = spine.join(named.select("template", "level"), ["template", "level"], "left_anti")
    open_ = open_.withColumn("k", F.row_number().over(Window.partitionBy("template", "height_pt").orderBy("seq_level")))
    ids = chars.withColumn("k", F.row_number().over(Window.partitionBy("template", "height_pt").orderBy("seq")))
    return open_.join(ids, ["template", "height_pt", "k"]).select("template", "level", F.col("id").alias("char"))


def style_map(templates: DataFrame, styles: DataFrame, chars: DataFrame, defaults: DataFrame) -> DataFrame:
    """One row for each template and level 0 to 10: ids, name, size and whether a default was used.

    `defaults` is (level, para, char, style, font_pt), eleven rows.
    """
    named = by_name(styles)
    sized = by_size(chars, named)
    base = defaults.select("level", F.col("para").alias("_para"), F.col("char").alias("_char"), F.col("style").alias("_style"), F.col("font_pt").alias("_pt"))
    spine = templates.select("template").distinct().select("template", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("level"))
    df = spine.join(F.broadcast(base), "level").join(named, ["template", "level"], "left").join(sized.withColumnRenamed("char", "_sized"), ["template", "level"], "left")
    char = F.coalesce("char", "_sized", "_char")
    fallback = F.col("style").isNull() & (F.col("level") > 0)
    df = df.select("template", "level", F.coalesce("para", "_para").alias("para"), char.alias("char"), F.coalesce("style", "_style").alias("style"), "name", fallback.alias("is_fallback"), F.when(F.col("char").isNull() & F.col("_sized").isNull(), F.col("_pt")).alias("_pt"))
    sizes = chars.select("template", F.col("id").alias("char"), "height_pt").dropDuplicates(["template", "char"])
    return df.join(sizes, ["template", "char"], "left").select("template", "level", "para", "char", "style", "name", F.coalesce("_pt", "height_pt").alias("font_pt"), "is_fallback")


def style_dict(styled: DataFrame) -> DataFrame:
    """(template, styles): a map from paragraph type to ids; titles have none."""
    entry = F.struct(lines.type_of(F.col("level")).alias("key"), F.struct("para", "char", "style").alias("value"))
    return styled.filter("level >= 0").groupBy("template").agg(F.map_from_entries(F.collect_list(entry)).alias("styles"))


def millimetres(units: Column, default: float) -> Column:
    value = units.try_cast("double")
    return F.coalesce(F.round(value / UNITS_PER_MM, 2), F.lit(default))


def paper(width: Column) -> Column:
    """A4, unless the width is off by more than 5 mm."""
    mm = width.try_cast("double") / UNITS_PER_MM
    return F.when(F.abs(mm - 210) > 5, F.concat(F.format_string("%.0f", mm), F.lit("mm"))).otherwise(F.lit("A4"))


def new_ids(own: DataFrame, other: DataFrame) -> DataFrame:
    """(group, old_id, new_id): ids of `other` (group, id) put behind the largest of `own`, in numeric order."""
    top = own.groupBy("group").agg(F.max("id").alias("_top"))
    order = Window.partitionBy("group").orderBy("id")
    df = other.select("group", "id").distinct().join(top, "group", "left").withColumn("_n", F.row_number().over(order))
    return df.select("group", F.col("id").alias("old_id"), (F.coalesce("_top", F.lit(-1)) + F.col("_n")).alias("new_id"))


def rewrite_ids(content: DataFrame, ids: DataFrame) -> DataFrame:
    """Content (group, id, …) with its ids replaced where there is a new one."""
    df = content.join(ids.withColumnRenamed("old_id", "id"), ["group", "id"], "left")
    return df.withColumn("id", F.coalesce("new_id", "id")).drop("new_id").select(*content.columns)


def font_ids(own: DataFrame, other: DataFrame) -> DataFrame:
    """(group, old_id, new_id) of fonts (group, id, name): one of `own` with the same name is taken,
    a new name gets one id behind the largest, in the order in which its first font stands."""
    mine = own.groupBy("group", "name").agg(F.max("id").alias("_same"))
    top = own.groupBy("group").agg(F.max("id").alias("_top"))
    df = other.select("group", "id", "name").distinct().join(mine.select(F.col("group").alias("_g"), F.col("name").alias("_name"), "_same"), (F.col("group") == F.col("_g")) & F.col("name").eqNullSafe(F.col("_name")), "left")
    fresh = df.filter("_same is null").groupBy("group", "name").agg(F.min("id").alias("_first")).join(top, "group", "left")
    fresh = fresh.withColumn("_new", F.coalesce("_top", F.lit(0)) + F.row_number().over(Window.partitionBy("group").orderBy("_first")))
    df = df.join(fresh.select(F.col("group").alias("_h"), F.col("name").alias("_other"), "_new"), (F.col("group") == F.col("_h")) & F.col("name").eqNullSafe(F.col("_other")), "left")
    return df.select("group", F.col("id").alias("old_id"), F.coalesce("_same", "_new").alias("new_id"))


def char_css(font: str, height_pt: str, bold: str, italic: str, underline: str) -> Column:
    """A character style as CSS; a font that the reader lacks falls back."""
    mark = lambda c, css: F.when(F.col(c), css)
    family = F.when(F.coalesce(font, F.lit("")) != "", F.concat(F.lit("font-family: '"), F.col(font), F.lit("', '맑은 고딕', sans-serif")))
    size = F.when(F.coalesce(height_pt, F.lit(0.0)) != 0, F.concat(F.lit("font-size: "), F.format_string("%.1f", height_pt), F.lit("pt")))
    return F.concat_ws("; ", family, size, mark(bold, "font-weight: bold"), mark(italic, "font-style: italic"), mark(underline, "text-decoration: underline"))


def para_css(indent_em: str) -> Column:
    """A paragraph style as CSS: its indent, if it has one."""
    return F.when(F.col(indent_em) > 0, F.concat(F.lit("margin-left: "), F.format_string("%.1f", indent_em), F.lit("em"))).otherwise("")
