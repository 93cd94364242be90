"""Which reader a file goes to, by its extension; what cannot be read is a row with an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import checklist
from quire.sources import packages, records

READ = {"text": ("txt", "md"), "package": ("hwpx",), "compound": ("hwp",)}
#: Files whose text another program must have taken out; it comes as a table (path, text).
CONVERTED = ("pdf", "docx")


def documents(spark: SparkSession, folder: str, converted: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(path, text, error) of all files below a folder.

    Text files, packages and compound files are read here, each once and whatever the case of
    their extension; of CONVERTED ones the text is looked up in `converted`, which also stands in
    for a compound file that gives none.  A file of another kind, one that is damaged and one
    without any text have an error in its place, so the others are not held up.  Texts are whole,
    or of `most` characters and a note.
    """
    files = packages.listing(spark, folder, recursive=True).select("path", F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).alias("_kind"))
    none = F.lit(None).cast("string")
    plain = packages.texts(spark, folder, pattern=_glob(READ["text"]))
    found = [plain.select("path", _cut(F.col("text"), most).alias("text"), none.alias("error"), F.lit(1).alias("rank"))]
    parts = packages.parts(spark, folder, packages.SECTION, pattern=_glob(READ["package"]))
    found.append(packages.read_texts(parts, most).withColumn("rank", F.lit(1)))
    legacy = records.texts(records.streams(spark, folder, pattern=_glob(READ["compound"])), most)
    found.append(legacy.select("path", "text", "error", F.lit(1).alias("rank")))
    if converted is not None:
        found.append(converted.select("path", _cut(F.col("text"), most).alias("text"), none.alias("error"), F.lit(2).alias("rank")))
    read = checklist.union_all(found)
    # A text that was read here counts before a converted one, a converted one before an error.
    best = F.min(F.struct(F.col("text").isNull().alias("missing"), "rank", "text", "error"))
    read = read.groupBy("path").agg(best.alias("best")).select("path", "best.text", "best.error")
    known = [k for kinds in READ.values() for k in kinds] + list(CONVERTED)
    df = files.join(read, "path", "left")
    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(~F.col("_kind").isin(*known), F.concat(F.lit("cannot read files of kind: "), "_kind")).when(empty, "no text")
    return df.select("path", "text", error.alias("error"))


def _cut(text: Column, most: int | None) -> Column:
    return text if most is None else packages.X.truncate(text, most)


def _glob(kinds: tuple[str, ...]) -> str:
    """A pattern of file names with one of these extensions in any case."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in kinds) + "}"
