"""Inputs derived from the star schema, for operators whose marks the document table lacks.

A manuscript is made of order lines: forty orders are a document, and whole-number arithmetic
on their keys picks each line's mark, length and ending, so another engine makes the same one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.frames import once

PREFIXES = ("# Ⅰ. ", "## ", "### ", "#### ", "##### ", "(1) ", "① ", "□ ", "❍ ", "- ", "· ", "※ ", "> ", "# ", "", "")
ENDINGS = ("함", "추진.", "한다.", "계획", "계획")
#: Parts that Spark may broadcast: the driver then holds some 180 bytes of each, of which their
#: compressed files, by whose size Spark decides, show as few as four.
MOST_PARTS = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    if part.count() > MOST_PARTS:
        part = part.hint("shuffle_merge")
    return items.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("doc_id", F.expr("l_orderkey div 40"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id): the manuscripts."""
    return _items(spark, sf_dir).select("doc_id").distinct()


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, raw, r, part): manuscript lines."""
    df = _items(spark, sf_dir)
    order = Window.partitionBy("doc_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    df = df.withColumn("line_no", F.row_number().over(order) - 1)
    r = (F.col("l_partkey") * 7 + F.col("l_linenumber") * 3 + F.col("l_suppkey")) % 16
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), k.cast("int"))
    body = F.concat(pick(PREFIXES, r), F.repeat(F.concat("p_name", F.lit(" ")), (1 + F.col("l_suppkey") % 8).cast("int")), pick(ENDINGS, F.expr("(l_partkey div 3) % 5")))
    first = F.col("line_no") == 0
    raw = F.when(first & (F.col("doc_id") % 3 == 0), F.concat(F.lit("# "), "p_name")).when(first & (F.col("doc_id") % 3 == 1), F.concat(F.lit("plain "), "p_name")).otherwise(body)
    return once(df, raw=raw).select("doc_id", "line_no", "raw", r.alias("r"), F.col("l_partkey").alias("part"))


_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"

#: The same manuscript in DuckDB's SQL, as common table expressions.
SQL = f"""
lines0 as (
  select l_orderkey // 40 as doc_id, l_partkey, l_suppkey, p_name, (l_partkey * 7 + l_linenumber * 3 + l_suppkey) % 16 as r,
    row_number() over (partition by l_orderkey // 40 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 as line_no
  from lineitem join part on l_partkey = p_partkey),
raw_lines as (
  select doc_id, line_no, r, l_partkey as part,
    case when line_no = 0 and doc_id % 3 = 0 then '# ' || p_name when line_no = 0 and doc_id % 3 = 1 then 'plain ' || p_name
      else ({_LIST(PREFIXES)})[r + 1] || repeat(p_name || ' ', 1 + l_suppkey % 8) || ({_LIST(ENDINGS)})[(l_partkey // 3) % 5 + 1] end as raw
  from lines0)"""
