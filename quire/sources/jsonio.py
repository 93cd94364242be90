"""JSON sources and sinks: logs of one object a line, model responses, tender pages, catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.functions import text as X


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a log, one a line; broken lines and such that are no objects are skipped."""
    return parse_log(spark.read.text(path), schema)


def parse_log(lines: DataFrame, schema: str) -> DataFrame:
    value = F.regexp_replace("value", r"^\s+", "")
    rows = lines.filter(value.startswith("{")).select(F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("row"))
    return rows.select("row.*").filter("_broken is null").drop("_broken")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


REQUIRED = "id string, name string, is_required boolean, max_age_days int, hints array<string>, description string"


def required_documents(responses: DataFrame, text: str = "response") -> DataFrame:
    """Required documents in model responses {"documents": [...]}.

    Items that are no objects, lack id or name or hold a limit that is no number are skipped; a
    limit of 0 is none; a flag given as a word is true unless it is empty.
    """
    item = "struct<id:variant,name:variant,is_required:variant,max_age_days:variant,filename_hints:variant,description:variant>"
    parsed = F.from_json(F.col(text), "documents array<string>")
    rows = responses.select("*", F.posexplode(parsed["documents"]).alias("seq", "_raw")).filter(F.col("_raw").startswith("{"))
    rows = rows.withColumn("_d", F.from_json("_raw", item.removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")))
    as_text = lambda c: F.coalesce(F.try_variant_get(F.col(f"_d.{c}"), "$", "string"), F.lit(""))
    flag = as_text("is_required")
    hints = F.coalesce(F.from_json(F.to_json(F.struct(F.col("_d.filename_hints").alias("h"))), "h array<string>")["h"], F.array().cast("array<string>"))
    limit = as_text("max_age_days")
    number = F.floor(limit.try_cast("double")).cast("int")
    out = rows.withColumns({
        "id": X.strip(as_text("id")), "name": X.strip(as_text("name")),
        "is_required": F.when(F.col("_d.is_required").isNull(), True).otherwise(~flag.isin("", "false", "0", "0.0") | ((flag == "false") & F.contains("_raw", F.lit('"false"')))),
        "max_age_days": F.when(number != 0, number),
        "hints": F.filter(F.transform(hints, X.strip), lambda h: h != ""),
        "description": X.strip(as_text("description")),
    })
    bad = (limit != "") & (limit != "false") & number.isNull()
    return out.filter((F.col("id") != "") & (F.col("name") != "") & ~bad).drop("_raw", "_d", text)


TENDER = T.StructType([T.StructField(k, T.StringType()) for k in ("bidNtceNo", "bidNtceNm", "ntceInsttNm", "dminsttNm", "bidNtceDt", "rgstDt", "bidClseDt", "asignBdgtAmt", "bidNtceDtlUrl")])


def tenders(pages: DataFrame, text: str = "body") -> DataFrame:
    """Tenders of response pages: one row an item, or one row with an error for a page that failed.

    Items come as a list, as {"item": [...]} or as {"item": {...}}.
    """
    get = lambda path: F.get_json_object(F.col(text), path)
    code = F.coalesce(get("$.response.header.resultCode"), F.lit(""))
    items = get("$.response.body.items")
    inner = F.when(items.startswith("{"), F.get_json_object(items, "$.item")).otherwise(items)
    listed = F.when(inner.startswith("{"), F.array(inner)).otherwise(F.from_json(inner, "array<string>"))
    error = F.when(~code.isin("", "00"), F.coalesce(get("$.response.header.resultMsg"), code)).when(get("$").isNull(), F.lit("no JSON"))
    total = F.coalesce(get("$.response.body.totalCount").try_cast("long"), F.lit(0))
    df = pages.select("*", error.alias("error"), total.alias("total_count"), F.when(error.isNull(), listed).alias("_items"))
    df = df.select("*", F.explode_outer("_items").alias("raw")).filter(F.col("error").isNotNull() | F.col("raw").startswith("{"))
    df = df.withColumn("_t", F.from_json("raw", TENDER))
    text_of = lambda *names: F.coalesce(*(F.nullif(f"_t.{n}", F.lit("")) for n in names), F.lit(""))
    return df.select(
        *(c for c in pages.columns if c != text), "error", "total_count",
        text_of("bidNtceNo").alias("bid_no"), text_of("bidNtceNm").alias("title"), text_of("ntceInsttNm", "dminsttNm").alias("agency"),
        text_of("bidNtceDt", "rgstDt").alias("open_date"), text_of("bidClseDt").alias("close_date"),
        X.safe_int(text_of("asignBdgtAmt")).alias("amount_krw"), text_of("bidNtceDtlUrl").alias("detail_url"), "raw",
    )


# Parts of the names of fields that hold attachments.
ATTACHMENT_FIELDS = ("filedwld", "fileurl", "file_url", "doc_url", "attachfile", "ntcespec", "bidntcedoc")


def attachment_urls(raw: Column) -> Column:
    """The distinct URLs of a tender's attachments, first seen first."""
    entries = F.map_entries(F.from_json(raw, "map<string,string>"))
    named = lambda k: F.exists(F.array(*map(F.lit, ATTACHMENT_FIELDS)), lambda p: F.contains(F.lower(k), p))
    urls = F.filter(entries, lambda e: named(e["key"]) & (e["value"].startswith("http://") | e["value"].startswith("https://")))
    return F.array_distinct(F.transform(urls, lambda e: e["value"]))


def search(rows: DataFrame, title: str, day: str, key: str, keyword: str, since: Column, until: Column, page: int = 1, per_page: int = 10) -> DataFrame:
    """A page of the rows whose title holds a keyword, newest first."""
    hits = rows.filter(F.contains(F.col(title), F.lit(keyword)) & F.col(day).between(since, until))
    order = [F.col(day).desc(), F.col(key)]
    # The page is cut before rows are numbered, so that no more than page * per_page meet in one task.
    top = hits.orderBy(*order).limit(page * per_page)
    return top.withColumn("n", F.row_number().over(Window.orderBy(*order))).filter(F.col("n") > (page - 1) * per_page)
