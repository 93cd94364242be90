"""Signals from chat transcripts: the current session, its ask and its last answer, tools, files, ids.

Records are (session_id, pos, type, is_meta, is_boundary, content), content a JSON text that is
a string or an array of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T

TAIL = 200
ASK, ANSWER = 600, 1500
FILES, IDS = 40, 10
# How rows begin that no person typed.
FRAMES = ("<command-name>", "<command-message>", "<command-stdout>", "<local-command-")
BLOCK = "array<struct<type:string,text:string,name:string,input:map<string,string>>>"


def current(records: DataFrame, tail: int = TAIL) -> DataFrame:
    """Records behind the last boundary; without one the last `tail`."""
    session = Window.partitionBy("session_id")
    df = records.withColumn("_mark", F.max(F.when(F.col("is_boundary"), F.col("pos"))).over(session))
    df = df.withColumn("_from_end", F.row_number().over(session.orderBy(F.col("pos").desc())))
    return df.filter(F.when(F.col("_mark").isNotNull(), F.col("pos") > F.col("_mark")).otherwise(F.col("_from_end") <= tail)).drop("_mark", "_from_end")


def with_blocks(records: DataFrame) -> DataFrame:
    """Adds plain (content that is a string) and blocks (content that is an array)."""
    content = F.col("content")
    plain = F.when(content.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), content, F.lit("}")), "$.v"))
    return records.withColumn("plain", plain).withColumn("blocks", F.when(content.startswith("["), F.from_json(content, BLOCK)))


def first_text() -> Column:
    texts = F.filter(F.coalesce("blocks", F.array().cast(BLOCK)), lambda b: b["type"] == "text")
    return F.coalesce("plain", F.get(texts, 0)["text"], F.lit(""))


def last_text() -> Column:
    texts = F.filter(F.coalesce("blocks", F.array().cast(BLOCK)), lambda b: (b["type"] == "text") & (T.strip(b["text"]) != ""))
    return F.coalesce(F.nullif("plain", F.lit("")), F.try_element_at(texts, F.lit(-1))["text"], F.lit(""))


def asked() -> Column:
    """Whether a person typed this record."""
    text = F.regexp_replace(first_text(), r"(?U)^\s+", "")
    framed = F.lit(False)
    for frame in FRAMES:
        framed = framed | text.startswith(frame)
    return (F.col("type") == "user") & ~F.coalesce("is_meta", F.lit(False)) & ~F.coalesce("is_boundary", F.lit(False)) & (text != "") & ~framed


def signals(records: DataFrame) -> DataFrame:
    """(session_id, first_user_message, last_assistant_text, topic, slug), cut, then redacted."""
    df = with_blocks(current(records)).withColumn("_first", first_text()).withColumn("_last", last_text()).withColumn("_asked", asked())
    ask = F.substring(F.min_by("_first", F.when(F.col("_asked"), F.col("pos"))), 1, ASK)
    answered = (F.col("type") == "assistant") & (T.strip(F.col("_last")) != "")
    answer = F.substring(F.max_by("_last", F.when(answered, F.col("pos"))), 1, ANSWER)
    out = df.groupBy("session_id").agg(F.coalesce(ask, F.lit("")).alias("_ask"), F.coalesce(answer, F.lit("")).alias("_answer"))
    out = out.select("session_id", T.redact_secrets(F.col("_ask")).alias("first_user_message"), T.redact_secrets(F.col("_answer")).alias("last_assistant_text"))
    return out.withColumn("topic", T.topic(F.col("first_user_message"))).withColumn("slug", T.slug(F.col("topic")))


def _calls(records: DataFrame) -> DataFrame:
    rows = with_blocks(current(records)).filter("type = 'assistant'").select("session_id", F.explode("blocks").alias("b"))
    return rows.filter("b.type = 'tool_use'").select("session_id", F.coalesce(F.nullif("b.name", F.lit("")), F.lit("unknown")).alias("tool"), F.col("b.input").alias("input"))


def tool_counts(records: DataFrame) -> DataFrame:
    return _calls(records).groupBy("session_id", "tool").agg(F.count("*").alias("n"))


def files_touched(records: DataFrame, most: int = FILES) -> DataFrame:
    """(session_id, files): sorted names from the tools' inputs."""
    paths = F.array(*(F.try_element_at("input", F.lit(k)) for k in ("file_path", "path", "notebook_path")))
    rows = _calls(records).select("session_id", F.explode(paths).alias("file")).filter("file <> ''")
    return rows.groupBy("session_id").agg(F.slice(F.array_sort(F.collect_set("file")), 1, most).alias("files"))


def hex_ids(command: Column) -> Column:
    """Hexadecimal ids of 7 to 40 digits, each cut to ten."""
    return F.array_distinct(F.transform(F.regexp_extract_all(command, F.lit(r"\b[0-9a-f]{7,40}\b"), F.lit(0)), lambda x: F.substring(x, 1, 10)))


def commits(records: DataFrame, most: int = IDS) -> DataFrame:
    """(session_id, ids): sorted ids from commands that speak of git."""
    command = F.try_element_at("input", F.lit("command"))
    rows = _calls(records).filter(F.contains(command, F.lit("git"))).select("session_id", F.explode(hex_ids(command)).alias("id"))
    return rows.groupBy("session_id").agg(F.slice(F.array_sort(F.collect_set("id")), 1, most).alias("ids"))
