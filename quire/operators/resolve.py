"""Ambiguous lines and outside decisions: prompts, caps, merge, outcomes, cost, votes.

The resolver itself is pluggable: any function that takes a DataFrame with a column `prompt`
and adds `response`.  Only documents with ambiguous lines reach it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.operators import lines

MOST_PER_CALL = 400

# Published prices in dollars a million tokens, (input, output).
PRICES = {
    "gemini-2.5-flash": (0.075, 0.30),
    "gemini-2.5-pro": (1.25, 10.00),
    "gemini-3-flash": (0.50, 3.00),
    "gemini-3-flash-lite": (0.25, 1.50),
    "gemini-3-pro": (2.50, 15.00),
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4o": (2.50, 10.00),
    "gpt-4.1-mini": (0.40, 1.60),
    "gpt-4.1": (2.00, 8.00),
    "o4-mini": (1.10, 4.40),
    "claude-haiku-4-5-20251001": (1.00, 5.00),
    "claude-sonnet-4-5-20250929": (3.00, 15.00),
    "claude-opus-4-1-20250805": (15.00, 75.00),
}
DEFAULTS = {"gemini": "gemini-2.5-flash", "openai": "gpt-4o-mini", "anthropic": "claude-haiku-4-5-20251001"}
KRW_PER_USD = 1350.0
BATCH_DISCOUNT = 0.5

DECISIONS = T.ArrayType(T.StructType([T.StructField("line_no", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("reason", T.StringType())]))


def capped(ambiguous: DataFrame, most: int = MOST_PER_CALL) -> DataFrame:
    """The first `most` ambiguous lines of each document."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    return ambiguous.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def prompts(blocks: DataFrame, intro: str, outro: str, before: int = 3, after: int = 1, most: int = MOST_PER_CALL) -> DataFrame:
    """(doc_id, prompt): one prompt a document that has ambiguous lines."""
    items = capped(lines.context(blocks, before, after), most)
    item = F.struct("line_no", F.col("level").alias("current_level"), F.when(F.col("raw") == "", F.col("text")).otherwise(F.col("raw")).alias("raw"), "context_before", "context_after")
    body = F.to_json(F.array_sort(F.collect_list(item), lambda a, b: (a["line_no"] - b["line_no"]).cast("int")))
    return items.groupBy("doc_id").agg(F.concat(F.lit(intro), body, F.lit(outro)).alias("prompt"))


def resolve(asked: DataFrame, resolver: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds the response of any resolver; whoever has nothing to ask has been filtered out before."""
    return resolver(asked.filter(F.col("prompt").isNotNull()))


# Fixed value: the fence that a response may stand in.
_FENCE = re.compile(r"^```(?:json)?\s*|\s*```$", re.IGNORECASE | re.MULTILINE)


#: What tells depth: braces, and what hides them: strings, whole or cut off, and escaped characters.
_MARKS = re.compile(r'[{}]|"(?:[^"\\]|\\.)*(?:"|\\?\Z)|\\.', re.DOTALL)


def _objects(text: str) -> list:
    """Whole objects after the first bracket of an array that may be cut off."""
    found, at = [], text.find("[")
    while at >= 0 and (at := text.find("{", at)) >= 0:
        depth, end = 0, -1
        for mark in _MARKS.finditer(text, at):
            depth += {"{": 1, "}": -1}.get(mark.group(), 0)
            if not depth:
                end = mark.end()
                break
        if end < 0:
            break  # cut off
        # Only the object's own text is tried: an error would count lines from the text's start.
        try:
            found.append(json.loads(text[at:end]))
        except ValueError:
            pass  # damaged: go on behind it
        at = end
    return found


def _whole(value: object) -> int | None:
    """A whole number from a number or from text of digits; a fraction loses its decimals, text of one is none."""
    try:
        return int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError, OverflowError):
        return None


def recover(text: str | None) -> list[dict]:
    """Decisions in a response: the whole of it, else its outermost array, else whatever objects are complete."""
    plain = _FENCE.sub("", text or "").strip()
    data = None
    for attempt in (plain, plain[plain.find("[") : plain.rfind("]") + 1]):
        try:
            data = json.loads(attempt)
            break
        except ValueError:
            continue
    if data is None:
        data = _objects(plain)
    if isinstance(data, dict):  # a schema-bound client wraps the array
        data = data.get("items")
    found = []
    for item in data if isinstance(data, list) else []:
        if isinstance(item, dict) and {"line_no", "level"} <= item.keys():
            line_no, level = _whole(item["line_no"]), _whole(item["level"])
            if line_no is not None and level is not None and -1 <= level <= 10:
                found.append({"line_no": line_no, "level": level, "reason": str(item.get("reason", ""))})
    return found


@F.pandas_udf(DECISIONS)
def parse_response(text: pd.Series) -> pd.Series:
    """The decisions of a response, in its order; damaged JSON is recovered as far as it goes."""
    return text.map(recover)


def parsed_responses(responses: DataFrame) -> DataFrame:
    """(doc_id, parsed) of responses (doc_id, response): sound JSON is read in place, the rest recovered.

    Sound is one plain array, all of whose objects have a line and a level within bounds.
    """
    text = F.trim("response")
    native = F.from_json(text, "array<struct<line_no:long,level:int,reason:string>>")
    whole = lambda d: d["line_no"].isNotNull() & d["level"].between(-1, 10) & d["reason"].isNotNull()
    df = responses.select("doc_id", "response", F.inline(F.array(F.struct(native.alias("parsed"), (F.regexp_count(text, F.lit(r"[\[\]]")) == 2).alias("_plain")))))
    sound = F.coalesce(F.col("_plain") & text.startswith("[") & text.endswith("]") & F.forall("parsed", whole), F.lit(False))
    easy = df.filter(sound).select("doc_id", "parsed")
    hard = df.filter(~sound).select("doc_id", parse_response("response").alias("parsed"))
    return easy.unionByName(hard.select("doc_id", F.col("parsed").cast("array<struct<line_no:long,level:int,reason:string>>").alias("parsed")))


def decisions(responses: DataFrame) -> DataFrame:
    """(doc_id, line_no, decided, reason): of several for a line the last."""
    parsed = parsed_responses(responses).select("doc_id", F.posexplode("parsed").alias("at", "d"))
    return last_decision(parsed.select("doc_id", "at", "d.line_no", F.col("d.level").alias("decided"), "d.reason"))


def last_decision(df: DataFrame) -> DataFrame:
    latest = Window.partitionBy("doc_id", "line_no").orderBy(F.col("at").desc())
    return df.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n", "at")


def merge(blocks: DataFrame, decided: DataFrame, dry_run: bool = False) -> DataFrame:
    """Blocks with the decisions on their ambiguous lines; parents stay as they are.

    `outcome` is changed, confirmed or no_decision for ambiguous lines, else null.
    """
    df = blocks.join(decided.select("doc_id", "line_no", "decided"), ["doc_id", "line_no"], "left")
    took = F.when(F.col("ambiguous"), F.when(F.col("decided").isNull(), "no_decision").when(F.col("decided") == F.col("level"), "confirmed").otherwise("changed"))
    df = df.withColumn("outcome", took)
    if not dry_run:
        df = df.withColumn("level", F.when(F.col("ambiguous"), F.coalesce("decided", "level")).otherwise(F.col("level")))
    return df.drop("decided")


def outcomes(merged: DataFrame, most: int = MOST_PER_CALL) -> DataFrame:
    """Counts a document; lines over the cap are counted as such."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    df = merged.filter("ambiguous").withColumn("over", F.row_number().over(order) > most)
    count = lambda name: F.count_if((F.col("outcome") == name) & ~F.col("over")).alias(name)
    return df.groupBy("doc_id").agg(F.count("*").alias("total_ambiguous"), count("changed"), count("confirmed"), count("no_decision"), F.count_if("over").alias("over_cap"))


def with_failures(counted: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Outcome counts with failed_parse: the lines that were sent, of documents (doc_id) whose
    response held no decision; these lines count as nothing else."""
    gone = unreadable.select("doc_id").distinct().withColumn("_failed", F.lit(True))
    df = counted.join(gone, "doc_id", "left")
    failed = F.coalesce("_failed", F.lit(False))
    df = df.withColumn("failed_parse", F.when(failed, F.col("total_ambiguous") - F.col("over_cap")).otherwise(F.lit(0)))
    return df.withColumn("no_decision", F.when(failed, F.lit(0)).otherwise(F.col("no_decision"))).drop("_failed")


def unreadable(responses: DataFrame) -> DataFrame:
    """(doc_id) of responses without any decision."""
    return parsed_responses(responses).filter(F.size("parsed") < 1).select("doc_id")


def priced(calls: DataFrame, prices: Mapping[str, tuple[float, float]] | None = None, default: str = "gemini-2.5-flash") -> DataFrame:
    """Adds price_in and price_out by model; an unknown model costs what `default` does."""
    table = dict(prices or PRICES)
    spark = calls.sparkSession
    dim = spark.createDataFrame([(m, *p) for m, p in table.items()], "model string, price_in double, price_out double")
    df = calls.join(F.broadcast(dim), "model", "left")
    return df.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in zip(("price_in", "price_out"), table[default], strict=True)})


def cost(tokens_in: Column, tokens_out: Column, tokens_think: Column, price_in: Column, price_out: Column) -> Column:
    """Dollars for a call."""
    return tokens_in * price_in / 1e6 + (tokens_out + tokens_think) * price_out / 1e6


def cost_report(calls: DataFrame, by: str = "model") -> DataFrame:
    """Calls, tokens, dollars, won and batch price, and the mean input price weighted by tokens."""
    df = priced(calls).withColumn("usd", cost(*map(F.col, ("tokens_in", "tokens_out", "tokens_think", "price_in", "price_out"))))
    weight = F.sum("tokens_in")
    mean = F.when(weight > 0, F.sum(F.col("tokens_in") * F.col("price_in")) / weight).otherwise(0.0)
    out = df.groupBy(by).agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum(F.col("tokens_out") + F.col("tokens_think")).alias("tokens_out"), F.round(F.sum("usd"), 8).alias("usd"), F.round(mean, 8).alias("mean_price_in"))
    return out.withColumns({"krw": F.round(F.col("usd") * KRW_PER_USD, 4), "batch_usd": F.round(F.col("usd") * BATCH_DISCOUNT, 8)})


def ensemble(draws: DataFrame, aggregated: DataFrame) -> DataFrame:
    """(doc_id, outcome, tokens_in, tokens_out, price_in, price_out) of ensembles.

    `draws` is (doc_id, draw, error, tokens_in, tokens_out, tokens_think, price_in, price_out),
    `aggregated` the same without draw and error, one row a document.  No draw without an error
    is a failure, a single one stands as it is, of several the aggregator's answer counts; its
    tokens are added and prices are means weighted by tokens.
    """
    out = F.col("tokens_out") + F.col("tokens_think")
    fine = F.col("error").isNull()
    sums = draws.groupBy("doc_id").agg(
        F.count_if(fine).alias("n_draws"),
        *(F.sum(F.when(fine, c).otherwise(0)).alias(n) for n, c in (("_in", F.col("tokens_in")), ("_out", out), ("_cost_in", F.col("tokens_in") * F.col("price_in")), ("_cost_out", out * F.col("price_out")))),
    )
    extra = aggregated.select("doc_id", F.col("tokens_in").alias("_a_in"), out.alias("_a_out"), F.col("price_in").alias("_p_in"), F.col("price_out").alias("_p_out"))
    df = sums.join(extra, "doc_id", "left")
    used = F.col("n_draws") > 1
    add = lambda own, more: F.col(own) + F.when(used, F.coalesce(more, F.lit(0))).otherwise(0)
    mean = lambda cost_, n, a, p: F.when(add(n, F.col(a)) > 0, add(cost_, F.col(a) * F.col(p)) / add(n, F.col(a))).otherwise(0.0)
    outcome = F.when(F.col("n_draws") == 0, "failed").when(~used, "single").otherwise("aggregated")
    return df.select("doc_id", "n_draws", outcome.alias("outcome"), add("_in", F.col("_a_in")).alias("tokens_in"), add("_out", F.col("_a_out")).alias("tokens_out"), mean("_cost_in", "_in", "_a_in", "_p_in").alias("price_in"), mean("_cost_out", "_out", "_a_out", "_p_out").alias("price_out"))


def majority(draws: Sequence[Column], near: Column) -> Column:
    """struct(level, votes) of one line's draws, one column each: as `vote`, within the row."""
    votes = lambda x: sum((F.when(x.eqNullSafe(y), 1).otherwise(0) for y in draws), F.lit(0))
    ranked = [F.struct((-votes(x)).alias("n"), F.abs(x - F.coalesce(near, F.lit(0))).alias("far"), x.alias("level")) for x in draws]
    best = F.array_min(F.array(*ranked))
    return F.struct(best["level"].alias("level"), (-best["n"]).cast("long").alias("votes"))


def vote(draws: DataFrame) -> DataFrame:
    """(doc_id, line_no, level, votes) from draws (doc_id, line_no, draw, level, near).

    The majority; of tied levels the one nearest to that of the heading before (`near`), then the lower.
    """
    n = draws.groupBy("doc_id", "line_no", "level").agg(F.count("*").alias("votes"), F.max("near").alias("near"))
    order = Window.partitionBy("doc_id", "line_no").orderBy(F.col("votes").desc(), F.abs(F.col("level") - F.coalesce("near", F.lit(0))), "level")
    return n.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("doc_id", "line_no", "level", "votes")
