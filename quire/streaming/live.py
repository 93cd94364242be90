"""Dashboards and session signals kept by state: a batch touches only the keys that it brings.

Each key has a state of its own (`transformWithState`), and what changes is appended: the rows of
a batch are written under its number, so that a batch that is run again replaces itself and a
reader takes each key's newest row.  Where a query stopped, its checkpoint lets it go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.functions import text as T
from quire.operators import events, transcripts

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTS = "impressions long, clicks long, load_failures long"
RECORDS = "session_id long, pos long, type string, is_meta boolean, is_boundary boolean, content string"


class Totals(StatefulProcessor):
    """Running counts of a channel."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("totals", COUNTS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total = list(self.state.get()) if self.state.exists() else [0, 0, 0]
        for pdf in rows:
            for k, event in enumerate((events.IMPRESSION, events.CLICK, events.FAILED)):
                total[k] += int((pdf["event"] == event).sum())
        self.state.update(tuple(total))
        yield pd.DataFrame({"channel": [key[0]], **dict(zip(("impressions", "clicks", "load_failures"), ([t] for t in total), strict=True))})

    def close(self) -> None:
        pass


class Sessions(StatefulProcessor):
    """The first ask and the last answer behind a session's last boundary.

    With a boundary these two are all that is kept; without one, the last `tail` records that an
    answer may come from.  Records of a session arrive in order.
    """

    def __init__(self, tail: int = transcripts.TAIL):
        self.tail = tail

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.behind = handle.getValueState("behind", "ask string, answer string")
        self.records = handle.getListState("records", "ask string, answer string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("pos", kind="stable")
        bounded = self.behind.exists()
        ask, answer = self.behind.get() if bounded else (None, None)
        held = [] if bounded else [tuple(r) for r in self.records.get()]
        for boundary, a, b in zip(new["is_boundary"], new["ask"], new["answer"], strict=True):
            a, b = (None if pd.isna(x) else x for x in (a, b))
            if boundary is True or boundary == 1:
                bounded, ask, answer, held = True, None, None, []
            elif bounded:
                ask, answer = a if ask is None else ask, b if b is not None else answer
            else:
                held = [*held, (a, b)][-self.tail :]
        if bounded:
            self.behind.update((ask, answer))
            self.records.clear()
        else:
            self.records.put(held)
            ask = next((a for a, _ in held if a is not None), None)
            answer = next((b for _, b in reversed(held) if b is not None), None)
        yield pd.DataFrame({"session_id": [key[0]], "ask": [ask or ""], "answer": [answer or ""], "seen": [bounded or bool(held)]})

    def close(self) -> None:
        pass


def channel_changes(log: DataFrame, since: Column) -> DataFrame:
    """(channel, impressions, clicks, load_failures) of the channels that a batch brings, from a
    stream (ts, event, channel)."""
    rows = events.counted(log, since)
    schema = f"channel string, {COUNTS}"
    return rows.groupBy("channel").transformWithStateInPandas(Totals(), schema, "Update", "None")


def session_changes(records: DataFrame, tail: int = transcripts.TAIL) -> DataFrame:
    """(session_id, ask, answer, seen) of the sessions that a batch brings."""
    df = transcripts.with_blocks(records).withColumn("_last", transcripts.last_text())
    answered = (F.col("type") == "assistant") & (T.strip(F.col("_last")) != "")
    ask = F.when(transcripts.asked(), F.substring(transcripts.first_text(), 1, transcripts.ASK))
    answer = F.when(answered, F.substring("_last", 1, transcripts.ANSWER))
    rows = df.select("session_id", "pos", F.coalesce("is_boundary", F.lit(False)).alias("is_boundary"), ask.alias("ask"), answer.alias("answer"))
    key = records.schema["session_id"].dataType.simpleString()
    return rows.groupBy("session_id").transformWithStateInPandas(Sessions(tail), f"session_id {key}, ask string, answer string, seen boolean", "Update", "None")


def start(changes: DataFrame, out: str, checkpoint: str):
    """Appends changes to `out`, a folder for each batch, until what is there now has been read."""
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return changes.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The newest row of each key."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return best.select(key, "_row.*")


def dashboard(spark: SparkSession, out: str) -> DataFrame:
    """The channels as `events.by_channel` gives them."""
    return latest(spark, out, "channel")


def signals(spark: SparkSession, out: str) -> DataFrame:
    """The sessions as `transcripts.signals` gives them."""
    rows = latest(spark, out, "session_id").filter("seen")
    rows = rows.select("session_id", T.redact_secrets(F.col("ask")).alias("first_user_message"), T.redact_secrets(F.col("answer")).alias("last_assistant_text"))
    return rows.withColumn("topic", T.topic(F.col("first_user_message"))).withColumn("slug", T.slug(F.col("topic")))
