from __future__ import annotations

import json

from pyspark.sql import functions as F

from quire.operators import events, transcripts
from quire.streaming import live

SINCE = 1_700_000_010.0


def log_rows(lo, hi):
    return [(1_700_000_000.0 + i, (events.IMPRESSION, events.CLICK, events.FAILED, "other")[i % 4], ["a", "b", "", None][i % 3 if i < 50 else 3]) for i in range(lo, hi)]


def test_a_dashboard_that_stops_and_goes_on_is_the_batch_one(spark, tmp_path):
    log, out, checkpoint = (f"{tmp_path}/{n}" for n in ("log", "out", "checkpoint"))
    since = F.timestamp_seconds(F.lit(SINCE))
    schema = "ts double, event string, channel string"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(log)
        live.start(live.channel_changes(stream, since), out, checkpoint).awaitTermination(300)

    def check():
        want = events.by_channel(spark.read.schema(schema).json(log), since)
        got = live.dashboard(spark, out).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    spark.createDataFrame(log_rows(0, 60), schema).repartition(2).write.json(log)
    run()
    check()
    spark.createDataFrame(log_rows(30, 110), schema).repartition(2).write.mode("append").json(log)
    run()  # a new query on the old checkpoint
    check()
    assert live.dashboard(spark, out).count() == 3
    run()  # nothing new
    check()


def session(k, n):
    rows = []
    for pos in range(n):
        kind = ("user", "assistant", "user", "assistant", "system")[(pos + k) % 5]
        text = f"{'<command-name>' if pos % 7 == 3 else ''}message {k} {pos} key ghp_{'a' * 36}"
        content = json.dumps(text) if pos % 2 else json.dumps([{"type": "text", "text": text if pos % 3 else " "}, {"type": "tool_use", "name": "Bash"}])
        rows.append((k, pos, kind, pos % 11 == 5, k % 3 == 0 and pos in (4, 9), content))
    return rows


def test_signals_by_state_are_the_batch_ones(spark, tmp_path):
    log, out, checkpoint = (f"{tmp_path}/{n}" for n in ("log", "out", "checkpoint"))
    rows = [r for k in range(9) for r in session(k, 230 if k == 7 else 4 + 3 * k)] + [(50, 0, "user", False, True, '"boundary alone"')]

    def run():
        stream = spark.readStream.schema(live.RECORDS).option("maxFilesPerTrigger", 1).json(log)
        live.start(live.session_changes(stream), out, checkpoint).awaitTermination(300)

    for lo, hi in ((0, 3), (3, 10), (10, 999)):
        part = [r for r in rows if lo <= r[1] < hi]
        spark.createDataFrame(part, live.RECORDS).coalesce(1).write.mode("append").json(log)
        run()
        batch = spark.read.schema(live.RECORDS).json(log)
        want = transcripts.signals(batch)
        got = {r.session_id: tuple(r)[1:] for r in live.signals(spark, out).select(*want.columns).collect()}
        expected = {r.session_id: tuple(r)[1:] for r in want.collect()}
        assert {k: v for k, v in got.items() if k in expected} == expected
        assert all(v[:2] == ("", "") for k, v in got.items() if k not in expected)
