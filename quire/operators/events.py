"""An event log: counts, a dashboard by channel with rates and revenue, a grand total."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

IMPRESSION, CLICK, FAILED = "ad_impression", "ad_click", "ad_load_failed"
# Won a click and a thousand impressions by channel.
RATES = {"coupang": (20.0, 0.0), "adsense": (300.0, 2000.0), "text_ad": (0.0, 0.0)}


def counts(events: DataFrame) -> DataFrame:
    """(event, n); an event without a name counts as '?'."""
    return events.groupBy(F.coalesce("event", F.lit("?")).alias("event")).agg(F.count("*").alias("n"))


def counted(events: DataFrame, since: Column) -> DataFrame:
    """(channel, event) of the events (ts, event, channel) that count.

    `ts` are seconds; rows without a time and those before `since` go, later ones all count.
    """
    channel = F.coalesce(F.nullif("channel", F.lit("")), F.lit("unknown"))
    rows = events.filter(F.col("event").isin(IMPRESSION, CLICK, FAILED) & (F.col("ts") > 0) & (F.timestamp_seconds("ts") >= since))
    return rows.select(channel.alias("channel"), "event")


def by_channel(events: DataFrame, since: Column) -> DataFrame:
    """(channel, impressions, clicks, load_failures) of events (ts, event, channel), as `counted` takes them."""
    count = lambda e: F.count_if(F.col("event") == e)
    return counted(events, since).groupBy("channel").agg(count(IMPRESSION).alias("impressions"), count(CLICK).alias("clicks"), count(FAILED).alias("load_failures"))


def with_revenue(stats: DataFrame, rates: Mapping[str, tuple[float, float]] = RATES) -> DataFrame:
    """Adds ctr and revenue_krw; a channel without a rate earns nothing."""
    dim = F.broadcast(stats.sparkSession.createDataFrame([(k, *v) for k, v in rates.items()], "channel string, _click double, _mille double"))
    df = stats.join(dim, "channel", "left")
    revenue = F.col("clicks") * F.coalesce("_click", F.lit(0.0)) + F.col("impressions") / 1000 * F.coalesce("_mille", F.lit(0.0))
    return df.select(*stats.columns, click_rate().alias("ctr"), F.round(revenue, 6).alias("revenue_krw"))


def click_rate() -> Column:
    return F.round(F.when(F.col("impressions") > 0, F.col("clicks") / F.col("impressions")).otherwise(0.0), 8)


def dashboard(events: DataFrame, since: Column, rates: Mapping[str, tuple[float, float]] = RATES) -> DataFrame:
    """Channels and a total row (channel null), whose rate is that of the totals.

    Each channel's row counts for itself and for the total, so the events are read once; a row of
    zeros lets the total of no events stand too.
    """
    rows = with_revenue(by_channel(events, since), rates).drop("ctr")
    numbers = [c for c in rows.columns if c != "channel"]
    zero = rows.sparkSession.createDataFrame([(None, *[0] * len(numbers))], "channel string, " + ", ".join(f"{c} long" for c in numbers))
    both = rows.select(F.explode(F.array("channel", F.lit(None))).alias("channel"), *numbers).unionByName(zero)
    sums = both.groupBy("channel").agg(*(F.sum(c).alias(c) for c in numbers))
    return sums.select("channel", *(c for c in numbers if c != "revenue_krw"), click_rate().alias("ctr"), F.round("revenue_krw", 6).alias("revenue_krw"))


def ordered(report: DataFrame) -> DataFrame:
    """All rows with their `rank` by revenue, then channel; the total last.  A report has a row a channel."""
    last, order = F.col("channel").isNull(), [F.col("revenue_krw").desc(), "channel"]
    ranked = report.withColumn("rank", F.row_number().over(Window.orderBy(last, *order)))
    return ranked.orderBy("rank")


def _slot_event(name: str, channel: Column, ts: Column, partner: Column | str, slot: Column | str) -> Column:
    word = lambda c: F.coalesce((F.lit(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    return F.struct(ts.alias("ts"), F.lit(name).alias("event"), channel.alias("channel"), word(partner).alias("partner_id"), word(slot).alias("ad_slot"))


def impression(channel: Column, ts: Column, partner: Column | str = "", slot: Column | str = "") -> Column:
    """An impression for the log."""
    return _slot_event(IMPRESSION, channel, ts, partner, slot)


def click(channel: Column, ts: Column, partner: Column | str = "", slot: Column | str = "") -> Column:
    """A click for the log."""
    return _slot_event(CLICK, channel, ts, partner, slot)


def load_failure(channel: Column, reason: Column, ts: Column, most: int = 120) -> Column:
    """A failure event for the log; the reason is cut."""
    return F.struct(ts.alias("ts"), F.lit(FAILED).alias("event"), channel.alias("channel"), F.substring(reason, 1, most).alias("reason"))
