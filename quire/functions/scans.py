"""Running values of ordered rows: as windows, or segment by segment where one key's rows are too many for a task.

A segmented scan cuts the rows of a key into segments of bounded length.  Each segment is worked
on by itself; what it leaves to those behind (a smallest value, a last value, a count since a
reset) is one small row; a window over these rows gives what each segment begins with, and a join
on key and segment brings it to the rows.  All three states are associative, so the answers are
those of the windows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def least(df: DataFrame, values: Mapping[str, Column], segment: int | None = None, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Adds the smallest value among all rows of the key."""
    if segment is None:
        return df.withColumns({n: F.min(v).over(Window.partitionBy(key)) for n, v in values.items()})
    df = _cut(df, segment, order, key)
    whole = Window.partitionBy(key)
    ends = df.groupBy(key, "_segment").agg(*(F.min(v).alias(n) for n, v in values.items()), _whole(df))
    return _carried(df, ends.select(key, "_segment", "_read", *(F.min(n).over(whole).alias(f"_in_{n}") for n in values)), key, {n: F.col(f"_in_{n}") for n in values})


def last(df: DataFrame, values: Mapping[str, Column], segment: int | None = None, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Adds the last value that is not null among the rows before."""
    earlier = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if segment is None:
        return df.withColumns({n: F.last(v, ignorenulls=True).over(earlier) for n, v in values.items()})
    df = _cut(df, segment, order, key)
    inner = Window.partitionBy(key, "_segment").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = df.groupBy(key, "_segment").agg(*(F.max(F.when(v.isNotNull(), F.struct(F.col(order).alias("at"), v.alias("value"))))["value"].alias(n) for n, v in values.items()), _whole(df))
    before = Window.partitionBy(key).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(key, "_segment", "_read", *(F.last(n, ignorenulls=True).over(before).alias(f"_in_{n}") for n in values))
    df = df.withColumns({f"_own_{n}": F.last(v, ignorenulls=True).over(inner) for n, v in values.items()})
    return _carried(df, ends, key, {n: F.coalesce(f"_own_{n}", f"_in_{n}") for n in values}).drop(*(f"_own_{n}" for n in values))


def since(df: DataFrame, counts: Mapping[str, tuple[Column, Column]], segment: int | None = None, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Adds, for each (reset, item), how many items there are up to the row and since the last reset,
    that row included."""
    cut = [] if segment is None else ["_segment"]
    df = df if segment is None else _cut(df, segment, order, key)
    up_to = Window.partitionBy(key, *cut).orderBy(order)
    one = lambda c: F.when(c, 1).otherwise(0)
    # What there is up to the row, less what there was before the last reset: totals never fall, so
    # the largest total before a reset is the last, and all counts share one sort.
    df = df.withColumns({f"_reset_{n}": reset for n, (reset, _) in counts.items()} | {f"_item_{n}": one(item) for n, (_, item) in counts.items()})
    before = up_to.rangeBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"_all_{n}": F.sum(f"_item_{n}").over(up_to) for n in counts} | {f"_old_{n}": F.coalesce(F.sum(f"_item_{n}").over(before), F.lit(0)) for n in counts})
    df = df.withColumns({f"_from_{n}": F.max(F.when(F.col(f"_reset_{n}"), F.col(f"_old_{n}"))).over(up_to) for n in counts})
    df = df.drop(*(f"_{what}_{n}" for n in counts for what in ("reset", "item", "old")))
    own, inner = {n: F.col(f"_all_{n}") - F.coalesce(f"_from_{n}", F.lit(0)) for n in counts}, [f"_{what}_{n}" for n in counts for what in ("all", "from")]
    if segment is None:
        return df.withColumns(own).drop(*inner)
    ends = df.groupBy(key, "_segment").agg(*(F.max(f"_all_{n}").alias(f"_all_{n}") for n in counts), *(F.max(f"_from_{n}").alias(f"_from_{n}") for n in counts), _whole(df))
    run = Window.partitionBy(key).orderBy("_segment")
    # The same over segments: all items up to each, less those before the last reset.
    ends = ends.withColumns({f"_sum_{n}": F.sum(f"_all_{n}").over(run) for n in counts})
    ends = ends.withColumns({f"_base_{n}": F.max(F.col(f"_sum_{n}") - F.col(f"_all_{n}") + F.col(f"_from_{n}")).over(run) for n in counts})
    ends = ends.select(key, "_segment", "_read", *(F.lag(F.col(f"_sum_{n}") - F.coalesce(f"_base_{n}", F.lit(0)), 1, 0).over(run).alias(f"_in_{n}") for n in counts))
    filled = {n: own[n] + F.when(F.col(f"_from_{n}").isNull(), F.col(f"_in_{n}")).otherwise(0) for n in counts}
    return _carried(df, ends, key, filled).drop(*inner)


def _cut(df: DataFrame, segment: int, order: str, key: str) -> DataFrame:
    """Dealt by key and segment, so that a key's segments are worked on by several tasks."""
    return df.withColumn("_segment", F.floor(F.col(order) / segment)).repartition(key, "_segment")


def _whole(df: DataFrame) -> Column:
    """Something of every column: rows and ends then read one exchange, so that the rows are made once."""
    return F.max(F.xxhash64(*df.columns)).alias("_read")


def _carried(df: DataFrame, ends: DataFrame, key: str, columns: Mapping[str, Column]) -> DataFrame:
    """Adds columns over the rows and what their segment begins with."""
    ends = ends.filter("_read is not null").withColumnRenamed(key, "_key").withColumnRenamed("_segment", "_at").drop("_read")
    both = df.join(ends, df[key].eqNullSafe(ends["_key"]) & (df["_segment"] == ends["_at"]), "left")
    carried = [c for c in ends.columns if c.startswith("_in_")]
    return both.withColumns(dict(columns)).drop("_key", "_at", "_segment", *carried)
