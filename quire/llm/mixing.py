"""Mixing sources to target weights: entropy balancing of document rates.

Method: the mix takes each document at a rate between 0 and a cap.  Among all rates that
meet the token targets of every margin (here: of every source) the one nearest to the corpus
in relative entropy is the exponential tilt rate = min(cap, exp(z * multipliers)), where z is
the document's size over the mean size of its source and the multipliers are those of its
margins.  They solve the convex dual.  Newton steps run as Spark aggregations over the table
of cells (distinct sizes by source, with their counts): each margin's tokens taken and their
slope give its next multiplier, kept between bounds that close in on the solution; nothing but
a convergence figure reaches the driver.  Rates are then rounded into copies: every source is
dealt into buckets of some thousand documents by the hash of id and text, and the rounding
error is carried through a bucket from the longest document to the shortest, as rows stream by.

Sizes are words: runs of characters other than blank and tab..carriage return.

Defined cases: a null text has size 0; a very long text has a rate near 0 or near the cap; a
null source is a source of its own, the last; rows repeat as often as they stand in the table,
and rows equal in id, size and text are dealt as if they were one after the other; documents
of size 0 take nothing; if all sizes are 0, all targets are 0; an empty table gives an empty
result; other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import _frames

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3.0
#: Documents a rounding bucket holds on average.
BUCKET_DOCS = 4096
MAX_SWEEPS = 60
#: A multiplier at which every rate is at the cap, or 0.
FAR = 1e4
TOLERANCE = 1e-9


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, n_docs, target): shares by repeating weights, capped, excess reshared.

    The fixed point gives each source min(cap * size, level * weight).  The level is raised
    until no further source is above its cap; each raise is one small aggregation.
    """
    sources = _frames.cut(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs")))
    ranked = _frames.numbered(sources, F.col("source").asc_nulls_last())
    share = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    ranked = _frames.cut(ranked.select("source", "source_size", "n_docs", share.alias("weight"), (F.lit(cap) * F.col("source_size")).alias("most")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1
    while True:
        above = F.col("most") <= F.lit(level) * F.col("weight")
        n, used, free = ranked.agg(F.count_if(above), F.sum(F.when(above, F.col("most")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if n == before or not free:
            break
        level, before = (total - used) / free, n
    return ranked.select("source", "source_size", "n_docs", F.least(F.col("most"), F.lit(level) * F.col("weight")).alias("target"))


def balance(cells: DataFrame, margins: Sequence[str], cap: float = CAP) -> DataFrame:
    """Adds `rate` and `lam_<margin>` to cells by Newton's method on the dual.

    Cells have the margin columns, `tokens`, `target_<margin>` each, and `z` (without it: 1).
    With one margin its multiplier stays between bounds, and a step that leaves them halves
    what is between; with several the margins take turns.
    """
    now = cells if "z" in cells.columns else cells.withColumn("z", F.lit(1.0))
    now = now.withColumns({f"{k}_{m}": F.lit(v) for m in margins for k, v in (("lam", 0.0), ("lo", -FAR), ("hi", FAR), ("error", 0.0))})
    tilt = F.col("z") * sum((F.col(f"lam_{m}") for m in margins), F.lit(0.0))
    rate = F.least(F.lit(cap), F.exp(tilt))
    for _ in range(MAX_SWEEPS):
        for m in margins:
            own = now.groupBy(F.col(m).alias("_margin")).agg(
                F.sum(F.col("tokens") * rate).alias("took"),
                F.sum(F.when(tilt < math.log(cap), F.col("tokens") * F.col("z") * rate).otherwise(0.0)).alias("slope"),
                F.sum("tokens").alias("whole"),
                *(F.first(f"{k}_{m}").alias(k) for k in ("target", "lam", "lo", "hi")),
            )
            took, target, lam = F.col("took"), F.col("target"), F.col("lam")
            lo = F.when(took < target, lam).otherwise(F.col("lo")) if len(margins) == 1 else F.lit(-FAR)
            hi = F.when(took > target, lam).otherwise(F.col("hi")) if len(margins) == 1 else F.lit(FAR)
            own = own.withColumns({"lo": lo, "hi": hi}).withColumn("newton", lam + F.try_divide(took * F.log(F.try_divide(target, took)), F.col("slope")))
            halved = F.when(F.col("hi") >= FAR, 2 * F.abs(lam) + 1).when(F.col("lo") <= -FAR, -2 * F.abs(lam) - 1).otherwise((F.col("lo") + F.col("hi")) / 2)
            within = (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi"))
            full = target >= cap * F.col("whole") * (1 - 1e-12)
            lam = F.when(F.col("whole") <= 0, 0.0).when(target <= 0, -FAR).when(full, FAR).when(F.abs(took - target) <= TOLERANCE * target, lam).when(F.coalesce(within, F.lit(False)), F.col("newton")).otherwise(halved)
            error = F.when((F.col("whole") <= 0) | (target <= 0) | full, 0.0).otherwise(F.try_divide(F.abs(took - target), target))
            own = own.select("_margin", lam.alias(f"lam_{m}"), F.col("lo").alias(f"lo_{m}"), F.col("hi").alias(f"hi_{m}"), error.alias(f"error_{m}"))
            now = now.drop(*(f"{k}_{m}" for k in ("lam", "lo", "hi", "error"))).join(own, F.col(m).eqNullSafe(F.col("_margin"))).drop("_margin")
        # A table read anew has a size; estimates of a checkpoint would multiply from sweep to sweep.
        now = _frames.stored(now, "cells")
        worst = now.agg(F.max(F.greatest(F.lit(0.0), *(F.col(f"error_{m}") for m in margins)))).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    now = now.withColumn("rate", F.when(F.col("tokens") > 0, rate).otherwise(F.lit(1.0)))
    return now.drop(*(f"{k}_{m}" for m in margins for k in ("lo", "hi", "error")))


def round_copies(rates: Sequence[float], sizes: Sequence[int], carry: float = 0.0) -> tuple[list[int], float]:
    """Whole copies next to each rate, and the error left; rows come from the longest to the shortest."""
    copies = []
    for rate, size in zip(rates, sizes, strict=True):
        low, high = math.floor(rate + 1e-9), math.ceil(rate - 1e-9)
        want = rate * size + carry
        n = min(high, max(low, math.floor(want / size + 0.5))) if size else low
        copies.append(n)
        carry = want - n * size
    return copies, carry


@F.arrow_udf(T.LongType())
def _dealt(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Copies of rows that stream by bucket; nothing of a bucket but its error so far is held."""
    bucket, carry = None, 0.0
    for source, number, rate, size in columns:
        own = list(zip(source.to_pylist(), number.to_pylist(), strict=True))
        rates, sizes = rate.to_pylist(), size.to_pylist()
        copies: list[int] = []
        at = 0
        while at < len(own):
            end = at + 1
            while end < len(own) and own[end] == own[at]:
                end += 1
            made, carry = round_copies(rates[at:end], sizes[at:end], carry if own[at] == bucket else 0.0)
            copies += made
            bucket, at = own[at], end
        yield pa.array(copies, pa.int64())


def mix(docs: DataFrame, size: Column, weights: Sequence[int] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, copies), one row for each row of `docs`.

    `row` is a struct of all columns of `docs`, so that none of them can clash with ours.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    tie = next((F.xxhash64(c) for c in ("text", "text_hash") if c in docs.columns), F.lit(0).cast("long"))
    docs = docs.select(whole, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), size.cast("long").alias("size"), tie.alias("_tie"))
    sizes = _frames.cut(docs.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = _frames.cut(source_targets(sizes, weights, cap))
    mean = F.col("source_size") / F.col("n_docs")
    to = targets.select(F.col("source").alias("_source"), F.col("target").alias("target_source"), mean.alias("mean"))
    cells = sizes.filter("size > 0").join(to, F.col("source").eqNullSafe(F.col("_source")))
    cells = _frames.cut(cells.select("source", (F.col("n") * F.col("size")).cast("double").alias("tokens"), (F.col("size") / F.col("mean")).alias("z"), "target_source"))
    tilts = balance(cells, ["source"], cap).groupBy(F.col("source").alias("_other")).agg(F.first("lam_source").alias("tilt"))
    about = targets.withColumnRenamed("source", "_source").join(tilts, F.col("_source").eqNullSafe(F.col("_other")), "left").drop("_other")
    rows = _frames.join_small(docs, _frames.cut(about), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("size") > 0, F.least(F.lit(cap), F.exp(F.col("tilt") * F.col("size") / mean))).otherwise(F.lit(1.0))
    bucket = F.pmod(F.xxhash64("doc_id", "_tie"), F.ceil(F.col("n_docs") / BUCKET_DOCS))
    rows = rows.withColumns({"rate": rate, "_bucket": bucket}).drop("n_docs", "tilt")
    order = ["source", "_bucket", F.col("size").desc(), "doc_id", "_tie"]
    rows = rows.repartition("source", "_bucket").sortWithinPartitions(*order)
    # Only what is dealt goes to Python; it goes in this order, so the function must not be moved.
    copies = _dealt.asNondeterministic()("source", "_bucket", "rate", "size")
    return rows.withColumn("copies", copies).drop("rate", "_bucket", "_tie")


def mixed_rows(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """`docs` as the mix takes them: each row as often as its copies say."""
    taken = mix(docs, size_of(), weights, cap).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", size_of().alias("size"), F.xxhash64("text").alias("text_hash"))
    mixed = mix(_frames.cut(docs), F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
