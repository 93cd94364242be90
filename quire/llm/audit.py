"""Filter interaction audit: what each filter removes, alone and behind the others.

Method.  Four filters look at a text alone and are column expressions; the fifth fails texts
that a smaller doc_id has too.  Such duplicates are found by sorting: rows whose 64-bit hash
occurs once cannot have any and are left out; the others are range-sorted by the text's
fingerprint (SHA-256) and doc_id and sorted by fingerprint, full text and doc_id, so that a
group of copies of any size is dealt over as many tasks as it fills.  Each row's text is
compared with its predecessor's, and a group's first row has its smallest doc_id.  Where a
group runs over a boundary between tasks, the rows before a task's first change of text carry
its fingerprint, and each task leaves one row with its last text's: these few rows are joined.

The failures of a row are a mask of bits.  Counts by part and mask add up, so everything that
is asked about orders of filters follows from at most 32 numbers for each part.

Defined cases: a null text is empty, a null lang the part of the empty string; a null doc_id
counts as larger than every other; rows that repeat a doc_id count each and are no duplicates
of each other by it; a document is good or toxic if any of its label rows says so, and labels
without doc_id belong to none; very long texts are worked on whole; an empty table gives an
empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _frames

LETTERS = "ABCDE"
LAST = (1 << 63) - 1
BLANKS = "[\\x20\\x09-\\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Hashes that are shipped to all tasks at most (8 MB); with more of them all rows are sorted.
MOST_SHIPPED = 1 << 20


def text_failures(rows: DataFrame, out: str = "mask") -> DataFrame:
    """Adds the mask of the filters A to D over `text`, which must not be null.

    A: under 100 words; B: less than 80 % of the words are distinct; C: more than 10 % of the
    characters are capitals A-Z; D: any of # $ % & * |.
    """
    words = F.array_remove(F.split("text", BLANKS), "")
    counted = rows.withColumn("_words", words).withColumns({"_n": F.size("_words"), "_distinct": F.size(F.array_distinct("_words")), "_chars": F.char_length("text")})
    failed = [
        F.col("_n") < 100,
        100 * F.col("_distinct") < 80 * F.col("_n"),
        100 * (F.col("_chars") - F.char_length(F.translate("text", CAPITALS, ""))) > 10 * F.col("_chars"),
        F.col("text").rlike("[#$%&*|]"),
    ]
    mask = sum((F.when(f, F.lit(1 << k)).otherwise(0) for k, f in enumerate(failed)), F.lit(0))
    return counted.withColumn(out, mask).drop("_words", "_n", "_distinct", "_chars")


SORTED = "doc_id long, part string, mask int, key long, low long, edge binary, last boolean"


def _predecessors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted rows: `low` is the smallest key of a row's text within this task, `edge`
    the fingerprint of rows before the first change of text, and of the `last` row."""
    text = edge = None
    low, first = 0, True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts, keys = batch.column("text"), batch.column("key").to_numpy()
        fresh = np.ones(n, bool)
        fresh[1:] = ~pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        head = texts[0].as_py()
        fresh[0] = head != text
        if text is None:
            edge = hashlib.sha256(head.encode()).digest()
            low = int(keys[0])
            fresh[0] = False
        starts = np.flatnonzero(fresh)
        until = int(starts[0]) if len(starts) else n
        lows = np.empty(n, np.int64)
        lows[:until] = low
        lows[until:] = np.repeat(keys[starts], np.diff(np.append(starts, n)))
        edges = [edge] * until + [None] * (n - until) if first else [None] * n
        first &= until == n
        low, text = int(lows[-1]), texts[n - 1].as_py()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("mask"), batch.column("key"), pa.array(lows), pa.array(edges, pa.binary()), pa.array(np.zeros(n, bool))], [c.split()[0] for c in SORTED.split(", ")])
    if text is not None:
        own = [pa.array([v], t) for v, t in zip((None, None, None, None, low, hashlib.sha256(text.encode()).digest(), True), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()), strict=True)]
        yield pa.RecordBatch.from_arrays(own, [c.split()[0] for c in SORTED.split(", ")])


def _sorted_failures(rows: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of rows (doc_id, part, key, text), with the bit of E, by sorting."""
    keyed = rows.withColumn("print", F.sha2("text", 256))
    dealt = keyed.repartitionByRange("print", "key").sortWithinPartitions("print", "text", "key")
    flagged = text_failures(dealt).select("doc_id", "part", F.col("mask").cast("int").alias("mask"), "key", "text")
    seen = _frames.stored(flagged.mapInArrow(_predecessors, SORTED), "sorted")
    # One row a task at most.
    ends = F.broadcast(seen.filter("last").groupBy("edge").agg(F.min("low").alias("_before")))
    smallest = F.least("low", F.coalesce("_before", "low"))
    return seen.filter("not last").join(ends, "edge", "left").select("doc_id", "part", (F.col("mask") + F.when(F.col("key") > smallest, 16).otherwise(0)).alias("mask"))


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row; bit k of `mask` says that it fails filter k of LETTERS."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"key": F.coalesce("doc_id", F.lit(LAST)), "hash": F.xxhash64("text")})
    looked = _frames.stored(text_failures(rows).select("doc_id", "part", "mask", "hash"), "looked")
    repeated = _frames.cut(looked.groupBy("hash").count().filter("count > 1").select("hash"))
    if repeated.limit(MOST_SHIPPED + 1).count() > MOST_SHIPPED:
        return _sorted_failures(rows)
    several = F.broadcast(repeated)
    alone = looked.join(several, "hash", "left_anti").select("doc_id", "part", "mask")
    return alone.unionByName(_sorted_failures(rows.join(several, "hash", "left_semi")))


def counters(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, entries): for each part its masks with the numbers of documents, good and toxic ones."""
    says = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("cast(quality <=> 1 as long)")).alias("good"), F.max(F.expr("cast(toxic <=> 1 as long)")).alias("toxic"))
    # Rows without an id match nothing and are dealt by hash, not to one task.
    dealt = failed.withColumn("_salt", F.when(F.col("doc_id").isNull(), F.spark_partition_id() + 1).otherwise(0))
    both = dealt.join(says.withColumn("_salt", F.lit(0)), ["doc_id", "_salt"], "left")
    masks = both.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    return masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("entries"))


def _orders(letters: str) -> Column:
    """All steps of all orders, as a constant array."""
    steps = []
    for order in permutations(range(len(letters))):
        before = 0
        for k, f in enumerate(order):
            steps.append({"filter_order": "".join(letters[x] for x in order), "step": k + 1, "bit": 1 << f, "before": before})
            before |= 1 << f
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    steps = counters(failures(docs), labels).select("part", "entries", F.explode(_orders(LETTERS)).alias("s")).select("part", "entries", "s.*")
    bit, before = F.col("bit"), F.col("before")

    def total(where, value) -> Column:
        return F.aggregate(F.filter("entries", where), F.lit(0).cast("long"), lambda s, e: s + value(e))

    def fails(e: Column) -> Column:
        return e["mask"].bitwiseAND(bit) != 0

    def early(e: Column) -> Column:
        return e["mask"].bitwiseAND(before) != 0

    def here(e: Column) -> Column:
        return fails(e) & ~early(e)

    # A row with m failures is removed by each of them first in one m-th of all orders.
    share = math.factorial(len(LETTERS))
    return steps.select(
        "part", "filter_order", "step",
        total(lambda e: ~fails(e) & ~early(e), lambda e: e["n"]).alias("kept"),
        total(here, lambda e: e["n"]).alias("removed"),
        total(lambda e: fails(e) & early(e), lambda e: e["n"]).alias("redundant"),
        total(lambda e: e["mask"] == bit, lambda e: e["n"]).alias("unique_fails"),
        total(here, lambda e: e["good"]).alias("good_lost"),
        total(here, lambda e: e["toxic"]).alias("toxic_lost"),
        total(fails, lambda e: e["n"] * (F.lit(share) / F.bit_count(e["mask"])).cast("long")).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
with w as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
f as (
  select doc_id, part, len(w) < 100 as a, 100 * len(list_distinct(w)) < 80 * len(w) as b,
    100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(t) as c,
    regexp_matches(t, '[#$%&*|]') as d,
    coalesce(doc_id, 9223372036854775807) > min(coalesce(doc_id, 9223372036854775807)) over (partition by t) as e from w),
g as (select doc_id, max((coalesce(quality, 0) = 1)::int) as good, max((coalesce(toxic, 0) = 1)::int) as toxic from labels where doc_id is not null group by doc_id),
m as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int as mask, a::int + b::int + c::int + d::int + e::int as fails
  from f left join g using (doc_id)),
c as (select part, mask, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as bit),
o as (
  select p.x || q.x || r.x || s.x || t.x as filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] as bits
  from l p, l q, l r, l s, l t where p.bit | q.bit | r.bit | s.bit | t.bit = 31),
s as (select filter_order, k::integer as step, bits[k] as bit, list_sum(list_prepend(0, bits[1:k - 1]))::int as before from o, range(1, 6) r(k))
select part, filter_order, step,
  coalesce(sum(n) filter (mask & (bit | before) = 0), 0)::bigint as kept,
  coalesce(sum(n) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as removed,
  coalesce(sum(n) filter (mask & bit <> 0 and mask & before <> 0), 0)::bigint as redundant,
  coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as good_lost,
  coalesce(sum(toxic) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as toxic_lost,
  coalesce(sum(n * 120 // nullif(fails, 0)) filter (mask & bit <> 0), 0)::bigint as shapley
from c, s group by part, filter_order, step
"""
