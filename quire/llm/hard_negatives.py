"""Hard-negative mining: for anchors and their positives the best rows of other labels within a
window of scores below the positive's.

Method: distributed radix selection.  Rows are dealt into shards of bounded size, whatever their
ids; anchors, as a stated query set, are streamed past every shard in blocks.  The first pass
finds each anchor's positives.  Each positive opens a window of integer scores.  A round counts
each window's scores by their highest undecided eight bits: every shard sends the counts of the
best digits only, as many as hold k rows, and their sum names the digit of the k-th score.  The
window shrinks to that digit and the next round looks at the eight bits below, until the k-th
score is known or few enough rows are left above the digit's end.  The last pass gathers the
rows that reach a window's threshold, of equal scores the k smallest ids of each shard.

A shard's memory is its vectors and a block of scores, whatever the number of anchors, and what
it sends for a window is at most k rows, whatever the number of ties.

A row's score is its integer inner product with the anchor: exact, in floating point where no
sum can pass 2^53, else in whole numbers.  Higher scores come first, ties by smaller vec_id.

Defined cases: rows without vec_id or label, and vectors that are null, empty or hold null or
non-finite components take no part; vectors are compared only with those of their own length;
rows that repeat a vec_id are candidates each, but never of that id's own anchor; anchors equal
in id, label and vector count once; a positive with a score below zero has an empty window; fewer
rows than asked for give fewer; an empty table gives an empty result; a score beyond the range of
long is an error; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm import _frames, topk

#: Vectors of a shard on average, at most and at least (where the cluster has cores for more shards).
SHARD_ROWS, LEAST_ROWS = 1 << 16, 1 << 10
#: Scores that a block of anchors makes at once (16 MB).
BLOCK_SCORES = 1 << 21
#: Bits that a round decides.
DIGIT = 8
#: Times k rows that may be gathered for a window without a further round.
SPARE = 4

WINDOWS = "array<struct<place: int, lo: bigint, hi: bigint, base: bigint, shift: int, need: int>>"
KEYS = ["anchor_id", "anchor_key"]


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    largest = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0))
    if anchors.shape[1] * largest < 2.0**53:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    # A sum beyond 64 bits is an error here.
    return (anchors.astype(object) @ rows.astype(object).T).astype(np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by falling score, then by id."""
    at = np.arange(len(scores))
    if len(at) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


class Shard:
    """The vectors of a shard by their length."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        by_length: dict[int, list] = {}
        for part in parts:
            by_length.setdefault(part[2].shape[1], []).append(part)
        self.rows = {n: tuple(np.concatenate(c) for c in zip(*own, strict=True)) for n, own in by_length.items()}

    def stream(self, anchors: list[tuple[int, int, int, np.ndarray, list]]) -> Iterator[tuple]:
        """(anchor, ids, labels, scores) of the other rows, for anchors of one length."""
        length = len(anchors[0][3])
        if length not in self.rows:
            return
        ids, labels, vectors = self.rows[length]
        each = max(1, BLOCK_SCORES // len(ids))
        for k in range(0, len(anchors), each):
            block = anchors[k : k + each]
            for anchor, scores in zip(block, _scores(np.array([a[3] for a in block]), vectors), strict=True):
                other = np.flatnonzero(ids != anchor[0])
                yield anchor, ids[other], labels[other], scores[other]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    length = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(length):
        part = batch.take(pa.array(np.flatnonzero(length == n)))
        yield part, part.column("v").flatten().to_numpy().reshape(-1, n)


def _pass(step: Callable, names: list[str]) -> Callable:
    """Streams shards, their vectors first; `step` turns an anchor's scores into rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, shard = None, [], None
        for batch in batches:
            key, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(kind) != 0)) + 1
            out: list[tuple] = []
            for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True) if len(key) else ():
                if key[lo] != number:
                    number, held, shard = key[lo], [], None
                for part, rows in _parts(batch.slice(lo, hi - lo)):
                    ids, labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
                    if kind[lo] == 0:
                        held.append((ids, labels, rows))
                        continue
                    if shard is None:
                        shard, held = Shard(held), []
                    anchors = list(zip(ids.tolist(), part.column("anchor_key").to_pylist(), labels.tolist(), rows, part.column("windows").to_pylist(), strict=True))
                    for anchor, *scored in shard.stream(anchors):
                        out += [(*anchor[:2], *row) for row in step(anchor[2], anchor[4], *scored)]
            cols = list(zip(*out, strict=True)) if out else [[]] * (2 + len(names))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [*KEYS, *names])

    return run


def _positives(k: int) -> Callable:
    def step(label: int, _: list, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> Iterator[tuple]:
        same = labels == label
        ids, scores = ids[same], scores[same]
        at = _first(scores, ids, k)
        return zip(ids[at].tolist(), scores[at].tolist(), strict=True)

    return step


def _others(label: int, windows: list[dict], ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of other labels that some window may hold."""
    in_reach = (labels != label) & (scores >= min(w["lo"] for w in windows)) & (scores <= max(w["hi"] for w in windows))
    return ids[in_reach], scores[in_reach]


def _digits(label: int, windows: list[dict], ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> Iterator[tuple]:
    """(place, digit, n): the best digits of each window, as many as hold the rows it needs."""
    ids, scores = _others(label, windows, ids, labels, scores)
    for w in windows:
        below = w["hi"] - scores[(scores >= w["lo"]) & (scores <= w["hi"])] - w["base"]
        below = below[(below >= 0) & ((below >> w["shift"]) < 1 << DIGIT)]
        counts = np.bincount(below >> w["shift"], minlength=1)
        before = np.cumsum(counts) - counts
        for d in np.flatnonzero((counts > 0) & (before < w["need"])):
            yield w["place"], int(d), int(counts[d])


def _reached(k: int) -> Callable:
    """The rows of a window whose scores lie between `lo` and `hi`, k of a shard at most."""

    def step(label: int, windows: list[dict], ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> Iterator[tuple]:
        ids, scores = _others(label, windows, ids, labels, scores)
        for w in windows:
            own = np.flatnonzero((scores >= w["lo"]) & (scores <= w["hi"]))
            at = own[_first(scores[own], ids[own], k)]
            yield from ((w["place"], i, s) for i, s in zip(ids[at].tolist(), scores[at].tolist(), strict=True))

    return step


class Miner:
    """Rows in shards, and passes of anchors over them."""

    def __init__(self, rows: DataFrame, every: int):
        spark = rows.sparkSession
        # Numbers of rows, not ids, decide the shard, so that no id or vector is in one of them only.
        self.rows = _frames.stored(rows.withColumn("number", F.monotonically_increasing_id()), "vectors")
        n = self.rows.count()
        least, most = -(-n // SHARD_ROWS), -(-n // LEAST_ROWS)
        self.shards = max(1, least, min(most, 2 * spark.sparkContext.defaultParallelism))
        key = F.xxhash64("label", "v").alias("anchor_key")
        self.anchors = _frames.cut(self.rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), key, "label", "v").distinct())

    def run(self, step: Callable, names: list[str], windows: DataFrame | None = None) -> DataFrame:
        """`windows`: (anchor_id, anchor_key, windows) of the anchors that take part (none: all)."""
        null = F.lit(None)
        asked = self.anchors.withColumn("windows", F.array().cast(WINDOWS)) if windows is None else self.anchors.join(windows, KEYS)
        dealt = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("kind"), F.col("anchor_id").alias("vec_id"), "label", "v", "anchor_key", "windows")
        own = self.rows.select(F.pmod(F.xxhash64("number"), F.lit(self.shards)).cast("long").alias("shard"), F.lit(0).alias("kind"), "vec_id", F.col("label").cast("long").alias("label"), "v", null.cast("long").alias("anchor_key"), null.cast(WINDOWS).alias("windows"))
        both = own.unionByName(dealt).repartition("shard").sortWithinPartitions("shard", "kind")
        return both.mapInArrow(_pass(step, names), ", ".join(f"{c} long" for c in [*KEYS, *names]))


def _opened(positives: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """The windows of positives: scores from `lo` to `hi`, and `shift`, the bits below the first digit."""

    def part(percent: int, up: bool):
        exact = F.col("score").cast("decimal(20,0)") * F.lit(percent) / F.lit(100)
        return (F.ceil(exact) if up else F.floor(exact)).cast("long")

    spans = positives.select(*KEYS, "place", part(low, True).alias("lo"), part(high, False).alias("hi")).filter("lo <= hi")
    shift = F.greatest(F.lit(0), F.length(F.bin(F.col("hi") - F.col("lo"))) - DIGIT)
    return spans.withColumns({"base": F.lit(0).cast("long"), "shift": shift, "need": F.lit(k)})


def _listed(windows: DataFrame) -> DataFrame:
    return windows.groupBy(*KEYS).agg(F.collect_list(F.struct("place", "lo", "hi", "base", "shift", "need")).alias("windows"))


def thresholds(miner: Miner, windows: DataFrame, k: int) -> DataFrame:
    """`windows` with `lo` raised to a score that at least k rows of the window reach, and few more."""
    done = None
    while True:
        counts = miner.run(_digits, ["place", "digit", "n"], _listed(windows)).groupBy(*KEYS, "place", "digit").agg(F.sum("n").alias("n"))
        up_to = F.sum("n").over(Window.partitionBy(*KEYS, "place").orderBy("digit"))
        # Digits of a window: 2^DIGIT at most.
        kth = counts.withColumn("up_to", up_to).join(windows.select(*KEYS, "place", "need"), [*KEYS, "place"]).filter("up_to >= need").groupBy(*KEYS, "place").agg(F.min(F.struct("digit", "up_to", "n")).alias("kth"))
        found = windows.join(kth, [*KEYS, "place"], "left")
        base = F.col("base") + F.expr("shiftleft(kth.digit, shift)")
        known = (F.col("shift") == 0) | (F.lit(k) - F.col("need") + F.col("kth.up_to") <= SPARE * k)
        found = _frames.stored(
            found.withColumn("ended", F.col("kth").isNull() | known)
            .withColumn("lo", F.when(F.col("ended") & F.col("kth").isNotNull(), F.greatest("lo", F.col("hi") - base - F.expr("shiftleft(1L, shift)") + 1)).otherwise(F.col("lo")))
            .withColumn("need", F.when(F.col("ended"), F.col("need")).otherwise((F.col("need") - F.col("kth.up_to") + F.col("kth.n")).cast("int")))
            .withColumn("base", F.when(F.col("ended"), F.col("base")).otherwise(base))
            .withColumn("shift", F.when(F.col("ended"), F.col("shift")).otherwise(F.greatest(F.lit(0), F.col("shift") - DIGIT)))
            .drop("kth"),
            "windows",
        )
        ended = found.filter("ended").drop("ended")
        done = ended if done is None else done.unionByName(ended)
        windows = found.filter("not ended").drop("ended")
        if not windows.limit(1).count():
            return done


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `rows`: (vec_id, label, v), whole components.  Anchors are the rows whose vec_id is divisible
    by `every`; a negative's score is `low` to `high` percent of the positive's.
    """
    miner = Miner(rows, every)
    order = Window.partitionBy(*KEYS).orderBy(F.col("score").desc(), "vec_id")
    found = miner.run(_positives(positives), ["vec_id", "score"]).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    found = _frames.stored(found, "positives")
    windows = thresholds(miner, _opened(found, negatives, low, high), negatives)
    hits = miner.run(_reached(negatives), ["place", "negative_id", "negative_score"], _listed(windows))
    best = Window.partitionBy(*KEYS, "place").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    named = found.select(*KEYS, F.col("place").cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(named, [*KEYS, "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("label is not null"), "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", shifted.cast("long")))


OP11_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i]))::bigint as score
  from v a join v c on a.vec_id % 100 = 0 and c.vec_id <> a.vec_id and len(c.v) = len(a.v)),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (
  select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id)::integer as rank
  from p join s on s.anchor_id = p.anchor_id and not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5
"""
