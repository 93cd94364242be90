"""Exact top-k search: ball-tree branch and bound per shard, with a shared k-th score.

Method: a bounded number of vectors, those with the least hashes, are pivots; every vector is
indexed in the cell of its nearest one.  A cell's ball (pivot and largest distance) is one row
of a small table that all tasks have.  A cell of many vectors is split into shards of bounded
size, and a task builds a ball tree over each of its shards and streams queries past it.  A
query visits nodes in the order of their inner-product upper bound q.c + |q| r and stops at
the first that cannot reach its k-th score.  Queries go to cells in waves of falling bound: to
the best one, to the next few, to all others; before each wave the k-th score found so far is
shared, and a query is sent only to cells whose bound reaches it.  Shards hold a bounded number
of vectors and queries are only streamed, so memory does not follow their number.

Components are floor(256 * x); scores are integer inner products, exact: in floating point
where no sum can pass 2^53, else in whole numbers.  Ties go to the smaller vec_id.

Defined cases: vectors that are null or hold null or non-finite components, and rows without
vec_id, take no part; vectors are compared only with those of their own length; rows that
repeat a vec_id are candidates each, but never of that id's own query, and those that repeat
a vector as well lie in one shard; repeated equal query rows count once; fewer than k candidates give fewer rows; an empty table gives an empty
result; a score beyond the range of long is an error; other columns are left alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm import _frames

K = 5
LEAF = 32
#: Vectors of a cell on average, while there are at most MOST_PIVOTS pivots (shipped to all tasks).
SHARD_ROWS = 512
MOST_PIVOTS = 1024
#: Vectors of a shard on average: larger cells are split.
SPLIT_ROWS = 1 << 15
#: The places of a query's cells, by falling bound, at which waves begin.
WAVES = (0, 1, 8)
HITS = "query_id long, query_key long, vec_id long, score long"


class BallTree:
    """Nodes as arrays; node i covers the vectors lo[i]..hi[i] of the tree's own order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((ids,))
        self.ids, self.vectors = ids[order], vectors[order].astype(np.float64)
        self.whole = vectors[order]
        self.lo, self.hi, self.child, centers = [], [], [], []
        self.radius, self.least = [], []
        at = np.arange(len(ids))
        stack = [(0, len(ids), -1)]
        while stack:
            lo, hi, parent = stack.pop()
            rows = at[lo:hi]
            points = self.vectors[rows]
            center = points.mean(axis=0)
            node = len(self.lo)
            self.lo.append(lo)
            self.hi.append(hi)
            self.child.append([])
            centers.append(center)
            self.radius.append(float(np.sqrt(((points - center) ** 2).sum(axis=1).max())))
            self.least.append(int(self.ids[rows].min()))
            if parent >= 0:
                self.child[parent].append(node)
            if hi - lo > leaf and self.radius[-1] > 0:
                axis = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
                half = (hi - lo) // 2
                at[lo:hi] = rows[np.argpartition(points[:, axis], half, kind="introselect")]
                stack += [(lo, lo + half, node), (lo + half, hi, node)]
        self.ids, self.vectors, self.whole = self.ids[at], self.vectors[at], self.whole[at]
        self.centers = np.array(centers)
        self.radii = np.array(self.radius)
        self.largest = float(np.abs(self.vectors).max(initial=0.0))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node a number that no inner product within the node passes."""
        norm = np.sqrt((queries**2).sum(axis=1))
        reach = queries @ self.centers.T + norm[:, None] * self.radii[None, :]
        slack = 1e-9 * (norm[:, None] * (np.sqrt((self.centers**2).sum(axis=1)) + self.radii)[None, :]) + 1e-6
        return np.floor(reach + slack)

    def search(self, query_id: int, query: np.ndarray, bound: np.ndarray, k: int, floor: tuple[int, int] | None) -> list[tuple[int, int]]:
        """The best (score, id) pairs that beat `floor`, at most k; floor: a (score, id) that k others reach."""
        exact = len(query) * self.largest * float(np.abs(query).max(initial=0)) < 2.0**53
        values = query.astype(np.float64) if exact else query.astype(object)
        best: list[tuple[int, int]] = []  # a heap of (score, -id); its first is the k-th
        nodes = [(-bound[0], 0)]
        while nodes:
            most, node = heapq.heappop(nodes)
            least = best[0] if len(best) == k else None
            if floor is not None and (least is None or (floor[0], -floor[1]) > least):
                least = (floor[0], -floor[1])
            if least is not None:
                if -most < least[0]:
                    break
                if -most == least[0] and self.least[node] > -least[1]:
                    continue
            if self.child[node]:
                for c in self.child[node]:
                    heapq.heappush(nodes, (-bound[c], c))
                continue
            part = slice(self.lo[node], self.hi[node])
            scores = self.vectors[part] @ values if exact else self.whole[part].astype(object) @ values
            found = np.arange(len(scores)) if least is None else np.flatnonzero(scores >= least[0])
            ids = self.ids[part]
            found = found[ids[found] != query_id]
            # Of many equal vectors only the smallest ids can stay.
            if len(found) > 4 * k:
                found = found[np.lexsort((ids[found], -scores[found]))[:k]]
            for i in found:
                pair = (int(scores[i]), -int(ids[i]))
                if floor is not None and pair <= (floor[0], -floor[1]):
                    continue
                if len(best) < k:
                    heapq.heappush(best, pair)
                elif pair > best[0]:
                    heapq.heapreplace(best, pair)
        return [(score, -negative) for score, negative in best]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, vectors, tree = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("shard").to_numpy()
            kind = batch.column("kind").to_numpy()
            own = batch.column("vec_id").to_numpy()
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(kind) != 0)) + 1
            hits: list[tuple] = []
            for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if key[lo] != shard:
                    shard, ids, vectors, tree = key[lo], [], [], None
                part = batch.slice(lo, hi - lo)
                rows = part.column("v").flatten().to_numpy().reshape(hi - lo, -1)
                if kind[lo] == 0:
                    ids.append(own[lo:hi])
                    vectors.append(rows)
                    continue
                if not ids:
                    continue  # no vector of this shard
                if tree is None:
                    tree = BallTree(np.concatenate(ids), np.concatenate(vectors))
                bounds = tree.bounds(rows.astype(np.float64))
                floors = zip(part.column("floor_score").to_pylist(), part.column("floor_id").to_pylist(), strict=True)
                for query_id, query_key, query, bound, (score, vec_id) in zip(own[lo:hi], part.column("query_key").to_pylist(), rows, bounds, floors, strict=True):
                    floor = None if score is None else (score, vec_id)
                    hits += [(int(query_id), query_key, v, s) for s, v in tree.search(int(query_id), query, bound, k, floor)]
            cols = list(zip(*hits, strict=True)) if hits else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "query_key", "vec_id", "score"])

    return run


class Cells:
    """Pivots by the length of vectors, and what is known of each one's cell."""

    def __init__(self, pivots: list[list[int]]):
        by_length: dict[int, set] = {}
        for p in pivots:
            by_length.setdefault(len(p), set()).add(tuple(p))
        self.pivots = {n: np.array(sorted(own), np.float64) for n, own in by_length.items()}
        self.radius: dict[int, float] = {}
        self.split: dict[int, int] = {}

    def centers(self, length: int) -> np.ndarray:
        return self.pivots.get(length, np.zeros((1, length)))

    @staticmethod
    def cell(length: int, place: np.ndarray) -> np.ndarray:
        return length * (MOST_PIVOTS + 1) + place

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the cell of its nearest pivot, and the distance."""
        centers = self.centers(rows.shape[1])
        place = np.argmin((centers**2).sum(axis=1) - 2 * (rows @ centers.T), axis=1)
        return self.cell(rows.shape[1], place), np.sqrt(((rows - centers[place]) ** 2).sum(axis=1))

    def bounds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells of this length that hold vectors, and a number that no inner product there passes."""
        centers = self.centers(rows.shape[1])
        cells = self.cell(rows.shape[1], np.arange(len(centers)))
        filled = np.array([int(c) in self.radius for c in cells])
        cells, centers = cells[filled], centers[filled]
        radius = np.array([self.radius[int(c)] for c in cells])
        norm = np.sqrt((rows**2).sum(axis=1))[:, None]
        slack = 1e-9 * norm * (np.sqrt((centers**2).sum(axis=1)) + radius)[None, :] + 1e-6
        return cells, np.floor(rows @ centers.T + norm * radius[None, :] + slack)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of a batch with vectors of one length each, and these vectors."""
    length = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(length):
        part = batch.take(pa.array(np.flatnonzero(length == n)))
        yield part, part.column("v").flatten().to_numpy().reshape(-1, n).astype(np.float64)


def _assign(cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in _by_length(batch):
                cell, distance = cells.nearest(rows)
                yield part.append_column("cell", pa.array(cell, pa.int64())).append_column("distance", pa.array(distance))

    return run


def _copies(cells: Cells, lo: int, hi: int | None):
    """Queries for the cells from place `lo` to `hi` by falling bound, where it reaches the k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in _by_length(batch):
                own, bounds = cells.bounds(rows)
                floor = part.column("floor_score").cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                order = np.argsort(-bounds, axis=1, kind="stable")[:, lo:hi]
                reached = np.take_along_axis(bounds, order, 1) >= floor[:, None] - 1e-6 * np.abs(np.where(np.isfinite(floor), floor, 0))[:, None]
                query, place = np.nonzero(reached)
                cell = own[order[query, place]]
                n = np.array([cells.split[int(c)] for c in cell], np.int64)
                salt = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                shard = np.repeat(cell, n) * SALTS + salt
                yield part.take(pa.array(np.repeat(query, n))).append_column("shard", pa.array(shard, pa.int64()))

    return run


SALTS = 1 << 20
QUERY = "vec_id long, v array<long>, query_key long, floor_score long, floor_id long"


def _round(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Vectors first, then queries of each shard, in one task; answers stream out."""
    null = F.lit(None).cast("long")
    left = vectors.select("shard", F.lit(0).alias("kind"), "vec_id", "v", null.alias("query_key"), null.alias("floor_score"), null.alias("floor_id"))
    right = queries.select("shard", F.lit(1).alias("kind"), "vec_id", "v", "query_key", "floor_score", "floor_id")
    return left.unionByName(right).repartition("shard").sortWithinPartitions("shard", "kind", "vec_id").mapInArrow(_search(k), HITS)


def _best(hits: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def quantized(embeddings: DataFrame, *more: str) -> DataFrame:
    """(vec_id, v) and further columns: whole components of the vectors that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select("vec_id", "embedding", *more).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(fine)
    return rows.select("vec_id", *more, F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("v"))


def indexed(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, Cells]:
    """(vec_id, v, shard) of every vector, and the cells."""
    # A bounded sample, MOST_PIVOTS vectors at most, places the pivots; every vector is indexed.
    most = max(1, min(MOST_PIVOTS, -(-rows.count() // shard_rows)))
    cells = Cells([r["v"] for r in rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(most).select("v").collect()])
    placed = _frames.cut(rows.mapInArrow(_assign(cells), "vec_id long, v array<long>, cell long, distance double"))
    # One row a cell: as many as there are pivots, and one for each further length of vectors.
    for r in placed.groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("n")).collect():
        cells.radius[r["cell"]] = r["radius"]
        cells.split[r["cell"]] = min(SALTS, -(-r["n"] // SPLIT_ROWS))
    large = {c: n for c, n in cells.split.items() if n > 1}
    salt = F.lit(0).cast("long")
    if large:
        split = F.create_map(*(F.lit(x).cast("long") for pair in large.items() for x in pair))
        salt = F.pmod(F.xxhash64("vec_id", "v"), F.coalesce(F.try_element_at(split, F.col("cell")), F.lit(1)))
    return placed.select("vec_id", "v", (F.col("cell") * SALTS + salt).alias("shard")), cells


def top_k(embeddings: DataFrame, every: int = 50, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each query row."""
    rows = _frames.cut(quantized(embeddings))
    vectors, cells = indexed(rows, shard_rows)
    queries = _frames.cut(rows.filter(F.col("vec_id") % every == 0).distinct().withColumn("query_key", F.xxhash64("vec_id", "v")))
    hits = None
    for lo, hi in zip(WAVES, (*WAVES[1:], None), strict=True):
        null = F.lit(None).cast("long")
        known = queries.withColumns({"floor_score": null, "floor_id": null})
        if hits is not None:
            floors = hits.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "query_key", F.col("score").alias("floor_score"), F.col("vec_id").alias("floor_id"))
            known = queries.join(floors, ["vec_id", "query_key"], "left")
        sent = known.select("vec_id", "v", "query_key", "floor_score", "floor_id").mapInArrow(_copies(cells, lo, hi), f"{QUERY}, shard long")
        found = _round(vectors, sent, k)
        hits = _frames.cut(_best(found if hits is None else found.unionByName(hits.drop("rank")), k))
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v)),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""
