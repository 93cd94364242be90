"""N-gram Jaccard join: adaptive multi-match prefixes over five-word shingles.

A document is the set of its distinct shingles.  Two link when their Jaccard similarity is
at least SIMILAR percent.  The result is connectivity: equal sets are one node from the
start, and links between different sets are all found, directly or by way of others.

Method.  Shingles have a global order: light ones by hash, then the heavy ones by hash; heavy
are those (a bounded number) that the most documents share.  Sets that link share one of the
first n - need + 1 shingles in that order, and one more for each place by which both prefixes
are longer.  Each document's prefix is lengthened by its estimated candidate cost, the counts
of its prefix's shingles, and a pair is verified only if it shares correspondingly many.

A shingle's group of documents is paired directly while it is small.  A large group, such as
that of a widely copied passage or of a family of near copies, is never paired: its members
are first compared with the group's most typical one.  The largest component that this makes
stands for the group from then on, and only members outside it (minor ones) are compared
further.  Minor members that share groups are gathered into blocks of bounded size; a block
holds their shingles as one inverted index, the group's members stream past it, a bounded
number of them (leads) a round and dealt among several copies of the block, and only links that
join what was apart come out.  Rounds go on with more leads until all have been leads; members
that the group's component has taken in leave the blocks.  Documents
without a common light shingle share heavy ones only, so rows that hold too few of those
leave such a group.  So no link between different texts is lost, and no cap decides one.

Words are lower-cased in A-Z; fewer than five words form one shingle.  Shingles are compared
by 64-bit hashes.

Defined cases: a null or wordless text has the empty set and links with nothing; a very long
text is one set of all its shingles; null ids count as documents whose id never is the
smallest; rows that repeat an id link if their texts do; equal sets are one class, named by
the smallest id; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _flat, _frames

WORDS = 5
SIMILAR = 80
#: Documents that may share a shingle before it is heavy, and before its group is large.
GROUP = 64
#: Heavy shingles that are shipped to tasks at most (8 MB); any further one is only slower.
MOST_HEAVY = 1 << 20
#: Places by which a prefix is lengthened at most.
MOST_LONGER = 15
#: Texts that one comparison block takes on average.
BLOCK = 64
#: Shingles that the inverted index of a block of minor members takes on average.
BLOCK_SHINGLES = 1 << 18
#: Members of a large group that stream past its blocks in the first round, and growth by round.
LEADS, MORE_LEADS = 2048, 32
#: Leads of a block that one task compares on average, and parts that a block's leads are dealt into at most.
SLICE, MOST_SLICES = 256, 32


def shingles(data: np.ndarray, off: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    data = _flat.LOWER[data]
    starts, ends, bounds = _flat.words(data, off)
    hashes = _flat.Hasher(data)(starts, ends)
    windows, _, window_bounds = _flat.grams(hashes, bounds, n)
    out = []
    for k in range(len(off) - 1):
        own = windows[window_bounds[k] : window_bounds[k + 1]]
        if not len(own) and bounds[k + 1] > bounds[k]:
            few = hashes[bounds[k] : bounds[k + 1]]
            own = _flat.mix((few * _flat._ODD[: len(few)]).sum(keepdims=True) + np.uint64(len(few)))
        out.append(np.unique(own))
    return out


def key_of(own: np.ndarray) -> int:
    """A 64-bit name of a set, not negative; -1 for the empty set."""
    if not len(own):
        return -1
    total = _flat.mix(own ^ _flat._ODD[50]).sum(dtype=np.uint64, keepdims=True) + np.array([len(own)], np.uint64) * _flat._ODD[51]
    return int(_flat.mix(total)[0] >> np.uint64(1))


def need(n: int | np.ndarray, m: int | np.ndarray | None = None) -> int | np.ndarray:
    """The least overlap of linked sets of n and m (at worst: any) shingles."""
    if m is None:
        return -(-SIMILAR * n // 100)
    return -(-SIMILAR * (n + m) // (100 + SIMILAR))


def _sets(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for step in _flat.steps(batches):
        yield step, shingles(*_flat.flat(step.column("text")))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for step, sets in _sets(batches):
        yield pa.RecordBatch.from_arrays([step.column("doc_id").cast(pa.int64()), pa.array([key_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "key", "n"])


def _longs(values: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([*values, np.zeros(0, np.uint64)]).view(np.int64))


def _counted(heavy: np.ndarray | None) -> Callable:
    """Shingles whose counts decide what is heavy: without `heavy` those of the plain prefixes,
    with it those of prefixes that grow as their heavy ones move to the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sets(batches):
            out = []
            for own in sets:
                if not len(own) or (key := key_of(own)) in seen:
                    continue
                seen.add(key)
                prefix = len(own) - need(len(own)) + 1
                if heavy is None:
                    out.append(own[:prefix])
                    continue
                light = ~_within(own, heavy)
                if not light[:prefix].all():
                    # Half as far again as it takes to fill the prefix with light ones: some of those
                    # are heavy too.  What the plain prefix holds has been counted.
                    reach = int(np.searchsorted(np.cumsum(light), prefix)) + 1
                    out.append(own[prefix : reach + reach // 2])
            yield pa.RecordBatch.from_arrays([_longs(out)], ["token"])

    return run


def _within(values: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    if not len(heavy):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(heavy, values), len(heavy) - 1)
    return heavy[at] == values


INDEX = "token long, salt long, key long, n int, len int, light int"


def _index(heavy: np.ndarray, warm: np.ndarray, counts: np.ndarray) -> Callable:
    """The prefix of each set in the global order, lengthened by its estimated candidate cost.

    `warm` are shingles whose counts are known though they are not heavy.  Rows of heavy
    shingles are never paired, so they are dealt by their set as well (`salt`; light ones: 0).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sets(batches):
            tokens, about, hot = [], [], []
            for own in sets:
                if not len(own) or (key := key_of(own)) in seen:
                    continue
                seen.add(key)
                n = len(own)
                is_heavy = _within(own, heavy)
                light = n - int(is_heavy.sum())
                ordered = np.concatenate([own[~is_heavy], own[is_heavy]])
                prefix = n - need(n) + 1
                cost = 0
                if len(warm):
                    head = ordered[:prefix]
                    at = np.minimum(np.searchsorted(warm, head), len(warm) - 1)
                    cost = int(counts[at][warm[at] == head].sum())
                # One place more for each doubling of the candidates that the prefix would draw.
                longer = min(MOST_LONGER, int(np.log2(1 + cost)))
                # A longer prefix must not reach into the heavy ones, where groups are large.
                length = min(n, max(prefix, min(prefix + longer, light)))
                tokens.append(ordered[:length])
                hot.append(np.where(np.arange(length) >= light, key | 1, 0))
                about.append((key, n, length, light))
            lengths = [a[2] for a in about]
            cols = [np.repeat(np.array([a[k] for a in about], np.int64), lengths) for k in range(4)]
            salt = np.concatenate([*hot, np.zeros(0, np.int64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([_longs(tokens), pa.array(salt), pa.array(cols[0]), *(pa.array(c.astype(np.int32)) for c in cols[1:])], ["token", "salt", "key", "n", "len", "light"])

    return run


GROUPS = "token long, heavy boolean, a long, a_n int, a_len int, a_light int, b long, b_n int, b_len int, b_light int"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by token, salt and key: pairs of small groups of light shingles, and
    the rows of large ones and of heavy shingles (b: null)."""
    held: list[tuple] = []
    large, token, last = False, None, None
    pairs: list[tuple] = []
    rows: list[tuple] = []
    ints = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    names = [x.split()[0] for x in GROUPS.split(", ")]

    def flush() -> None:
        if large or len(held) < 2:
            return
        by_size = sorted(held, key=lambda r: r[1])
        for j, y in enumerate(by_size):
            for x in reversed(by_size[:j]):
                if 100 * x[1] < SIMILAR * y[1]:
                    break
                lo, hi = (x, y) if x[0] < y[0] else (y, x)
                pairs.append((token, False, *lo, *hi))

    def out() -> pa.RecordBatch:
        every = [*pairs, *((t, False, *r, None, None, None, None) for t, *r in rows)]
        pairs.clear()
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*every, strict=True) if every else [[]] * 10, ints, strict=True)], names)

    for batch in batches:
        cols = [batch.column(k).to_numpy() for k in ("token", "salt", "key", "n", "len", "light")]
        if not len(cols[0]):
            continue
        hot = np.flatnonzero(cols[1])
        if len(hot):
            # The same set from several tasks follows itself.
            twice = np.concatenate([[(cols[0][hot[0]], cols[2][hot[0]]) == last], (np.diff(cols[0][hot]) == 0) & (np.diff(cols[2][hot]) == 0)])
            last = (cols[0][hot[-1]], cols[2][hot[-1]])
            hot = hot[~twice]
            own = [pa.array(cols[k][hot], t) for k, t in zip((0, 2, 3, 4, 5), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([own[0], pa.array(np.ones(len(hot), bool)), *own[1:], *(pa.nulls(len(hot), t) for t in ints[6:])], names)
        light = np.flatnonzero(cols[1] == 0)
        cols = [c[light] for k, c in enumerate(cols) if k != 1]
        if not len(light):
            continue
        # Rows that share their token with no neighbour in this batch are skipped at once, but for the ends.
        same = np.concatenate([[True], cols[0][1:] == cols[0][:-1], [True]])
        for i in np.flatnonzero(same[:-1] | same[1:]):
            row = tuple(int(c[i]) for c in cols)
            if row[0] != token:
                flush()
                held, large, token = [], False, row[0]
            if held and held[-1][0] == row[1]:
                continue  # the same set, from another task
            if large:
                rows.append(row)
                held = [row[1:]]
                continue
            held.append(row[1:])
            if len(held) > GROUP:
                rows += [(token, *r) for r in held]
                held, large = held[-1:], True
        if len(pairs) + len(rows) > 20_000:
            yield out()
    flush()
    yield out()


def _with_texts(docs: DataFrame, nodes: DataFrame, places: DataFrame) -> DataFrame:
    """`places` (with `key`) and the texts of the documents that stand for these sets."""
    places = _frames.cut(places.join(nodes.select("key", F.col("doc_id").alias("_doc")), "key"))
    # A document stands for its set; which of several rows with its id does not matter, so all come.
    return _frames.join_small(docs.select("doc_id", "text"), places, docs["doc_id"].eqNullSafe(places["_doc"]), most=200_000).drop("doc_id", "_doc")


def _verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs that link.  Texts travel to blocks: the block's own first, then its partners."""
    counts = _frames.cut(pairs.groupBy("a").agg(F.count("*").alias("_n")))
    salted = pairs.join(counts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("_n") / BLOCK)))
    salted = _frames.cut(salted.select("a", "b", "salt"))
    asked = salted.select("a", "salt", F.col("b").alias("key"), F.lit(1).alias("part")).unionByName(salted.select("a", "salt", F.col("a").alias("key"), F.lit(0).alias("part")).distinct())
    rows = _with_texts(docs, nodes, asked)
    sorted_rows = rows.select("a", "salt", "part", "key", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", "part", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own = None, None
        for step, sets in _sets(batches):
            found = []
            for a, salt, part, key, s in zip(*(step.column(k).to_pylist() for k in ("a", "salt", "part", "key")), sets, strict=True):
                if key_of(s) != key:
                    continue  # another row with that document's id
                if part == 0:
                    block, own = (a, salt), s
                elif block == (a, salt):
                    common = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * common >= SIMILAR * (len(own) + len(s) - common):
                        found.append((a, key))
            cols = list(zip(*found, strict=True)) if found else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    return _frames.cut(sorted_rows.mapInArrow(run, "a long, b long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(key, comp): the smallest key that links reach, for all keys on an edge.

    Labels fall to the least of the neighbours' and then to the label's own label, so that
    long chains shrink by halves, until their sum falls no more; they are cut each round, and
    nothing is collected.
    """
    both = _frames.stored(edges.select(F.col("a").alias("key"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("key"), F.col("a").alias("to"))).distinct(), "links")
    labels = _frames.cut(both.groupBy("key").agg(F.min(F.least("to", "key")).alias("comp")))
    total = F.sum(F.col("comp").cast("decimal(38,0)"))
    before = None
    while (now := labels.agg(total).first()[0]) != before:
        before = now
        near = both.join(labels.withColumnRenamed("key", "to"), "to").select("key", "comp")
        # A table read anew has a size; a checkpoint keeps the estimate of its plan, and estimates
        # of joins multiply from round to round until the planner does little else.
        lower = _frames.cut(labels.unionByName(near).groupBy("key").agg(F.min("comp").alias("comp")))
        own = lower.select(F.col("key").alias("comp"), F.col("comp").alias("next"))
        labels = _frames.stored(lower.join(own, "comp").groupBy("key").agg(F.min("next").alias("comp")), "labels")
    return labels


def _sure(pairs: DataFrame) -> DataFrame:
    """Pairs that share as many prefix shingles as their lengthened prefixes ask for."""
    shared = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), *(F.first(c).alias(c) for c in ("a_n", "a_len", "a_light", "b_n", "b_len", "b_light")))
    least = F.ceil(F.lit(SIMILAR) * (F.col("a_n") + F.col("b_n")) / (100 + SIMILAR))
    places = F.least(F.col("a_len") - F.col("a_n"), F.col("b_len") - F.col("b_n")) + least
    # Shared heavy shingles are not counted here: their groups are large.
    lights = F.least(F.least("a_len", "a_light") - F.col("a_n"), F.least("b_len", "b_light") - F.col("b_n")) + least
    return shared.filter((F.col("shared") >= F.least(places, lights)) | (F.least(places, lights) <= 1))


def _star(large: DataFrame) -> DataFrame:
    """Each member of a large group with the group's most typical one: that with the least share of light shingles."""
    typical = _frames.cut(large.groupBy("token").agg(F.min(F.struct((F.col("a_light") / F.col("a_n")).alias("share"), F.col("a").alias("key"), F.col("a_n").alias("n"))).alias("lead")))
    pairs = large.join(typical, "token").filter("a <> lead.key").filter(F.lit(100) * F.least("a_n", "lead.n") >= F.lit(SIMILAR) * F.greatest("a_n", "lead.n"))
    return pairs.select(F.least("a", "lead.key").alias("a"), F.greatest("a", "lead.key").alias("b")).distinct()


class Block:
    """An inverted index over the sets of minor members, and what is known to be joined."""

    def __init__(self, keys: list[int], comps: list[int], sets: list[np.ndarray]):
        self.keys, self.comps = keys, comps
        self.size = np.array([len(s) for s in sets])
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(tokens, kind="stable")
        self.owner = owner[order]
        self.tokens, self.at = np.unique(tokens[order], return_index=True)
        self.at = np.append(self.at, len(order))
        self.above: dict[int, int] = {}

    def _root(self, comp: int) -> int:
        while (up := self.above.get(comp, comp)) != comp:
            self.above[comp] = self.above.get(up, up)
            comp = up
        return comp

    def links(self, key: int, comp: int, own: np.ndarray) -> list[int]:
        """Members of the block that link with a set and were not joined with it before."""
        i = np.minimum(np.searchsorted(self.tokens, own), len(self.tokens) - 1)
        i = i[self.tokens[i] == own]
        lo, n = self.at[i], self.at[i + 1] - self.at[i]
        each = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(i) else np.zeros(0, np.int64)
        common = np.bincount(self.owner[each], minlength=len(self.keys))
        out = []
        for j in np.flatnonzero(100 * common >= SIMILAR * (self.size + len(own) - common)):
            a, b = self._root(comp), self._root(self.comps[j])
            if a != b:
                self.above[max(a, b)] = min(a, b)
                out.append(self.keys[j])
        return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams blocks, minor members first: links that join different components."""
    place, held, block = None, [], None
    for step, sets in _sets(batches):
        found = []
        for home, salt, cut, part, key, comp, own in zip(*(step.column(k).to_pylist() for k in ("home", "salt", "slice", "part", "key", "comp")), sets, strict=True):
            if key_of(own) != key:
                continue  # another row with that document's id
            if (home, salt, cut) != place:
                place, held, block = (home, salt, cut), [], None
            if part == 0:
                held.append((key, comp, own))
                continue
            if block is None:
                block = Block(*map(list, zip(*held, strict=True)))
            found += [(key, other) for other in block.links(key, comp, own)]
        cols = list(zip(*found, strict=True)) if found else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])


def _majors(large: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of large groups with several components, and `major`: a key of the component that
    is the group's largest now and stands for it in all rounds, however components grow."""
    rows = large.join(labels, F.col("a") == F.col("key"), "left").select("token", "a", "a_n", F.coalesce("comp", "a").alias("comp"))
    sizes = rows.groupBy("token", "comp").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("token").agg(F.max(F.struct("size", "comp"))["comp"].alias("major"), F.sum("size").alias("size"), F.count("*").alias("comps")).filter("comps > 1").drop("comps")
    return _frames.cut(rows.drop("comp").join(_frames.cut(mixed), "token"))


def _rest(docs: DataFrame, nodes: DataFrame, large: DataFrame, labels: DataFrame, least: int, most: int) -> tuple[DataFrame, bool]:
    """Links between different components of large groups, and whether groups have further leads.

    `large`: rows with their group's `major`.  Leads are members by a hash of their set, some
    `most` of each group; those that the round before took (`least`) are left out.  Minor members
    are those outside the component of `major`.  Components only grow, so of two members that end
    apart at least one is minor in every round, also in that whose lead is the other.
    """
    now = labels.select(F.col("key").alias("_key"), F.col("comp").alias("_comp"))
    rows = large.join(now, F.col("a") == F.col("_key"), "left").withColumn("comp", F.coalesce("_comp", "a")).drop("_key", "_comp")
    rows = rows.join(now, F.col("major") == F.col("_key"), "left").withColumn("most", F.coalesce("_comp", "major")).drop("_key", "_comp", "major")
    rows = _frames.cut(rows)
    # Minor members meet in blocks by the largest of their groups.
    minor = rows.filter("comp <> most").groupBy("a").agg(F.max(F.struct("size", "token"))["token"].alias("home"), F.first("a_n").alias("a_n"), F.first("comp").alias("comp"))
    minor = _frames.cut(minor)
    blocks = minor.groupBy("home").agg(F.ceil(F.sum("a_n") / BLOCK_SHINGLES).alias("blocks"))
    minor = _frames.cut(minor.join(blocks, "home").select("a", "comp", "home", F.pmod(F.xxhash64("a"), F.col("blocks")).alias("salt")))
    asked = rows.filter("comp <> most").select("token", "a").join(minor.select("a", "home", "salt"), "a").select("token", "home", "salt").distinct()
    share = F.pmod(F.xxhash64("a", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("size")
    leads = rows.filter((share >= least) & (share < most)).select("token", "a", "comp")
    targets = _frames.cut(leads.join(asked, "token").select("home", "salt", F.lit(1).alias("part"), F.col("a").alias("key"), "comp").distinct())
    # A block's leads are dealt among several tasks, each with a copy of the block.
    slices = _frames.cut(targets.groupBy("home", "salt").agg(F.least(F.lit(MOST_SLICES), F.ceil(F.count("*") / SLICE)).cast("int").alias("slices")))
    dealt = targets.join(slices, ["home", "salt"]).withColumn("slice", F.pmod(F.xxhash64("key", F.lit(3)), F.col("slices")).cast("int")).drop("slices")
    copied = minor.join(slices, ["home", "salt"]).select("home", "salt", F.lit(0).alias("part"), F.col("a").alias("key"), "comp", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    places = dealt.unionByName(copied)
    sorted_rows = _with_texts(docs, nodes, places).repartition("home", "salt", "slice").sortWithinPartitions("home", "salt", "slice", "part", "key")
    edges = _frames.cut(sorted_rows.mapInArrow(_compare, "a long, b long").distinct())
    return edges, rows.filter(F.col("size") > most).limit(1).count() > 0


def _joined(docs: DataFrame, nodes: DataFrame, large: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and labels with all links within large groups that join components: rounds of leads."""
    labels = components(edges)
    large = _majors(large, labels)
    least, most, further = 0, LEADS, True
    while further:
        more, further = _rest(docs, nodes, large, labels, least, most)
        if more.limit(1).count():
            edges = edges.unionByName(more)
            labels = components(edges)
        least, most = most, most * MORE_LEADS
    return edges, labels


def _heavy(docs: DataFrame, marked: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles counted more than `least` times, the MOST_HEAVY most frequent at most, and their counts."""
    counts = docs.mapInArrow(_counted(marked), "token long").groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") > least)
    top = counts.orderBy(F.col("df").desc(), "token").limit(MOST_HEAVY).toPandas()
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], top["df"].to_numpy(np.int64)[order]


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n) of every row, and (key, comp) of every set that links with another."""
    texts = docs.select("doc_id", "text")
    keyed = _frames.cut(texts.mapInArrow(_keys, "doc_id long, key long, n long"))
    nodes = _frames.cut(keyed.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id")))
    only = texts.select("text")
    seen, counts = _heavy(only, None, GROUP // 8)
    heavy = seen[counts > GROUP]
    if len(heavy):
        more, _ = _heavy(only, heavy, GROUP)
        heavy = np.unique(np.concatenate([heavy, more]))
    warm = ~_within(seen, heavy)
    index = only.mapInArrow(_index(heavy, seen[warm], counts[warm]), INDEX).repartition("token", "salt").sortWithinPartitions("token", "salt", "key")
    groups = _frames.cut(index.mapInArrow(_grouped, GROUPS))
    # Documents that meet first at a heavy shingle share heavy ones only: rows with too few of them go.
    enough = ~F.col("heavy") | (100 * (F.col("a_n") - F.col("a_light")) >= SIMILAR * F.col("a_n"))
    large = groups.filter(F.col("b").isNull() & enough).select("token", "a", "a_n", "a_light")
    pairs = _frames.cut(_sure(groups.filter("b is not null")))
    star = _frames.cut(_star(large).join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
    # First each set with its likeliest partner, and the stars; what these join needs no second look.
    ends = pairs.select("a", "b", "shared", F.explode(F.array("a", "b")).alias("end"))
    likely = ends.groupBy("end").agg(F.max(F.struct("shared", "a", "b")).alias("best")).select("best.a", "best.b").distinct()
    first = _frames.cut(likely.unionByName(star).distinct())
    edges = _verify(docs, nodes, first)
    edges, labels = _joined(docs, nodes, large, edges)
    again = _frames.cut(_across(pairs.select("a", "b"), labels).join(first, ["a", "b"], "left_anti"))
    if again.limit(1).count():
        edges = edges.unionByName(_verify(docs, nodes, again))
        labels = components(edges)
    return keyed, labels


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    left = labels.select(F.col("key").alias("a"), F.col("comp").alias("_a"))
    right = labels.select(F.col("key").alias("b"), F.col("comp").alias("_b"))
    return pairs.join(left, "a", "left").join(right, "b", "left").filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of `docs`."""
    keyed, labels = link(docs)
    least = keyed.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    comp = least.join(labels, "key", "left").select("key", F.coalesce("comp", "key").alias("comp"), "least")
    comp = _frames.cut(comp)
    # Sets that link with no other need no further look: their own smallest id is the answer.
    whole = comp.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = _frames.cut(comp.join(whole, "comp").select("key", "component_id"))
    return keyed.join(named, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of `docs` of which one stays for each class: the one with the smallest doc_id.

    Wordless rows stay.  Rows that repeat an id and a text count as copies; one of them stays.
    """
    keyed, labels = link(docs)
    rows = keyed.filter("n > 0").join(labels, "key", "left").select("doc_id", "key", F.coalesce("comp", "key").alias("comp"))
    best = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("best"))
    stay = best.select("best.doc_id", "best.key").unionByName(keyed.filter("n = 0").select("doc_id", "key"))
    stay = _frames.cut(stay.distinct().select(F.col("doc_id").alias("_stays"), F.col("key").alias("_key")))
    left = docs.join(stay, docs["doc_id"].eqNullSafe(stay["_stays"])).drop("_stays")
    if not keyed.groupBy("doc_id").count().filter(F.col("count") > 1).limit(1).count():
        return left.drop("_key")  # ids name rows: the texts are moved once and not looked at again
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of one id come together: the copies of one that has been passed on are dropped.
        doc, passed = None, set()
        for step, sets in _sets(batches):
            ids, wanted, keep = step.column("doc_id").to_pylist(), step.column("_key").to_pylist(), []
            for d, w, s in zip(ids, wanted, sets, strict=True):
                if d != doc:
                    doc, passed = d, set()
                keep.append(key_of(s) == w and (w < 0 or w not in passed))
                if keep[-1]:
                    passed.add(w)
            yield step.drop_columns(["_key"]).filter(pa.array(keep))

    return left.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, schema)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP8_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select shingle from s group by shingle having count(*) > 1),
c as (select s.doc_id, s.shingle from s join shared using (shingle)),
p as (select x.doc_id as a, y.doc_id as b, count(*) as k from c x join c y on x.shingle = y.shingle and x.doc_id < y.doc_id group by x.doc_id, y.doc_id),
links as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 80 * (na.n + nb.n - k)),
ends as (select a, b from links union all select b, a from links),
reach(a, b) as (select a, b from ends union select r.a, e.b from reach r join ends e on r.b = e.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) as component_id
from documents d left join n using (doc_id) left join (select a, min(b) as least from reach group by a) m on m.a = d.doc_id
"""
