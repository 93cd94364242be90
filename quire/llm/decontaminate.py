"""Benchmark decontamination: which words of a document stand in a window of a benchmark item.

Method: a prefix-filtered set join.  A window (ten consecutive words of an item, or all of a
shorter item) is a set of three-word shingles.  A text that holds the window holds every one of
them, so its overlap must be whole and the necessary prefix is one shingle: the rarest.

* One pass over the documents counts all shingles of the benchmark; windows with a shingle that
  occurs nowhere go, the others are ordered by rarity and keep their rarest shingle.
* A second pass yields the places of these, each with the words around it.
* Places and windows are joined on the shingle; the place within the document bounds where the
  window may begin and how long it may be; then its words are compared one by one.

Shingles of the benchmark reach the passes as a bit table of bounded size (two bits a shingle);
what passes it wrongly meets nothing in the join, so the benchmark may be of any size.  Hits are
united by document as intervals.  Documents are never grouped or paired; only places travel.

Words are runs of [0-9a-z] and characters beyond ASCII, A-Z lower-cased.  Shingles are compared
by 64-bit hashes, windows by their words.

Defined cases: null texts have no words; an item without words has no window; an item without
item_id marks words, but is not counted among the items; rows that repeat an item_id are one
item, rows that repeat a doc_id are rows of their own; very long texts are worked on whole; an
empty table gives an empty result, an empty benchmark clean documents; other columns are left
alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm import _flat, _frames

WINDOW = 10
SHINGLE = 3
#: Bits of the table for each shingle, and of the whole table at most (8 MB).
BITS_EACH, MOST_BITS = 256, 1 << 26
#: Windows that are shipped to all tasks at most; more of them are joined by a shuffle.
MOST_WINDOWS = 100_000

_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[97:123] = _BREAK[128:] = False


def _words(col: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts, ends and hashes of all words, and the bounds of each text's."""
    data, off = _flat.flat(col)
    data = _flat.LOWER[data]
    starts, ends, bounds = _flat.words(data, off, _BREAK)
    return data.tobytes(), starts, ends, _flat.Hasher(data)(starts, ends), bounds


def _shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of this width, and each one's first word."""
    tokens, at, _ = _flat.grams(hashes, bounds, width)
    return _flat.mix(tokens + np.uint64(width)), at


WINDOWS = "item_id long, window string, n int, width int, tokens array<long>"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for step in _flat.steps(batches):
        raw, starts, ends, hashes, bounds = _words(step.column("text"))
        out = []
        for item, lo, hi in zip(step.column("item_id").to_pylist(), bounds, bounds[1:], strict=False):
            n = min(WINDOW, int(hi - lo))
            width = min(SHINGLE, n)
            if not n:
                continue
            tokens, _ = _shingles(hashes[lo:hi], np.array([0, hi - lo]), width)
            own = [raw[s:e].decode() for s, e in zip(starts[lo:hi], ends[lo:hi], strict=True)]
            for k in range(len(own) - n + 1):
                out.append((item, " ".join(own[k : k + n]), n, width, tokens[k : k + n - width + 1].view(np.int64).tolist()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["item_id", "window", "n", "width", "tokens"])


class Sieve:
    """A bit table of shingles: those in it pass, and few others."""

    def __init__(self, tokens: DataFrame):
        count = tokens.count()
        self.bits = min(MOST_BITS, 1 << max(6, (BITS_EACH * count).bit_length())).bit_length() - 1
        at = F.explode(F.array(F.shiftrightunsigned("token", 64 - self.bits), F.col("token").bitwiseAND((1 << self.bits) - 1)))
        words = tokens.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits"))
        # At most MOST_BITS / 64 rows, whatever the size of the benchmark.
        got = words.toPandas()
        self.table = np.zeros(1 << (self.bits - 6), np.uint64)
        self.table[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
        self.widths = sorted(r["width"] for r in tokens.select("width").distinct().collect())  # 1 to SHINGLE

    def _has(self, at: np.ndarray) -> np.ndarray:
        return (self.table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        """Places of the tokens that pass."""
        one = np.flatnonzero(self._has(tokens >> np.uint64(64 - self.bits)))
        return one[self._has(tokens[one] & np.uint64((1 << self.bits) - 1))]


def _counted(sieve: Sieve):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in _flat.steps(batches):
            *_, hashes, bounds = _words(step.column("text"))
            found = [np.zeros(0, np.uint64)]
            for width in sieve.widths:
                tokens, _ = _shingles(hashes, bounds, width)
                found.append(tokens[sieve(tokens)])
            token, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    return run


PLACES = "row long, doc_id long, n_words long, token long, at long, first long, around string"


def _places(sieve: Sieve):
    """A row for each document, and one for each place of a shingle with the words around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in _flat.steps(batches):
            raw, starts, ends, hashes, bounds = _words(step.column("text"))
            rows = step.column("row").to_numpy()
            found = []
            for width in sieve.widths:
                tokens, at = _shingles(hashes, bounds, width)
                passed = sieve(tokens)
                owner = np.searchsorted(bounds, at[passed], "right") - 1
                for token, word, k in zip(tokens[passed].view(np.int64).tolist(), at[passed].tolist(), owner.tolist(), strict=True):
                    lo, hi = max(int(bounds[k]), word - WINDOW + 1), min(int(bounds[k + 1]), word + WINDOW)
                    around = b" ".join(raw[s:e] for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True))
                    found.append((rows[k], token, word - bounds[k], lo - bounds[k], around.decode(), bounds[k + 1] - bounds[k]))
            row, token, at, first, around, n = (list(c) for c in zip(*found, strict=True)) if found else [[]] * 6
            m, none = step.num_rows, [None] * step.num_rows
            cols = [
                pa.array(np.concatenate([rows, np.array(row, np.int64)])),
                pa.concat_arrays([step.column("doc_id").cast(pa.int64()), pa.nulls(len(row), pa.int64())]),
                pa.array(np.concatenate([np.diff(bounds), np.array(n, np.int64)])),
                *(pa.array(none + c, pa.int64()) for c in (token, at, first)),
                pa.array([None] * m + around, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in PLACES.split(", ")])

    return run


def prefixes(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """(token, width, offset, n, window): for each window that may occur its rarest shingle."""
    distinct = windows.select("window", "n", "width", "tokens").dropDuplicates(["window"])
    tokens = _frames.stored(distinct.select("window", "n", "width", F.posexplode("tokens").alias("offset", "token")), "tokens")
    sieve = Sieve(tokens.select("token", "width").distinct())
    counts = docs.select("text").mapInArrow(_counted(sieve), "token long, n long").groupBy("token").agg(F.sum("n").alias("df"))
    known = tokens.join(counts, "token", "left")
    best = known.groupBy("window").agg(F.min(F.struct("df", "token", "offset", "width", "n")).alias("best"), F.count_if(F.col("df").isNull()).alias("absent"))
    return best.filter("absent = 0").select("best.token", "best.width", "best.offset", "best.n", "window")


def hits(places: DataFrame, prefix: DataFrame) -> DataFrame:
    """(row, start, end, window) of the windows found, words from `start` to before `end`."""
    own = places.filter("token is not null")
    on = (own["token"] == prefix["token"]) & (own["at"] >= prefix["offset"]) & (own["at"] - prefix["offset"] + prefix["n"] <= own["n_words"])
    near = _frames.join_small(own, prefix, on, most=MOST_WINDOWS)
    start = F.col("at") - F.col("offset")
    # The bounds and this may be looked at in any order: a place must be valid by itself.
    place = F.greatest(F.lit(1), start - F.col("first") + 1).cast("int")
    words = F.array_join(F.slice(F.split("around", " "), place, F.col("n")), " ")
    return near.filter(words == F.col("window")).select("row", start.alias("start"), (start + F.col("n")).alias("end"), "window").distinct()


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) of every row; `items`: ids in the order of strings."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows = _frames.stored(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_windows, WINDOWS), "windows")
    prefix = _frames.stored(prefixes(windows, texts), "prefixes")
    # Numbers of rows are made here once and read from the table from now on.
    places = _frames.stored(texts.mapInArrow(_places(Sieve(prefix.select("token", "width").distinct())), PLACES), "places")
    found = _frames.stored(hits(places, prefix), "hits")
    before = F.max("end").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    words = found.select("row", "start", "end", before.alias("before")).groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("before", "start")))).alias("n_hit"))
    owners = windows.filter("item_id is not null").select("window", "item_id").distinct()
    named = found.select("row", "window").distinct().join(owners, "window").groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    rows = places.filter("token is null").select("row", "doc_id", "n_words")
    joined = rows.join(words, "row", "left").join(named, "row", "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select("doc_id", "n_words", hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (hit > 0).alias("contaminated"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP13_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
i as (
  select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') as v
  from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as k from (select item_id, w, least(10, len(w)) as n from b where len(w) > 0))),
p as (
  select r, k, n, array_to_string(w[k:k + n - 1], ' ') as v
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as k from d join (select distinct n from i) on len(w) >= n)),
h as (select r, k, p.n, item_id from p join i on p.v = i.v and p.n = i.n),
c as (select r, count(distinct j) as n_hit from (select r, unnest(range(k, k + n)) as j from h) group by r),
t as (select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct r, item_id from h where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (r) left join t using (r)
"""
