"""Suffix-array dedup: bytes that repeat a 50-byte string of an earlier document go.

Method: distributed prefix doubling, thinned to anchors.  Plain doubling sorts one row for
each byte and round; here a position is ranked only if its 20-byte string has the least hash
among those of some 50-byte window (so equal windows choose equal anchors, and every window
has exactly one), which leaves a position in 16.

* First rank: the hash of the anchor's 20 bytes.  Spark sorts (rank, next rank, document,
  place); neighbours in that order settle what they can, and a rank that no other document
  shares is unique and goes.
* Second rank, at a greater offset: the hash of all bytes of the windows that chose the
  anchor.  Of rows equal in both, all but the first document's are removed whole.
* Only first rows whose second ranks differ under one first rank are ranked on, to the
  threshold: their bytes are fetched and the 64-bit hashes of their 50-byte strings compared.

Nothing is paired: a rank's group is streamed in sorted order, and equal rows of one task are
settled before the shuffle.  Ranks that very many rows share, told by a sample, are dealt by their
second rank and in the end string by string; that changes tasks, not results.  Texts travel by
document twice, for the bytes of the open rows and for the removal.

Defined cases: a null text is empty; a null doc_id counts as larger than every other, and ids
from 2^62 on as null ones; rows that repeat a doc_id, null ones too, do not remove bytes of each
other; texts of fewer than 50 bytes stay
whole; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _flat, _frames

SPAN = 50
GRAM = 20
LAST = (1 << 63) - 1
#: Documents without an id are numbered from here on; ids must be smaller.
NO_ID = 1 << 62
#: Rows that share a rank before it is hot, the part of the documents that is sampled for that, hot
#: ranks at most (they are shipped), and tasks that one is dealt over at most.
HOT, SAMPLED, MOST_HOT, SALTS = 4096, 64, 1 << 16, 256

#: A place: 19 bits that tell rows of one doc_id apart, 32 of the anchor's position, 6 of the
#: bytes between the first window's start and the anchor, 6 of the windows less one.
_TAG, _POS, _LEAD = 44, 12, 6
TAG_BITS = 19


def anchors(data: np.ndarray, off: np.ndarray, tag: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For each anchor: its text, rank, next rank, and place; `off` bounds the texts, `tag` are theirs."""
    n, width = len(data) - gram + 1, span - gram + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64))
    if len(data) < span:
        return none
    hasher = _flat.Hasher(data)
    at = np.arange(n)
    rank = hasher(at, at + gram)
    bits = np.uint64(32)  # one width whatever the step's size, so that equal windows choose alike
    least = ((rank >> bits) << bits) | at.astype(np.uint64)
    reach = 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    whole = np.flatnonzero(np.arange(len(least)) + span <= np.repeat(off[1:], np.diff(off))[: len(least)])
    if not len(whole):
        return none
    chosen = (least[whole] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.append(first[1:], len(chosen)) - 1
    anchor, start, stop = chosen[first], whole[first], whole[last]
    owner = np.searchsorted(off, anchor, "right") - 1
    second = _flat.mix(hasher(start, stop + span) + (anchor - start).astype(np.uint64) * _flat._ODD[33])
    place = (tag[owner] << _TAG) | ((anchor - off[owner]) << _POS) | ((anchor - start) << _LEAD) | (stop - start)
    return owner, rank[anchor], second, place


def window_range(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place's tag, its first window's start and its windows less one."""
    start = ((place >> _POS) & 0xFFFFFFFF) - ((place >> _LEAD) & 63)
    return place >> _TAG, start, place & 63


ROWS = "rank long, salt int, second long, doc long, place long, settled boolean"


def _order(doc: np.ndarray) -> np.ndarray:
    """Documents as they count: all without an id alike, behind those with one."""
    return np.minimum(doc, NO_ID)


def _emit(hot: np.ndarray) -> Callable:
    """Rows for the sort.  Equal ranks within a step are settled here: all but the first document's go.

    Rows of `hot` ranks are dealt by their second rank as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in _flat.steps(batches):
            ids, tag = step.column("doc").to_numpy(), step.column("tag").to_numpy()
            owner, rank, second, place = anchors(*_flat.flat(step.column("text")), tag)
            doc = ids[owner]
            order = np.lexsort((place, doc, second, rank))
            rank, second, doc, place = rank[order], second[order], doc[order], place[order]
            settled = np.zeros(len(rank), bool)
            salt = np.where(np.isin(rank.view(np.int64), hot), second & np.uint64(SALTS - 1), 0).astype(np.int32)
            if len(rank):
                fresh = np.concatenate([[True], (rank[1:] != rank[:-1]) | (second[1:] != second[:-1])])
                lowest = np.repeat(doc[fresh], np.diff(np.append(np.flatnonzero(fresh), len(doc))))
                settled = _order(doc) > _order(lowest)
                # Settled rows take no part in the sort; their rank only spreads them.
                rank = np.where(settled, _flat.mix(place.astype(np.uint64) + doc.astype(np.uint64)), rank)
                salt[settled] = 0
            yield pa.RecordBatch.from_arrays([pa.array(rank.view(np.int64)), pa.array(salt), pa.array(second.view(np.int64)), pa.array(doc), pa.array(place), pa.array(settled)], ["rank", "salt", "second", "doc", "place", "settled"])

    return run


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for step in _flat.steps(batches):
        _, rank, _, _ = anchors(*_flat.flat(step.column("text")), step.column("tag").to_numpy())
        token, n = np.unique(rank.view(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n)], ["rank", "n"])


def hot_ranks(texts: DataFrame) -> np.ndarray:
    """Ranks that many rows share, told by a sample: they are dealt otherwise, with the same result."""
    counts = texts.select("text", "tag").sample(1 / SAMPLED, seed=5).mapInArrow(_ranks, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= HOT // SAMPLED).orderBy(F.col("n").desc(), "rank").limit(MOST_HOT)
    return np.sort(np.array([r["rank"] for r in top.select("rank").collect()], np.int64))


def _settle(hot: np.ndarray) -> Callable:
    return lambda batches: _settled_rows(batches, hot)


def _settled_rows(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Streams rows in sorted order.  Out: removed rows (settled), and rows to be ranked on:
    those of each class's lowest document, where a rank has several classes or, being hot, may
    have others elsewhere."""
    empty = np.zeros(0, np.int64)
    before = None  # (rank, second, lowest document) of the last unsettled row
    held, several = [empty] * 3, False  # lowest rows of the last rank while it has one class
    for batch in batches:
        rank, second, doc, place, settled = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("rank", "second", "doc", "place", "settled"))
        done, on = [(doc[settled], place[settled])], [empty] * 3
        r, s, d, p = (x[~settled] for x in (rank, second, doc, place))
        if len(r):
            new_rank = np.concatenate([[before is None or r[0] != before[0]], r[1:] != r[:-1]])
            new_class = new_rank | np.concatenate([[before is None or s[0] != before[1]], s[1:] != s[:-1]])
            starts = np.flatnonzero(new_class)
            head = starts[0] if len(starts) else len(r)
            lowest = np.empty(len(r), np.int64)
            lowest[:head] = before[2] if before else 0
            lowest[head:] = np.repeat(d[starts], np.diff(np.append(starts, len(r))))
            gone = _order(d) > _order(lowest)
            done.append((d[gone], p[gone]))
            own = ~gone
            rows = [np.concatenate([h, x[own]]) for h, x in zip(held, (r, d, p), strict=True)]
            further = np.concatenate([np.zeros(len(held[0]), bool), (new_class & ~new_rank)[own]])
            goes_on = before is not None and r[0] == before[0]
            if len(rows[0]):
                first = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
                many = np.logical_or.reduceat(further, first) | np.isin(rows[0][first], hot)
                many[0] |= several and goes_on and rows[0][0] == before[0]
                # The last rank waits for the next batch unless it has several classes already.
                several = bool(many[-1]) if rows[0][-1] == r[-1] else several and r[-1] == before[0]
                ready = np.repeat(many, np.diff(np.append(first, len(rows[0]))))
                on = [x[ready] for x in rows]
                wait = (rows[0] == r[-1]) & ~ready
                held = [x[wait] for x in rows]
            else:
                several = several and goes_on and r[-1] == before[0]
            before = (r[-1], s[-1], lowest[-1])
        docs, places = (np.concatenate(c) for c in zip(*done, strict=True))
        yield _settled(on, docs, places)


def _settled(rows: list[np.ndarray], docs: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    n, m = len(rows[0]), len(docs)
    rank = np.concatenate([rows[0], np.zeros(m, np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(rank), pa.array(np.concatenate([rows[1], docs])), pa.array(np.concatenate([rows[2], places])), pa.array(np.arange(n + m) >= n)], ["rank", "doc", "place", "settled"])


def _by_document(rows: DataFrame, texts: DataFrame, run: Callable, schema: str, text_first: bool) -> DataFrame:
    """Rows (doc, rank, place) and texts of each document in one stream, texts first or last."""
    null = F.lit(None)
    tag = F.shiftright("place", _TAG).alias("tag")
    left = rows.select("doc", tag, F.lit(text_first).alias("late"), "rank", "place", null.cast("string").alias("text"), null.cast("long").alias("doc_id"))
    right = texts.select("doc", "tag", F.lit(not text_first).alias("late"), null.cast("long").alias("rank"), null.cast("long").alias("place"), "text", "doc_id")
    return left.unionByName(right).repartition("doc", "tag").sortWithinPartitions("doc", "tag", "late", "place").mapInArrow(run, schema)


def _fetch(hot: np.ndarray) -> Callable:
    """For each row to be ranked on, the bytes of its windows.

    A window of a hot rank is a row of its own, dealt by its string, so that no rank's strings are
    all held by one task.
    """
    is_hot = set(hot.tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, raw = None, b""
        for batch in batches:
            out: list[tuple] = []
            for doc, tag, late, rank, place, text in zip(*(batch.column(k).to_pylist() for k in ("doc", "tag", "late", "rank", "place")), batch.column("text"), strict=True):
                if (doc, tag) != at:
                    at, raw = (doc, tag), b""
                if not late:
                    raw = (text.as_py() or "").encode()
                    continue
                _, start, more = window_range(place)
                if len(raw) < start + more + SPAN:
                    continue
                if rank not in is_hot:
                    out.append((rank, doc, place, raw[start : start + more + SPAN]))
                    continue
                data = np.frombuffer(raw, np.uint8)[start : start + more + SPAN]
                first = np.arange(more + 1)
                keys = _flat.Hasher(data)(first, first + SPAN).view(np.int64)
                out += [(int(key), doc, (tag << _TAG) | ((start + k) << _POS), data[k : k + SPAN].tobytes()) for k, key in enumerate(keys)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["rank", "doc", "place", "bytes"])

    return run


def _last_rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by first rank: compares the 50-byte strings under each.

    A string's rows all lie under one rank, so a dictionary of one rank's strings would do;
    here the strings of a batch are sorted, and only the rank that runs on is carried.
    """
    run, seen = None, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        rank = batch.column("rank").to_numpy()
        data, off = _flat.flat(batch.column("bytes"))
        doc, place = batch.column("doc").to_numpy(), batch.column("place").to_numpy()
        tag, start, more = window_range(place)
        count = more + 1
        row = np.repeat(np.arange(len(doc)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = off[row] + step
        hashes = _flat.Hasher(data)(at, at + SPAN)
        docs = doc[row]
        # The lowest document of each string within the batch ...
        order = np.lexsort((docs, hashes))
        h = hashes[order]
        fresh = np.concatenate([[True], h[1:] != h[:-1]])
        lowest = np.empty(len(docs), np.int64)
        lowest[order] = np.repeat(docs[order][fresh], np.diff(np.append(np.flatnonzero(fresh), len(h))))
        # ... and, for the rank that runs on from the batch before, of all its rows so far:
        # rows come sorted by document within a rank, so what was seen is never larger.
        if run is not None and rank[0] == run:
            for i in np.flatnonzero(rank[row] == run):
                lowest[i] = min(int(lowest[i]), seen.get(int(hashes[i]), LAST))
        if rank[-1] != run:
            run, seen = rank[-1], {}
        for i in np.flatnonzero(rank[row] == run):
            seen[int(hashes[i])] = int(lowest[i])
        gone = _order(docs) > _order(lowest)
        one = (tag[row] << _TAG) | ((start[row] + step) << _POS)
        # Neighbouring windows that go are one run again.
        keep = np.flatnonzero(gone)
        if len(keep):
            first = np.concatenate([[True], (row[keep][1:] != row[keep][:-1]) | (step[keep][1:] != step[keep][:-1] + 1)])
            lead = keep[first]
            length = np.diff(np.append(np.flatnonzero(first), len(keep))) - 1
            yield pa.RecordBatch.from_arrays([pa.array(docs[lead]), pa.array(one[lead] | length)], ["doc", "place"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _remove(keep_bytes: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, held = None, []
        for batch in batches:
            out: list[tuple] = []
            docs, late, tags = batch.column("doc").to_numpy(), batch.column("late").to_numpy(zero_copy_only=False), batch.column("tag").to_numpy()
            places = batch.column("place").fill_null(0).to_numpy()
            texts, ids = batch.column("text"), batch.column("doc_id")
            cuts = np.flatnonzero((docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1]) | late[1:] | late[:-1]) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(docs)], strict=True) if len(docs) else ():
                if (docs[lo], tags[lo]) != doc:
                    doc, held = (docs[lo], tags[lo]), []
                if not late[lo]:
                    held.append(places[lo:hi])
                    continue
                raw = np.frombuffer((texts[lo].as_py() or "").encode(), np.uint8)
                removed = np.zeros(len(raw), bool)
                if held and len(raw) >= SPAN:
                    held = [np.concatenate(held)]
                    _, start, more = window_range(held[0])
                    cover = np.zeros(len(raw) + 1, np.int64)
                    own = start + more + SPAN <= len(raw)
                    np.add.at(cover, start[own], 1)
                    np.add.at(cover, start[own] + more[own] + SPAN, -1)
                    removed = np.cumsum(cover[:-1]) > 0
                spans = int(removed[:1].sum() + (removed[1:] & ~removed[:-1]).sum())
                kept = raw[~removed].tobytes()
                out.append((ids[lo].as_py(), len(raw), int(removed.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _first_ranks(texts: DataFrame, hot: np.ndarray) -> DataFrame:
    rows = texts.select("doc", "tag", "text").mapInArrow(_emit(hot), ROWS)
    sorted_rows = rows.repartition("rank", "salt").sortWithinPartitions("rank", "salt", "second", "doc", "place")
    return sorted_rows.mapInArrow(_settle(hot), "rank long, doc long, place long, settled boolean")


def _last_ranks(first: DataFrame, texts: DataFrame, hot: np.ndarray) -> DataFrame:
    rows = _by_document(first.filter("not settled"), texts.filter(F.octet_length("text") >= SPAN), _fetch(hot), "rank long, doc long, place long, bytes binary", True)
    return rows.repartition("rank").sortWithinPartitions("rank", "doc", "place").mapInArrow(_last_rank, "doc long, place long")


def dedup(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """One row for each row of `docs`: what goes and what is kept (as bytes, if asked for)."""
    text, ids = F.col("text").cast("string"), F.col("doc_id").cast("long")
    # Documents without an id are told apart by their texts, and so dealt over tasks.
    doc = F.coalesce(ids, F.lit(NO_ID) + F.xxhash64(text, F.lit(1)).bitwiseAND(NO_ID - 1))
    texts = docs.select(doc.alias("doc"), ids.alias("doc_id"), text.alias("text"), F.pmod(F.xxhash64(text), F.lit(1 << TAG_BITS)).alias("tag"))
    hot = hot_ranks(texts)
    first = _frames.stored(_first_ranks(texts, hot), "ranks")
    more = _frames.stored(_last_ranks(first, texts, hot), "strings")
    gone = first.filter("settled").select("doc", "place").unionByName(more).withColumn("rank", F.lit(None).cast("long"))
    return _by_document(gone, texts, _remove(keep_bytes), RESULT, False)


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("kept")


OP6_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
w as (select doc_id, unnest(range(0, n - 49)) as p, h from d where n >= 50),
s as (select doc_id, p, substr(h, 2 * p + 1, 100) as v from w),
f as (select v, min(doc_id) as first from s group by v having count(*) > 1),
r as (select s.doc_id, p from s join f using (v) where s.doc_id > first),
c as (select distinct doc_id, unnest(range(p, p + 50)) as i from r),
g as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from c),
t as (select doc_id, count(*) as n_removed, count(*) filter (before is null or before < i - 1) as n_spans from g group by doc_id),
b as (select doc_id, unnest(range(0, n)) as i, h from d where doc_id in (select doc_id from t)),
k as (select b.doc_id, string_agg(substr(h, 2 * b.i + 1, 2), '' order by b.i) as kept from b left join c on c.doc_id = b.doc_id and c.i = b.i where c.i is null group by b.doc_id)
select d.doc_id, d.n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(case when t.doc_id is null then d.h else coalesce(k.kept, '') end)) as kept_sha256
from d left join t using (doc_id) left join k using (doc_id)
"""
