"""Quality rules: a hashed n-gram logistic regression, calibrated and thresholded.

Method: word, word-pair and character n-gram frequencies are hashed into a table of fixed
size; a logistic regression is fitted on a bounded sample of the labelled quality rows and
calibrated on the part of the sample held out of the fit; all texts are scored in Arrow
batches and kept where the probability of good quality reaches a fixed threshold.  Plain
base rules come first: too few words, or too many words in repeated five-word windows.

Defined cases: a null text counts as empty and has no words, so the base rule fails it; a
very long text is measured and scored whole; a probability at the threshold is kept; a
null doc_id is passed through; repeated rows are judged one by one and alike, and of rows that
repeat a labelled id one (the least text by hash) is in the sample; a label row
counts only if it has a doc_id and quality 0 or 1, and documents whose label rows disagree
are left out of the sample; without both classes among the labels the learnt verdict
rejects nothing; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _flat, _hashed

#: Labelled rows that the fit sees at most: those with the smallest hashes of their ids.
SAMPLE_ROWS = 4096
#: Documents are kept from this probability of good quality on.
THRESHOLD = 0.25
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def _lines_repeated(data: np.ndarray, off: np.ndarray, starts: np.ndarray, hasher: _flat.Hasher) -> np.ndarray:
    """For each text, the lines with a word that equal an earlier line of it."""
    breaks = np.flatnonzero(data == 10)
    first = np.concatenate([off[:-1], breaks + 1])
    last = np.concatenate([off[1:], breaks])
    # A text's first line begins at its offset and ends at its first break, if it has one.
    first, last = np.sort(first, kind="stable"), np.sort(last, kind="stable")
    worded = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    first, last = first[worded], last[worded]
    owner = np.searchsorted(off, first, "right") - 1
    bounds = np.searchsorted(owner, np.arange(len(off)))
    keys = _flat.owned(hasher(first, last), bounds)
    _, at = np.unique(keys, return_index=True)
    fresh = np.zeros(len(keys), bool)
    fresh[at] = True
    return _flat.per_text(~fresh, bounds)


def _words_repeated(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text, the words inside five-word windows that it holds twice or more."""
    windows, at, window_bounds = _flat.grams(hashes, bounds, WINDOW)
    if not len(windows):
        return np.zeros(len(bounds) - 1, np.int64)
    _, which, count = np.unique(_flat.owned(windows, window_bounds), return_inverse=True, return_counts=True)
    twice = at[count[which] > 1]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    return _flat.per_text(np.cumsum(cover[:-1]) > 0, bounds)


def measure(data: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], tuple]:
    """The base figures of every text, and what the scorer needs further."""
    starts, ends, bounds = _flat.words(data, off)
    hasher = _flat.Hasher(data)
    points = np.concatenate([np.zeros(1, np.int64), np.cumsum(((data & 0xC0) != 0x80) & ~_flat.SEP[data])])
    marks = np.concatenate([np.zeros(1, np.int64), np.cumsum(_SYMBOLS[data])])
    figures = {
        "n_words": np.diff(bounds),
        "word_chars": points[off[1:]] - points[off[:-1]],
        "n_symbols": marks[off[1:]] - marks[off[:-1]],
        "n_dup_lines": _lines_repeated(data, off, starts, hasher),
        "n_repeat_words": _words_repeated(hasher(starts, ends), bounds),
    }
    return figures, (data, off, starts, ends, bounds, hasher)


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for step in _flat.steps(batches):
        data, off = _flat.flat(step.column("text"))
        starts, ends, bounds = _flat.words(data, off)
        rows = _hashed.sparse(_hashed.occurrences(data, off, starts, ends, bounds, _flat.Hasher(data)))
        yield pa.RecordBatch.from_arrays([step.column("target").cast(pa.float64()), pa.array([a for a, _ in rows], pa.binary()), pa.array([b for _, b in rows], pa.binary())], ["target", "index", "value"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, target = [], []
    for batch in batches:
        rows += zip(batch.column("index").to_pylist(), batch.column("value").to_pylist(), strict=True)
        target += batch.column("target").to_pylist()
    # Rows arrive in any order: sorted, so that reruns agree.
    order = sorted(range(len(rows)), key=lambda i: (rows[i], target[i]))
    rng = np.random.default_rng(11).permutation(len(order))
    order = [order[i] for i in rng]
    model = _hashed.fit([rows[i] for i in order], np.array([target[i] for i in order], np.float64))
    yield pa.RecordBatch.from_arrays([pa.array([model.pack()], pa.binary())], ["model"])


def train(docs: DataFrame, targets: DataFrame) -> _hashed.Model:
    """Fits the scorer on documents with a target; `targets` (doc_id, target) has a bounded size.

    One row an id is taken, so that this bound holds for the rows as well.
    """
    found = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(targets.select("doc_id", "target")), "doc_id")
    sample = found.groupBy("doc_id").agg(F.first("target").alias("target"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("target", "text")
    features = sample.mapInArrow(_featurize, "target double, index binary, value binary")
    # One task, but of SAMPLE_ROWS rows at most; its result is one row of fixed size.
    found = features.repartition(1).mapInArrow(_fit, "model binary").collect()
    return _hashed.Model.unpack(bytes(found[0]["model"])) if found else _hashed.Model(np.zeros(_hashed.DIMS, np.float32), 0.0)


def quality_targets(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, target) of at most `rows` labelled documents, chosen by the hash of the id."""
    sure = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("target"), F.max("quality").alias("_most"))
    return sure.filter("target = _most").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", F.col("target").cast("double").alias("target"))


def judge(docs: DataFrame, model: _hashed.Model, constant: bool, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: the base figures, the probability and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in _flat.steps(batches):
            figures, parts = measure(*_flat.flat(step.column("text")))
            n, repeated = figures["n_words"], figures["n_repeat_words"]
            failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)
            probability = np.ones(len(n)) if constant else model.probability(_hashed.occurrences(*parts))
            yield pa.RecordBatch.from_arrays([step.column("doc_id").cast(pa.int64()), *(pa.array(v, pa.int64()) for v in figures.values()), pa.array(failed), pa.array(probability, pa.float64()), pa.array(~failed & (probability >= threshold))], ["doc_id", *figures, "base_failed", "probability", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def quality_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fits on the labelled rows and judges every document."""
    targets = quality_targets(labels, rows)
    classes = targets.agg(F.min("target"), F.max("target")).first()
    constant = classes[0] is None or classes[0] == classes[1]
    model = _hashed.Model(np.zeros(_hashed.DIMS, np.float32), 0.0) if constant else train(docs, targets)
    return judge(docs, model, constant, threshold)


def filter_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, all their columns untouched.

    The verdict is computed in the same pass over the rows, so no join is needed and repeated
    or null ids do no harm.
    """
    targets = quality_targets(labels)
    classes = targets.agg(F.min("target"), F.max("target")).first()
    constant = classes[0] is None or classes[0] == classes[1]
    model = _hashed.Model(np.zeros(_hashed.DIMS, np.float32), 0.0) if constant else train(docs, targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in _flat.steps(batches):
            figures, parts = measure(*_flat.flat(step.column("text")))
            n = figures["n_words"]
            keep = (n >= MIN_WORDS) & (100 * figures["n_repeat_words"] <= MAX_REPEAT_PERCENT * n)
            if not constant:
                keep &= model.probability(_hashed.occurrences(*parts)) >= THRESHOLD
            yield step.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(spark, docs, labels)
