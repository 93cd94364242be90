"""Quality classifier: a weak-label model whose posteriors train a hashed linear scorer.

Method: overlapping heuristic labellers vote good or bad, or not at all, on every document.  Their
votes are counted by pattern over the whole corpus, at most 2 to the power of the labellers,
so what expectation-maximisation needs is of fixed size: it estimates how often each labeller
votes what on good and on bad documents, and the share of good ones, and gives every pattern
its posterior.  The posteriors are soft labels for the scorer of `_hashed`, fitted on a
bounded number of documents (SAMPLE_ROWS, half of either side if there are as many), and the
scorer judges all texts, also where every labeller abstains.  As the sample has more bad
documents than the corpus, the scorer's log-odds are moved from the sample's share of good
ones to the corpus's.

Defined cases: a null text counts as empty; a very long text is voted on and scored whole;
null ids and repeated rows are judged like others; documents with equal hashes of their ids
are sampled by id; if all patterns fall on one side the scorer is constant; an empty table
gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _flat, _frames, _hashed, quality_rules

SAMPLE_ROWS = 4096
#: Documents are kept from this probability of good quality in the corpus on.
THRESHOLD = 0.5
ABSTAIN, BAD, GOOD = 0, 1, 2
LABELLERS = ("too_few", "repeats", "lines", "symbols", "capitals", "word_length", "shouts", "variety", "odd_ends", "alphabet", "length", "sentences")
#: What is believed of every labeller before any document is seen, with the weight of PRIOR_DOCS
#: documents: (class, vote) rates for classes bad and good and votes nothing, bad and good.
_CRITIC = [[0.75, 0.249, 0.001], [0.98, 0.019, 0.001]]
_FRIEND = [[0.499, 0.001, 0.5], [0.299, 0.001, 0.7]]
BELIEF = np.array([*[_CRITIC] * 10, *[_FRIEND] * 2])
PRIOR_DOCS, SHARE = 20.0, 0.85

_UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
#: Printable signs that end a word of prose rarely.
_ODD_END = np.zeros(256, bool)
_ODD_END[list(b"#$%&*+/<=>@\\^_`{|}~")] = True


def votes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, tuple]:
    """A row of votes for each text, and what the scorer needs."""
    figures, parts = quality_rules.measure(data, off)
    _, _, starts, ends, bounds, hasher = parts

    def total(mask: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.int64), np.cumsum(mask)])[off[1:]] - np.concatenate([np.zeros(1, np.int64), np.cumsum(mask)])[off[:-1]]

    n = figures["n_words"]
    per = np.maximum(n, 1)
    keys = _flat.owned(hasher(starts, ends), bounds)
    _, at = np.unique(keys, return_index=True)
    fresh = np.zeros(len(keys), bool)
    fresh[at] = True
    distinct = _flat.per_text(fresh, bounds) / per
    letters, upper = total(_LETTER[data]), total(_UPPER[data])
    capital = upper / np.maximum(letters, 1)
    shouts = total(data == 33) / per
    lines = total(data == 10) + 1
    length = figures["word_chars"] / per
    symbols = figures["n_symbols"] / per
    repeats = figures["n_repeat_words"] / per
    copies = figures["n_dup_lines"] / lines

    stops = data[ends - 1] == 46 if len(ends) else np.zeros(0, bool)
    sentences = _flat.per_text(stops, bounds) / per

    odd = _flat.per_text(_ODD_END[data[ends - 1]], bounds) / per if len(ends) else np.zeros(len(n))
    alphabet = total(_LETTER[data] | (data >= 128)) / np.maximum(total(~_flat.SEP[data]), 1)

    def bad(mask: np.ndarray) -> np.ndarray:
        return np.where(mask, BAD, ABSTAIN)

    def good(mask: np.ndarray) -> np.ndarray:
        return np.where(mask, GOOD, ABSTAIN)

    rows = [
        bad(n < 3),
        bad(repeats > 0.2),
        bad(copies >= 0.3),
        bad(symbols > 0.1),
        bad((capital > 0.4) & (letters >= 20)),
        bad((length < 2.5) | (length > 12)),
        bad(shouts > 0.2),
        bad((distinct < 0.2) & (n >= 30)),
        bad(odd > 0.2),
        bad((alphabet < 0.92) & (n >= 5)),
        good(n >= 40),
        good((sentences > 0.02) & (sentences < 0.3)),
    ]
    return np.stack(rows, 1), parts


def pattern(rows: np.ndarray) -> np.ndarray:
    return rows @ (3 ** np.arange(rows.shape[1]))


def posterior(patterns: np.ndarray, counts: np.ndarray, labellers: int = len(LABELLERS), rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns.

    Out: each pattern's probability of good, each labeller's vote rates on bad and good
    documents (labeller, class, vote), and the share of good documents.  Starting from the
    balance of the votes settles which class is which.
    """
    votes_ = (patterns[:, None] // 3 ** np.arange(labellers)) % 3
    good, share = np.full(len(patterns), SHARE), SHARE
    rates = BELIEF[:labellers].copy()
    for turn in range(rounds):
        if turn:
            for c, p in ((0, 1 - good), (1, good)):
                mass = counts * p
                for v in range(3):
                    rates[:, c, v] = (mass @ (votes_ == v) + PRIOR_DOCS * BELIEF[:labellers, c, v]) / (mass.sum() + PRIOR_DOCS)
            share = float(np.clip((counts * good).sum() / max(counts.sum(), 1), 1e-4, 1 - 1e-4))
        # A labeller that stays silent says something too: a critic does so on good documents.
        log = np.log(share / (1 - share)) + sum(np.log(rates[k, 1, votes_[:, k]] / rates[k, 0, votes_[:, k]]) for k in range(labellers))
        now = _hashed.sigmoid(log)
        moved = float(np.abs(now - good).max(initial=0.0))
        good = now
        if turn and moved < 1e-9:
            break
    return good, rates, share


def _logit(share: float) -> float:
    share = min(max(share, 1e-4), 1 - 1e-4)
    return float(np.log(share / (1 - share)))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for step in _flat.steps(batches):
        rows, _ = votes(*_flat.flat(step.column("text")))
        yield pa.RecordBatch.from_arrays([step.column("doc_id").cast(pa.int64()), pa.array(pattern(rows), pa.int64())], ["doc_id", "pattern"])


def classify(docs: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, pattern, posterior, probability, kept) of every document."""
    texts = docs.select("doc_id", "text")
    voted = _frames.cut(texts.mapInArrow(_vote, "doc_id long, pattern long"))
    # Every labeller has two ways to vote: at most 2 to the power of the labellers, 4,096 rows.
    counted = voted.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toPandas()
    codes = counted["pattern"].to_numpy(np.int64)
    good, _, share = posterior(codes, counted["n"].to_numpy(np.float64)) if len(codes) else (np.zeros(0), None, 0.5)
    table = voted.sparkSession.createDataFrame(list(zip(codes.tolist(), good.tolist(), strict=True)), "pattern long, target double")
    known = voted.filter("doc_id is not null").join(F.broadcast(table), "pattern").groupBy("doc_id").agg(F.avg("target").alias("target"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    half = known.filter("target >= 0.5").orderBy(*order).limit(rows // 2).unionByName(known.filter("target < 0.5").orderBy(*order).limit(rows // 2))
    half = _frames.cut(half)
    model = quality_rules.train(texts, half) if len(codes) else _hashed.Model(np.zeros(_hashed.DIMS, np.float32), 0.0)
    sampled = half.agg(F.avg("target")).first()[0]
    if sampled is not None:
        model = replace(model, shift=model.shift + _logit(share) - _logit(sampled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in _flat.steps(batches):
            cast, parts = votes(*_flat.flat(step.column("text")))
            code = pattern(cast)
            probability = model.probability(_hashed.occurrences(*parts))
            yield pa.RecordBatch.from_arrays([step.column("doc_id").cast(pa.int64()), pa.array(code, pa.int64()), pa.array(good[np.searchsorted(codes, code)]), pa.array(probability), pa.array(probability >= threshold)], ["doc_id", "pattern", "posterior", "probability", "kept"])

    return texts.mapInArrow(run, "doc_id long, pattern long, posterior double, probability double, kept boolean")


def op1_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
