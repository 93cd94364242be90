"""The document pipeline: quality rules, near copies, personal data, mixture, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet to
the folder that the cluster shares and reads it back as the next stage's `docs`.  All but the
last return the columns of `documents`, whatever others there are and whatever they are called.

Defined cases, for every stage: an empty table gives an empty table; very long texts are worked
on whole; rows that repeat an id are rows of their own, unless the stage is there to drop copies.
What each does with null and empty texts, null ids and ties is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import _frames, jaccard, mixing, packing, pii, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null, empty and short texts are rejected; null ids do not matter; a probability at the
    threshold is kept; without labels of both classes only the base rules reject.
    """
    return quality_rules.filter_quality(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by five-word shingles, the one with the smallest id stays.

    Wordless texts, null ones included, link with nothing and stay; a null id is larger than any
    other; of rows equal in id and text one stays.
    """
    return jaccard.representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind in brackets.

    Null texts stay null; of spans that overlap the first counts, of those that begin together the
    longer; n_chars is counted anew.
    """
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their source's target asks, copies as rows of their own.

    A null source is a source of its own, the last; documents without words stay once; rows equal
    in size, id and text are dealt one after the other.
    """
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences.

    A null or empty text is its end id alone; null ids and copies are packed like others; of fill
    levels that serve equally well the fullest is taken.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
    ("packing", packed),
]

#: SQL can express neither the fitted verdict of the first stage nor the tokens of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _frames.stored(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
    return docs
