"""The functions that are not plain expressions, under names for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quire.operators import resolve
from quire.sources import records


@udtf(returnType="tag int, level int, size int, text string")
class StreamRecords:
    """One row a record of a legacy stream; `text` for those that hold text."""

    def eval(self, data: bytes) -> Iterator[tuple]:
        for tag, level, payload in records.records(records.inflate(bytes(data or b""))):
            yield tag, level, len(payload), payload.decode("utf-16-le", errors="replace") if tag == records.PARAGRAPH_TEXT else None


def register(spark: SparkSession) -> None:
    spark.udf.register("parse_response", resolve.parse_response)
    spark.udf.register("text_records", records.text_records)
    spark.udtf.register("stream_records", StreamRecords)
