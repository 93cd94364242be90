"""Token counts: a separator scan over flat, unindexed token files.

Method: token files are runs of little-endian ids without any index; a document ends at an
end-of-document id.  The files are cut into blocks of fixed size wherever that falls.  Tasks
read blocks by their byte ranges and search each with one vectorised comparison; how many
tasks there are follows from the bytes of the files, not of the rows that name them.  What was
cut is stitched by a prefix scan over the figures of a file's blocks, one small row a block:
the running sum of separators numbers the documents, and the running maximum of separator
positions tells where the document that is open at a block's start began.  These offsets are
then joined to the blocks' separators.

`write` makes such files from texts (ids as ordinary text, so a separator never stands
inside a document) and notes which document lies where, for the query's result only; the
scan does not use it.

Defined cases: a null or empty text has 0 tokens; a very long text lies in one file and in as
many blocks as it takes; null ids and repeated rows are counted like others; ids after a file's last separator are a document of their own, marked as open; a
file of no ids has no document; an empty table gives an empty result; other columns are
left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm import _files, _frames, _tokens

END = 50256
TYPE = "<u2"
#: Bytes from which a written file is closed, and of a block that is read at once.
ROLL_BYTES = 256 << 20
BLOCK_BYTES = 8 << 20
#: Bytes that one reading task takes on average.
TASK_BYTES = 64 << 20


def write(docs: DataFrame, folder: str, vocabulary: str = "byte_bpe_50k", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes token files under `folder`; returns (file, ordinal, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, out = TaskContext.get().partitionId(), 0, None
        rows: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal out, number
            out.commit()
            name, ids = out.final.rpartition("/")[2], [r for r in rows]
            rows.clear()
            out, number = None, number + 1
            return pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array(range(len(ids)), pa.int64()), pa.array(ids, pa.int64())], ["file", "ordinal", "doc_id"])

        try:
            for batch in batches:
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    if out is None:
                        out = _files.Commit(folder, f"tokens-{shard:06d}-{number:05d}.bin")
                    ids = _tokens.encode(text.as_py() or "", vocabulary, ordinary=True)
                    out.write(np.append(ids, np.uint32(END)).astype(TYPE).tobytes())
                    rows.append(doc)
                    if out.size >= roll_bytes:
                        yield close()
            if out is not None:
                yield close()
        finally:
            if out is not None:
                out.abort()

    docs.select("doc_id", "text").mapInArrow(run, "file string, ordinal long, doc_id long").write.parquet(f"{folder}/made")
    return docs.sparkSession.read.parquet(f"{folder}/made")


BLOCKS = "file string, block long, ids long, ends array<long>"


def scan(spark: SparkSession, folder: str, end: int = END, width: str = TYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, start, n_tokens, open) of every document in the folder's token files."""
    size = np.dtype(width).itemsize
    step = block_bytes // size * size
    files = _frames.cut(spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length"))
    tasks = _frames.tasks(files, "length", TASK_BYTES)
    blocks = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / step))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), strict=True):
                fs, base = _files.open_fs(path if "://" in path else "file://" + path.removeprefix("file:"))
                with fs.open_input_file(base) as f:
                    f.seek(block * step)
                    raw = f.read(step)
                ids = np.frombuffer(raw[: len(raw) // size * size], width)
                ends = np.flatnonzero(ids == end).astype(np.int64) + block * (step // size)
                yield pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]]), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()), pa.ListArray.from_arrays([0, len(ends)], pa.array(ends))], ["file", "block", "ids", "ends"])

    found = _frames.stored(blocks.repartition(tasks, "path", "block").mapInArrow(run, BLOCKS), "blocks")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.element_at("ends", -1)
    figures = found.select("file", "block", F.size("ends").alias("n"), F.when(F.size("ends") > 0, last).alias("last"))
    offsets = figures.select(
        "file", "block",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.coalesce(F.max("last").over(earlier) + 1, F.lit(0)).alias("open_at"),
        (F.max("block").over(Window.partitionBy("file")) == F.col("block")).alias("is_last"),
    )
    stitched = found.join(offsets, ["file", "block"]).withColumn("stop", F.col("block") * (step // size) + F.col("ids"))
    at = F.col("i")
    closed = stitched.select("file", "before", "open_at", "ends", F.posexplode("ends").alias("i", "stop"))
    start = F.when(at == 0, F.col("open_at")).otherwise(F.get("ends", at - 1) + 1)
    closed = closed.select("file", (F.col("before") + at).alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"), F.lit(False).alias("open"))
    tail = F.when(F.size("ends") > 0, last + 1).otherwise(F.col("open_at"))
    rest = stitched.filter("is_last").select("file", (F.col("before") + F.size("ends")).alias("ordinal"), tail.alias("start"), (F.col("stop") - tail).alias("n_tokens"), F.lit(True).alias("open"))
    return closed.unionByName(rest.filter("n_tokens > 0"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _frames.fresh_dir(spark, "tokens")
    made = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    counts = scan(spark, folder)
    return counts.join(made, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")
