"""WARC: a deterministic sharded writer and the reader that checks what it wrote.

Method: records are range-sorted by page id and digest; each task writes one run of the
order, a shard.  Where shards begin follows from the records alone: of those whose hash falls
into a fixed share, sorted, every SAMPLES-th is a bound, so a rerun writes the same files
however the table is partitioned.  A task writes gzip members, one a record, and starts a new
file when the compressed size reaches a limit.  Headers and digests are regenerated from the
payload.  The reader's tasks follow from the bytes of the files.  Files are written under
temporary names and renamed when whole; the manifest, written by Spark's committer after all
of them, lists what counts, and the reader opens nothing else.

Of records with equal payloads of at least MIN_REVISIT bytes, the one with the largest
page_id is a response and the others are revisits of it.  Which page revisits which is
settled on digests alone; the decisions then travel to the pages' own range partition
beside the pages, so that payloads are shuffled once.

Defined cases: a null html is an empty payload, always a response; a very long one is one
record, in memory whole; a null page_id counts as the smallest; rows that repeat the largest page_id with the same payload are all responses;
a null url leaves out its header; an empty table writes no file and reads back empty; other
columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _files, _frames

MIN_REVISIT = 1000
#: Compressed bytes from which a file is closed.
ROLL_BYTES = 64 << 20
LEVEL = 6
#: Records of a shard on average, and sampled ones between two bounds; shards at most (their
#: bounds, 73 bytes each, go to every task), beyond which shards grow.
SHARD_RECORDS, SAMPLES, MOST_SHARDS = 2048, 32, 1 << 16
#: Compressed bytes that one reading task takes on average.
TASK_BYTES = 16 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122

MANIFEST = "file string, records long, bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{digest}')}>"


def _member(headers: list[tuple[str, str | int | None]], block: bytes, level: int) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def record(page_id: int | None, url: str | None, payload: bytes, keeper: int | None, revisit: bool, level: int = LEVEL) -> bytes:
    """One gzip member: a response with its payload, or a revisit without."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")),
        ("WARC-Payload-Digest", _base32(payload)),
        ("WARC-Block-Digest", _base32(block)),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", _record_id(keeper, digest) if revisit else None),
        ("WARC-Refers-To-Page-ID", keeper if revisit else None),
        ("WARC-Page-ID", page_id),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return _member(headers, block, level)


def revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(page_id, digest, keeper) of the pages that revisit another."""
    own = pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.octet_length("html").alias("n")).filter(F.col("n") >= least).drop("n")
    own = _frames.cut(own)
    groups = own.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1 and keeper is not null").drop("n")
    # Cut, so that both sides are dealt by plain exchanges and a hot digest is split.
    found = own.join(_frames.cut(groups), "digest").filter("page_id is null or page_id < keeper")
    return found.select("page_id", "digest", "keeper").distinct()


def _sort_keys(page_id: pa.Array, digest: pa.Array) -> np.ndarray:
    """Byte strings that sort as (page_id with null first, digest)."""
    out = np.zeros((len(page_id), 73), np.uint8)
    out[:, 0] = page_id.is_valid().to_numpy(zero_copy_only=False)
    ids = page_id.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    out[:, 1:9] = ids.astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 9:] = np.array(digest.to_pylist(), "S64").view(np.uint8).reshape(-1, 64)
    return out.reshape(-1).view("S73")


def shards(ids: DataFrame, each: int = SHARD_RECORDS) -> np.ndarray:
    """The sort keys at which the second and further shards of (page_id, digest) rows begin."""
    rows = ids.count()
    each = max(each, -(-rows // MOST_SHARDS))
    if rows <= each:
        return np.zeros(0, "S73")
    sample = ids.filter(F.pmod(F.xxhash64("page_id", "digest"), F.lit(max(1, each // SAMPLES))) == 0)
    ranked = _frames.numbered(sample, F.col("page_id").asc_nulls_first(), F.col("digest"))
    found = ranked.filter((F.col("rank") > 0) & (F.col("rank") % min(SAMPLES, each) == 0)).toArrow()
    return np.sort(_sort_keys(found.column("page_id").combine_chunks(), found.column("digest").combine_chunks()))


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, level: int = LEVEL, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """Writes the archives and their manifest under `folder`; returns the manifest."""
    spark = pages.sparkSession
    null = F.lit(None)
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    records = pages.select("page_id", digest.alias("digest"), F.lit(1).alias("part"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), null.cast("long").alias("keeper"))
    decisions = revisits(pages).select("page_id", "digest", F.lit(0).alias("part"), null.cast("string").alias("url"), null.cast("string").alias("html"), "keeper")
    order = [F.col("page_id").asc_nulls_first(), F.col("digest"), F.col("part"), F.col("url")]
    bounds = shards(_frames.cut(pages.select(F.col("page_id").cast("long").alias("page_id"), digest.alias("digest"))), shard_records)

    @F.arrow_udf("int")
    def shard_of(page_id: pa.Array, digest: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, _sort_keys(page_id, digest), "right").astype(np.int32))

    both = records.unionByName(decisions).withColumn("shard", shard_of(F.col("page_id").cast("long"), "digest"))
    run = both.repartitionById(len(bounds) + 1, F.col("shard")).drop("shard").sortWithinPartitions(*order)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, out, held = TaskContext.get().partitionId(), 0, None, 0
        decided, keeper = (None, None), None

        def close() -> pa.RecordBatch:
            nonlocal out, held, number
            out.commit()
            row = pa.RecordBatch.from_arrays([pa.array([out.final.rpartition("/")[2]]), pa.array([held], pa.int64()), pa.array([out.size], pa.int64())], ["file", "records", "bytes"])
            out, held, number = None, 0, number + 1
            return row

        try:
            for batch in batches:
                for page_id, digest, part, url, html, kept in zip(*(batch.column(k) for k in ("page_id", "digest", "part", "url", "html", "keeper")), strict=True):
                    key = (page_id.as_py(), digest.as_py())
                    if part.as_py() == 0:
                        decided, keeper = key, kept.as_py()
                        continue
                    if out is None:
                        name = f"pages-{shard:06d}-{number:05d}.warc.gz"
                        out = _files.Commit(folder, name)
                        out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level))
                    payload = (html.as_py() or "").encode()
                    out.write(record(key[0], url.as_py(), payload, keeper, key == decided, level))
                    held += 1
                    if out.size >= roll_bytes:
                        yield close()
            if out is not None:
                yield close()
        finally:
            if out is not None:
                out.abort()

    run.mapInArrow(task, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def parse(raw: bytes) -> tuple | None:
    """A record's row, its digests checked; None for a warcinfo record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    field = dict(line.split(": ", 1) for line in lines[1:])
    kind, block = field["WARC-Type"], rest[: int(field["Content-Length"])]
    if kind == "warcinfo":
        return None
    if field["WARC-Block-Digest"] != _base32(block):
        raise ValueError(f"block digest of {field['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    if kind == "response" and (len(payload) != size or field["WARC-Payload-Digest"] != _base32(payload)):
        raise ValueError(f"payload digest of {field['WARC-Record-ID']}")
    page, refers = field.get("WARC-Page-ID"), field.get("WARC-Refers-To-Page-ID")
    digest = base64.b32decode(field["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    return None if page is None else int(page), size, digest, kind, None if refers is None else int(refers)


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed members of a gzip stream, one at a time."""
    unpack, parts = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            parts.append(unpack.decompress(data))
            data = unpack.unused_data
            if unpack.eof:
                yield b"".join(parts)
                unpack, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the last member is cut off")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the files that the manifest lists."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _files.open_fs(folder)
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            rows.clear()
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        for batch in batches:
            for name in batch.column("file").to_pylist():
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        if row := parse(raw):
                            rows.append(row)
                        if len(rows) >= 20_000:
                            yield out()
        yield out()

    tasks = _frames.tasks(manifest, "bytes", TASK_BYTES)
    return manifest.select("file").repartition(tasks, "file").mapInArrow(task, RECORDS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _frames.fresh_dir(spark, "warc")
    return read(write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder), folder)


OP7_SQL = """
select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest,
  case when strlen(coalesce(html, '')) >= 1000 and page_id < keeper then 'revisit' else 'response' end as record_type,
  case when strlen(coalesce(html, '')) >= 1000 and page_id < keeper then keeper end as refers_to
from (select *, max(page_id) over (partition by html) as keeper from pages)
"""
