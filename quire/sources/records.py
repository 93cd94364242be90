"""Legacy documents: streams of compound files, text records, preview text, and their fallback chain."""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quire.functions import text as X
from quire.sources import containers

#: The record tag of paragraph text: the first tag behind the reserved ones, and 51.
PARAGRAPH_TEXT = 16 + 51
#: Where the stream FileHeader keeps its properties; a lowest bit of 0 says that nothing is packed.
PROPERTIES = 36
HEADER_BYTES = 40
#: A size of all ones: the true size follows in four bytes.
LONG_SIZE = 0xFFF


#: Bytes that are inflated, and handed on, at a time.
CHUNK = 1 << 20


def _chunks(data: bytes, bits: int) -> Iterator[bytes]:
    """The inflated data in pieces of at most CHUNK bytes; data that is cut off just ends."""
    stream, at, view = zlib.decompressobj(bits), 0, memoryview(data)
    rest = b""
    while not stream.eof and (rest or at < len(view)):
        given = rest or view[at : at + CHUNK]
        if not rest:
            at += len(given)
        out = stream.decompress(given, CHUNK)
        rest = stream.unconsumed_tail
        if out:
            yield out
    while not stream.eof and (out := stream.decompress(stream.unconsumed_tail, CHUNK)):
        yield out


def _is_packed(data: bytes, bits: int) -> bool:
    try:
        for _ in _chunks(data, bits):
            pass
    except zlib.error:
        return False
    return True


def inflated(data: bytes) -> Iterator[bytes]:
    """Raw deflate or a zlib stream if it is that, in bounded pieces, else the data itself.

    Whether it is that shows at its end only, so it is inflated once to see and once to use.
    """
    for bits in (-15, 15):
        if _is_packed(data, bits):
            yield from _chunks(data, bits)
            return
    yield bytes(data)


def inflate(data: bytes, most: int = 0) -> bytes:
    """The same in one piece (`most` bytes, if given)."""
    out, size = [], 0
    for piece in inflated(data):
        out.append(piece)
        size += len(piece)
        if most and size >= most:
            break
    whole = b"".join(out)
    return whole[:most] if most else whole


class RecordReader:
    """Takes a stream piece by piece and gives its records; of unwanted tags it holds no payload."""

    def __init__(self, wanted: Callable[[int], bool] = lambda tag: True):
        self.wanted, self.held, self.skip = wanted, bytearray(), 0

    def feed(self, piece: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(tag, level, payload) of the records that this piece completes."""
        if self.skip:
            gone = min(self.skip, len(piece))
            self.skip -= gone
            piece = piece[gone:]
        self.held += piece
        at = 0
        while at + 4 <= len(self.held):
            head = struct.unpack_from("<I", self.held, at)[0]
            tag, level, size, body = head & 0x3FF, head >> 10 & 0x3FF, head >> 20, at + 4
            if size == LONG_SIZE:
                if body + 4 > len(self.held):
                    break
                size = struct.unpack_from("<I", self.held, body)[0]
                body += 4
            here = len(self.held) - body
            if not self.wanted(tag):
                at = body + min(size, here)
                self.skip = size - min(size, here)
                if self.skip:
                    break
                continue
            if size > here:
                break
            yield tag, level, bytes(memoryview(self.held)[body : body + size])
            at = body + size
        del self.held[:at]


def records(data: bytes) -> list[tuple[int, int, bytes]]:
    """(tag, level, payload) of a stream; a record that is cut off ends it."""
    return list(RecordReader().feed(data))


def _paragraphs(raw: bytes | None, packed: bool) -> list[str]:
    if raw is None:
        return []
    reader, out = RecordReader(lambda tag: tag == PARAGRAPH_TEXT), []
    for piece in inflated(bytes(raw)) if packed else [bytes(raw)]:
        out += [p.decode("utf-16-le", errors="replace") for _, _, p in reader.feed(piece) if p]
    return out


@F.pandas_udf(ArrayType(StringType()))
def text_records(data: pd.Series, packed: pd.Series) -> pd.Series:
    """The decoded paragraph texts of each stream, as they stand there."""
    return pd.Series([_paragraphs(raw, p) for raw, p in zip(data, packed, strict=True)], dtype=object)


def body_text(stream: Column, packed: Column | None = None) -> Column:
    """Readable paragraph texts of a stream, cleaned of controls and noise."""
    packed = F.lit(True) if packed is None else packed
    return X.clean_controls(F.array_join(F.filter(text_records(stream, packed), lambda t: X.looks_like_text(t)), ""))


def packed_flag(header: Column) -> Column:
    """The flag of a FileHeader stream; one that is cut off counts as packed."""
    properties = F.conv(F.hex(F.substring(header, PROPERTIES + 1, 1)), 16, 10).cast("int")
    return F.when(F.length(header) >= HEADER_BYTES, properties % 2 == 1).otherwise(F.lit(True))


def preview_text(stream: Column, most: int | None) -> Column:
    """A decoded preview without padding and byte order marks, cut at `most` characters, if given."""
    plain = X.drop_byte_order_marks(F.replace(F.decode(stream, "UTF-16LE"), F.lit("\x00"), F.lit("")))
    return plain if most is None else X.truncate(plain, most, "\n[… 이하 {} 자 생략]")


#: The streams that texts are taken from.
WANTED = r"^(FileHeader|PrvText|BodyText/Section\d+)$"


def streams(spark: SparkSession, folder: str, wanted: str = WANTED, pattern: str = "*.[hH][wW][pP]") -> DataFrame:
    """(path, name, data, error): streams of compound files whose names fit `wanted`.

    A damaged file is one row without a name, a damaged stream a row with an error.  Files are
    read whole by Spark's own reader; `containers.read` reads ranges instead.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    fits = re.compile(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_buffer()
                file = io.BytesIO(raw)
                if raw[:4].to_pybytes() == b"PK\x03\x04":
                    rows: Iterator[tuple] = iter([(None, None, None, "not a compound file")])
                else:
                    rows = containers.parts_of(file, len(raw), lambda n: bool(fits.search(n)))
                for name, _, data, error in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((path, name, data, error), (pa.string(), pa.string(), pa.binary(), pa.string()), strict=True)], ["path", "name", "data", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, name string, data binary, error string")


def texts(streams: DataFrame, most: int | None = 100_000) -> DataFrame:
    """(path, text, source, error) from streams (path, name, data and, if known, error): the
    body's sections in the order of their numbers, else the preview, else an error as data.

    A file with a section that cannot be read falls back to its preview, like one without text;
    without `most` texts are whole.
    """
    number = F.regexp_extract("name", r"Section(\d+)", 1).try_cast("int")
    if "error" not in streams.columns:
        streams = streams.withColumn("error", F.lit(None).cast("string"))

    def cut(text: Column) -> Column:
        return text if most is None else X.truncate(text, most)

    # The expensive branch first goes to its own rows: a UDF in a conditional would see them all.
    flags = streams.filter(F.col("name") == "FileHeader").groupBy("path").agg(F.max(packed_flag(F.col("data"))).alias("_packed"))
    body = streams.filter(F.col("name").rlike(r"BodyText/Section\d+")).join(flags, "path", "left").withColumn("_n", number)
    body = body.withColumn("_t", body_text(F.col("data"), F.coalesce("_packed", F.lit(True))))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_t"))), lambda s: s["_t"]), "\n")
    body = body.groupBy("path").agg(cut(joined).alias("body"), F.count("error").alias("_damaged"))
    preview = streams.filter(F.col("name") == "PrvText").select("path", preview_text(F.col("data"), most).alias("preview"))
    said = streams.groupBy("path").agg(F.max("error").alias("_error"))
    df = said.join(body, "path", "left").join(preview, "path", "left")
    full = F.nullif(X.strip(F.col("body")), F.lit("")).isNotNull() & (F.coalesce("_damaged", F.lit(0)) == 0)
    short = F.nullif(X.strip(F.col("preview")), F.lit("")).isNotNull()
    error = F.when(~full & ~short, F.coalesce("_error", F.lit("no text")))
    return df.select("path", F.when(full, F.col("body")).when(short, F.col("preview")).alias("text"), F.when(full, "body").when(short, "preview").otherwise("none").alias("source"), error.alias("error"))
