"""Forms and table cells: segmentation, ordinals, type hints, missing fields, row edits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.window import Window

from quire.functions import text as T

# Fixed value: how a form's header begins.
HEADER = r"(?U)^\s*\[\s*서식\s*(\d+)\s*\]"

# Label patterns with the field type and unit they suggest, in order.
HINTS = (
    (r"(년도|연도|설립\s*년|설립\s*연도|year)", "number", "년"),
    (r"(발행일|발급일|등록일|작성일|계약일|승인일|일자|년월일|년\s*월\s*일)", "date", ""),
    (r"(?i)(전화|연락처|휴대\s*폰|팩스|tel|fax)", "text", ""),
    (r"(?i)(이메일|email|e-mail)", "text", ""),
    (r"(?i)(주소|소재지|address)", "multiline", ""),
    (r"총\s*원|인원|직원|명\s*수|수\s*료|사원", "number", "명"),
    (r"(금액|단가|예산|가격|amount|price)", "number", "원"),
    (r"(번호|no\.?|ID|id)", "number", ""),
    (r"(건수|횟수|회\s*수)", "number", "건"),
    (r"(?i)(성명|이름|대표자|담당자|name)", "text", ""),
    (r"(?i)(비고|특이사항|설명|메모|참고|remark|description)", "multiline", ""),
)


def segment(paragraphs: DataFrame) -> DataFrame:
    """Adds form_id, form_label and segment to paragraphs (doc_id, para_index, text).

    A header opens a form; paragraphs before the first belong to none and go; a document
    without headers is one form.  A number that comes again continues under the same id.
    """
    order = Window.partitionBy("doc_id").orderBy("para_index")
    text = T.strip(F.col("text"))
    number = F.nullif(F.regexp_extract(text, HEADER, 1), F.lit(""))
    df = paragraphs.withColumn("_head", F.when(number.isNotNull(), F.struct(F.concat(F.lit("form_"), number).alias("id"), text.alias("label"))))
    df = df.withColumn("_open", F.last("_head", ignorenulls=True).over(order)).withColumn("segment", F.count("_head").over(order))
    df = df.withColumn("_any", F.max("segment").over(Window.partitionBy("doc_id")))
    df = df.filter((F.col("_any") == 0) | F.col("_open").isNotNull())
    return df.select("*", F.coalesce("_open.id", F.lit("form_0")).alias("form_id"), F.coalesce("_open.label", F.lit("(단일 문서)")).alias("form_label")).drop("_head", "_open", "_any")


def table_ordinals(tables: DataFrame) -> DataFrame:
    """Adds form_table_ordinal to tables (doc_id, segment, para_index, table_idx); tables without cells count."""
    order = Window.partitionBy("doc_id", "segment").orderBy("para_index", "table_idx")
    return tables.withColumn("form_table_ordinal", F.dense_rank().over(order) - 1)


def table_shape(cells: DataFrame) -> DataFrame:
    """Rows and columns of each table."""
    return cells.groupBy("doc_id", "para_index", "table_idx").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))


def hint(label: Column) -> Column:
    """struct(type, unit) for a label: the first pattern that is found in it, else text."""
    clean = T.strip(F.regexp_replace(F.coalesce(label, F.lit("")), r"(?U)\s+", " "))
    out = F.when(clean == "", F.struct(F.lit("text").alias("type"), F.lit("").alias("unit")))
    for pattern, kind, unit in HINTS:
        out = out.when(clean.rlike(pattern if pattern.startswith("(?i)") else f"(?U){pattern}"), F.struct(F.lit(kind).alias("type"), F.lit(unit).alias("unit")))
    return out.otherwise(F.struct(F.lit("text").alias("type"), F.lit("").alias("unit")))


def hinted(cells: DataFrame) -> DataFrame:
    """Cells with the hint of the label to their left.

    A label stands in column 0, or in an even column with 1 to 20 characters; plain text is no hint.
    """
    row = Window.partitionBy("doc_id", "para_index", "table_idx", "row").orderBy("col")
    own = hint(F.col("text"))
    label = ((F.col("col") == 0) | (F.col("col") % 2 == 0)) & F.length("text").between(1, 20)
    df = cells.withColumn("_h", F.when(label & ((own["type"] != "text") | (own["unit"] != "")), own))
    left = F.when(F.lag("col").over(row) == F.col("col") - 1, F.lag("_h").over(row))
    return df.withColumn("_left", left).filter(F.col("_left").isNotNull()).select(*cells.columns, F.col("_left.type").alias("hint_type"), F.col("_left.unit").alias("hint_unit"))


def missing_required(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Required fields (doc_id, form_id, field_id, required) without a value; '', 0 and null are none."""
    empty = F.col("value").isNull() | F.col("value").isin("", "0")
    given = values.filter(~empty).select("doc_id", "form_id", "field_id")
    return fields.filter("required").join(given, ["doc_id", "form_id", "field_id"], "left_anti")


def update_cells(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """Cells with new texts from edits (doc_id, para_index, table_idx, row, col, new_text)."""
    key = ["doc_id", "para_index", "table_idx", "row", "col"]
    return cells.join(edits, key, "left").withColumn("text", F.coalesce("new_text", "text")).drop("new_text").select(*cells.columns)


class Rows:
    """Rows of a table under edits, as runs (first source row, length, copied) in chunks of bounded
    length: an edit looks through the chunks' sizes and one chunk, and memory follows the edits."""

    CHUNK = 256

    def __init__(self, n: int):
        self.chunks: list[list] = [[n, [(0, n, False)] if n else []]]

    def _find(self, at: int) -> tuple[list, int, int] | None:
        """(chunk, place of the run, row within it), or nothing."""
        if at < 0:
            return None
        for chunk in self.chunks:
            if at < chunk[0]:
                for k, (_, length, _) in enumerate(chunk[1]):
                    if at < length:
                        return chunk, k, at
                    at -= length
            at -= chunk[0]
        return None

    def edit(self, at: int, op: str) -> None:
        if op not in ("delete", "duplicate") or (found := self._find(at)) is None:
            return
        chunk, k, row = found
        first, length, copied = chunk[1][k]
        source = first + row  # a copy is a run of one row
        own = [(first, row, copied)] if row else []
        rest = [] if row + 1 == length else [(source + 1, length - row - 1, copied)]
        middle = [] if op == "delete" else [(source, 1, copied), (source, 1, True)]
        chunk[1][k : k + 1] = own + middle + rest
        chunk[0] += -1 if op == "delete" else 1
        if len(chunk[1]) > self.CHUNK:
            half = chunk[1][: self.CHUNK // 2]
            size = sum(n for _, n, _ in half)
            here = next(i for i, c in enumerate(self.chunks) if c is chunk)
            self.chunks[here : here + 1] = [[size, half], [chunk[0] - size, chunk[1][self.CHUNK // 2 :]]]

    def runs(self) -> Iterator[tuple[int, int, int, bool]]:
        """(first row now, first source row, length, copied)."""
        at = 0
        for _, runs in self.chunks:
            for first, length, copied in runs:
                yield at, first, length, copied
                at += length


def _origins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list[dict]] = []
        for n, ops in zip(batch.column("_n").to_pylist(), batch.column("_ops").to_pylist(), strict=True):
            rows = Rows(n)
            for op in ops:
                rows.edit(op["source_row"], op["op"])
            out.append([{"now": a, "first": f, "length": m, "copied": c} for a, f, m, c in rows.runs()])
        runs = pa.array(out, pa.list_(pa.struct([("now", pa.int64()), ("first", pa.int64()), ("length", pa.int64()), ("copied", pa.bool_())])))
        yield batch.drop_columns(["_n", "_ops"]).append_column("_runs", runs)


def apply_row_ops(cells: DataFrame, ops: DataFrame) -> DataFrame:
    """Cells after ordered row edits (doc_id, para_index, table_idx, seq, source_row, op).

    Each edit sees what the one before left: `duplicate` puts an empty copy behind its row,
    `delete` takes the row out, anything else or a row that is not there changes nothing.
    `was_row` is the row before all edits, null for copies.  A table's edits become origins of
    rows in one task; the cells follow by a join.
    """
    key = ["doc_id", "para_index", "table_idx"]
    listed = ops.filter("source_row is not null").groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("source_row").cast("long").alias("source_row"), "op"))), lambda o: F.struct(o["source_row"], o["op"])).alias("_ops"))
    tables = cells.groupBy(*key).agg((F.max("row") + 1).cast("long").alias("_n"))
    edited = tables.join(listed, key).select(*key, "_n", "_ops")
    run = T_.StructType([T_.StructField("now", T_.LongType()), T_.StructField("first", T_.LongType()), T_.StructField("length", T_.LongType()), T_.StructField("copied", T_.BooleanType())])
    schema = T_.StructType([*(edited.schema[k] for k in key), T_.StructField("_runs", T_.ArrayType(run))])
    runs = edited.mapInArrow(_origins, schema).select(*key, F.inline("_runs"))
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("_k")
    kind = cells.schema["row"].dataType
    origins = runs.select(*key, "now", "first", "copied", step).select(*key, (F.col("first") + F.col("_k")).cast(kind).alias("row"), (F.col("now") + F.col("_k")).cast(kind).alias("_now"), "copied")
    untouched = cells.join(listed.select(*key), key, "left_anti").withColumn("was_row", F.col("row"))
    moved = cells.join(origins, [*key, "row"])
    was, text = F.when(~F.col("copied"), F.col("row")), F.when(F.col("copied"), F.lit("")).otherwise(F.col("text"))
    moved = moved.withColumn("was_row", was).withColumn("text", text).withColumn("row", F.col("_now"))
    return untouched.unionByName(moved.select(*untouched.columns))


def remap_edits(edits: DataFrame, moved: DataFrame) -> DataFrame:
    """Cell edits that name rows as they were, with the rows where those now are; edits of deleted rows go."""
    key = ["doc_id", "para_index", "table_idx"]
    rows = moved.filter("was_row is not null").select(*key, F.col("was_row").alias("row"), F.col("row").alias("_now")).distinct()
    return edits.join(rows, [*key, "row"]).withColumn("row", F.col("_now")).drop("_now").select(*edits.columns)
