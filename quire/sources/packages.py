"""Zipped XML packages: parts, paragraphs, styles, table cells, repair, write-back and rendering.

A package is opened once, in the task that reads it, and leaves it as rows; everything behind
that is DataFrame code.  Only what XML itself needs (nested tables, own text of a paragraph,
edits inside a tree) is Python, one part at a time.
"""

from __future__ import annotations

import io
import re
import uuid
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions.frames import once
from quire.operators import styles

SECTION = r"^Contents/section\d+\.xml$"
# The name spaces that must keep their prefixes on output.
SPACES = {
    "hp": "http://www.hancom.co.kr/hwpml/2011/paragraph",
    "hs": "http://www.hancom.co.kr/hwpml/2011/section",
    "hh": "http://www.hancom.co.kr/hwpml/2011/head",
    "hc": "http://www.hancom.co.kr/hwpml/2011/core",
}
#: Bytes of a part that a row can hold (Arrow's 32-bit offsets); see `failed` for larger ones.
MOST_PART = (1 << 31) - 1

PARTS = "path string, part string, data binary, error string"


def listing(spark: SparkSession, folder: str, recursive: bool = False, pattern: str = "*") -> DataFrame:
    """(path, size_bytes, modified) of files; the contents are not read, a missing folder is empty."""
    try:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, size_bytes long, modified timestamp")
    return df.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def texts(spark: SparkSession, folder: str, pattern: str = "*.txt", recursive: bool = True) -> DataFrame:
    """(path, text) of text files, one row a file, without byte order marks."""
    df = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    # The reader's own column is encoded as in addresses, other listings are not.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return df.select(path.alias("path"), X.drop_byte_order_marks(F.col("value")).alias("text"))


def parts(spark: SparkSession, folder: str, wanted: str = ".*", pattern: str = "*.hwpx") -> DataFrame:
    """(path, part, data, error): the parts whose names fit `wanted`; a damaged package is one row with an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    fits = re.compile(wanted)

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows: list[tuple] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                        for info in z.infolist():
                            if fits.search(info.filename) and not info.is_dir():
                                big = info.file_size > MOST_PART
                                rows.append((path, info.filename, None if big else z.read(info), "part is too large" if big else None))
                except zipfile.BadZipFile as e:
                    rows = [(path, None, None, str(e))]
                for row in rows:  # one part a batch: memory follows the part, not the package
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.string(), pa.binary(), pa.string()), strict=True)], ["path", "part", "data", "error"])

    return files.select("path", "content").mapInArrow(unzip, PARTS)


def failed(df: DataFrame) -> DataFrame:
    """(path, part, error): packages and parts that could not be read."""
    return df.filter("error is not null").select("path", "part", "error")


def as_xml(df: DataFrame) -> DataFrame:
    """Parts with their data as text in `xml`; what is no text, such as an image, has signs in the
    place of its broken ones."""
    return df.filter("data is not null").withColumn("xml", F.make_valid_utf8(F.col("data").cast("string"))).drop("data")


def section_number(part: Column) -> Column:
    return F.regexp_extract(part, r"section(\d+)", 1).cast("int")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node: ET.Element) -> str:
    return "".join(t.text for t in node.iter() if _local(t.tag) == "t" and t.text)


def _own_text(paragraph: ET.Element) -> str:
    """Text of a paragraph outside its tables."""
    found: list[str] = []

    def walk(node: ET.Element) -> None:
        for child in node:
            name = _local(child.tag)
            if name == "t" and child.text:
                found.append(child.text)
            if name != "tbl":
                walk(child)

    for run in paragraph:
        if _local(run.tag) == "run":
            walk(run)
    return "".join(found)


def _children(node: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in node if _local(c.tag) == name]


def _tables(node: ET.Element) -> list[ET.Element]:
    """All tables under a node in document order, nested ones included."""
    return [t for t in node.iter() if _local(t.tag) == "tbl"]


def _span(cell: ET.Element, name: str) -> int:
    for c in _children(cell, "cellSpan"):
        value = c.get(name) or "1"
        return int(value) if value.isdigit() else 1
    return 1


def _rows_of(df: DataFrame, reader: Callable[[ET.Element], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of `reader` for the tree of each part, led by its path and part; broken XML gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(",")]
        for pdf in batches:
            out: list[tuple] = []
            for path, part, data in zip(pdf["path"], pdf["part"], pdf["data"], strict=True):
                try:
                    tree = ET.fromstring(bytes(data))
                except ET.ParseError:
                    continue
                out += [(path, part, *row) for row in reader(tree)]
            yield pd.DataFrame(out, columns=["path", "part", *names])

    return df.filter("data is not null").select("path", "part", "data").mapInPandas(run, f"path string, part string, {schema}")


def _paragraph_rows(tree: ET.Element) -> Iterator[tuple]:
    local = _Locals()
    for i, p in enumerate(c for c in tree if local[c.tag] == "p"):
        names = [local[n.tag] for n in p.iter()]
        n_tables = names.count("tbl")
        text = "".join(n.text for n, name in zip(p.iter(), names, strict=True) if name == "t" and n.text) if "t" in names else ""
        # A run that stands alone, and no table: all text is the paragraph's own.
        plain = n_tables == 0 and len(p) == 1 and names[1] == "run" and names[0] != "t"
        yield i, text if plain else _own_text(p), text, n_tables


class _Locals(dict):
    """Tags without their name spaces, each cut once."""

    def __missing__(self, tag: str) -> str:
        self[tag] = _local(tag)
        return self[tag]


def paragraphs(df: DataFrame) -> DataFrame:
    """(path, part, para_index, text, all_text, n_tables) of section parts; `text` leaves tables out."""
    return _rows_of(df, _paragraph_rows, "para_index int, text string, all_text string, n_tables int")


def _cell_rows(tree: ET.Element) -> Iterator[tuple]:
    for i, p in enumerate(_children(tree, "p")):
        for t, table in enumerate(_tables(p)):
            for r, row in enumerate(_children(table, "tr")):
                for c, cell in enumerate(_children(row, "tc")):
                    yield i, t, r, c, _texts(cell), _span(cell, "rowSpan"), _span(cell, "colSpan")


def cells(df: DataFrame) -> DataFrame:
    """(path, part, para_index, table_idx, row, col, text, row_span, col_span).

    Nested tables are tables of their paragraph too, and the outer cell's text holds theirs.
    """
    return _rows_of(df, _cell_rows, "para_index int, table_idx int, row int, col int, text string, row_span int, col_span int")


#: Package units of an indent that make one em on screen, about.
UNITS_PER_EM = 2000.0


def _header_rows(tree: ET.Element) -> Iterator[tuple]:
    fonts = {f.get("id"): f.get("name", "") for f in tree.iter() if _local(f.tag) == "fontface"}
    for seq, node in enumerate(tree.iter()):
        kind = _local(node.tag)
        if kind not in ("charPr", "paraPr", "style", "fontface") or not node.get("id"):
            continue
        height = node.get("height", "0")
        points = int(height) / 100 if height.lstrip("-").isdigit() else 0.0
        font = next((fonts.get(c.get("hangul", ""), "") for c in _children(node, "fontRef")), None)
        held = {_local(c.tag): c for c in node.iter()}
        marks = [name in held if kind == "charPr" else None for name in ("bold", "italic", "underline")]
        indent = (held["indent"].get("value") or "0") if kind == "paraPr" and "indent" in held else "0"
        em = int(indent) / UNITS_PER_EM if kind == "paraPr" and indent.lstrip("-").isdigit() else None
        yield kind, seq, node.get("id"), node.get("name"), node.get("charPrIDRef"), node.get("paraPrIDRef"), points if kind == "charPr" else None, font, *marks, em


def header(df: DataFrame) -> DataFrame:
    """(path, part, kind, seq, id, name, char, para, height_pt, font, bold, italic, underline, indent_em):
    fonts, character, paragraph and named styles."""
    return _rows_of(df, _header_rows, "kind string, seq int, id string, name string, char string, para string, height_pt double, font string, bold boolean, italic boolean, underline boolean, indent_em double")


def _run_rows(tree: ET.Element) -> Iterator[tuple]:
    for i, p in enumerate(_children(tree, "p")):
        for k, run in enumerate(_children(p, "run")):
            yield i, k, p.get("paraPrIDRef"), run.get("charPrIDRef"), _texts(run)


def runs(df: DataFrame) -> DataFrame:
    """(path, part, para_index, run, para, char, text): the runs of each paragraph and their style ids."""
    return _rows_of(df, _run_rows, "para_index int, run int, para string, char string, text string")


def _page_rows(tree: ET.Element) -> Iterator[tuple]:
    page = next((n for n in tree.iter() if _local(n.tag) == "pagePr"), None)
    margin = next((n for n in tree.iter() if _local(n.tag) == "margin"), None)
    if page is not None:
        yield (page.get("width"), *((margin.get(k) if margin is not None else None) for k in ("top", "bottom", "left", "right", "header", "footer")))


def page_setup(df: DataFrame) -> DataFrame:
    """Raw page width and margins of section parts, in package units."""
    return _rows_of(df, _page_rows, "width string, top string, bottom string, left string, right string, header string, footer string")


def full_text(found: DataFrame, most: int | None = 500_000) -> DataFrame:
    """(path, text): paragraphs with text joined by line ends, sections, in the order of their
    numbers, by blank lines; whole without `most`."""
    rows = found.filter("all_text <> ''").groupBy("path", section_number(F.col("part")).alias("section")).agg(F.array_sort(F.collect_list(F.struct("para_index", "all_text"))).alias("rows"))
    sections = rows.select("path", "section", F.array_join(F.transform("rows", lambda r: r["all_text"]), "\n").alias("body"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "body"))), lambda s: s["body"]), "\n\n")
    return sections.groupBy("path").agg((text if most is None else X.truncate(text, most)).alias("text"))


def read_texts(df: DataFrame, most: int | None = None) -> DataFrame:
    """(path, text, error) of packages from their section parts, in one pass over them.

    Sections that are no XML count as errors where no other gives text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, part, data, error in zip(batch.column("path").to_pylist(), batch.column("part").to_pylist(), batch.column("data"), batch.column("error").to_pylist(), strict=True):
                text = None
                if error is None and data.is_valid:
                    try:
                        text = "\n".join(t for _, _, t, _ in _paragraph_rows(ET.fromstring(data.as_buffer())) if t)
                    except ET.ParseError as e:
                        error = f"{part}: {e}"
                out.append((path, int(part.rpartition("section")[2].removesuffix(".xml")) if part else -1, text, error))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["path", "section", "text", "error"])

    rows = df.select("path", "part", "data", "error").mapInArrow(run, "path string, section long, text string, error string")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("section", "text")))), lambda s: s["text"]), "\n\n")
    body = F.nullif(body, F.lit(""))
    whole = rows.groupBy("path").agg((body if most is None else X.truncate(body, most)).alias("text"), F.max("error").alias("_error"))
    return whole.select("path", "text", F.when(F.col("text").isNull(), F.col("_error")).alias("error"))


def counts(found: DataFrame) -> DataFrame:
    """(path, n_paragraphs, has_section)."""
    return found.groupBy("path").agg(F.count("*").alias("n_paragraphs"), (F.count("*") > 0).alias("has_section"))


def thumbnails(df: DataFrame) -> DataFrame:
    return df.filter(F.lower("part").rlike(r"^preview/prvimage\.(png|jpg|gif)$")).select("path", F.col("data").alias("image"))


# What is replaced in a part's XML, one after the other.
PREFIXES = ((r"<ns\d+:", "<"), (r"</ns\d+:", "</"), (r"\bns\d+:", ""), (r'\s+xmlns:ns\d+="[^"]*"', ""))
ENTITIES = ("amp", "lt", "gt", "quot", "apos")
FLOWING = (('treatAsChar="1"', 'treatAsChar="0"'), ('horzRelTo="COLUMN"', 'horzRelTo="PARA"'), (r'vertsize="\d{5,}"', 'vertsize="1200"'))
#: What stands wherever one of them fits; plain signs are found faster than patterns.
FLOWING_SIGNS = ('treatAsChar="1"', 'horzRelTo="COLUMN"', 'vertsize="')


def repair(xml: Column, tables: bool = False) -> Column:
    """XML as the reader expects it: a declaration, no numbered prefixes, entities escaped once;
    for tables also the attributes that let them break across pages."""
    # Each step is taken only where the signs stand that all its patterns need.
    xml = _escaped_once(_unprefixed(xml))
    return _declared(_flowing(xml) if tables else xml)


def _unprefixed(xml: Column) -> Column:
    out = xml
    for pattern, to in PREFIXES:
        out = F.regexp_replace(out, pattern, to)
    return F.when(xml.rlike(r"ns\d"), out).otherwise(xml)


def _escaped_once(xml: Column) -> Column:
    out = xml
    for name in ENTITIES:
        out = F.replace(out, F.lit(f"&amp;{name};"), F.lit(f"&{name};"))
    return F.when(F.contains(xml, F.lit("&amp;")), out).otherwise(xml)


def _flowing(xml: Column) -> Column:
    out = xml
    for pattern, to in FLOWING:
        out = F.regexp_replace(out, pattern, to)
    signs = [F.contains(xml, F.lit(sign)) for sign in FLOWING_SIGNS]
    return F.when(signs[0] | signs[1] | signs[2], out).otherwise(xml)


def _declared(xml: Column) -> Column:
    return F.when(F.ltrim(xml, F.lit(X.BLANKS)).startswith("<?xml"), xml).otherwise(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n'), xml))


def repaired(df: DataFrame) -> DataFrame:
    """Parts with their XML repaired; other parts as they are."""
    # Step by step, so that no step's text is made anew for each place that the next names it in.
    is_xml, is_section = F.col("part").endswith(".xml"), F.col("part").rlike("^Contents/section")
    steps = (_unprefixed, _escaped_once, lambda xml: F.when(is_section, _flowing(xml)).otherwise(xml), _declared)
    df = once(df, _xml0=F.when(is_xml, F.decode("data", "UTF-8")))
    for k, step in enumerate(steps):
        df = once(df, **{f"_xml{k + 1}": step(F.col(f"_xml{k}"))}).drop(f"_xml{k}")
    last = f"_xml{len(steps)}"
    return once(df, _data=F.when(is_xml, F.encode(last, "UTF-8")).otherwise(F.col("data"))).withColumn("data", F.col("_data")).drop("_data", last)


def write_cells(df: DataFrame, edits: DataFrame) -> DataFrame:
    """Parts with cell texts set from edits (path, part, para_index, table_idx, row, col, new_text).

    The cell's first text takes all, its others become empty; a cell without text is skipped.
    """
    packed = edits.groupBy("path", "part").agg(F.collect_list(F.struct("para_index", "table_idx", "row", "col", "new_text")).alias("edits"))
    rows = df.join(packed, ["path", "part"], "left").select("path", "part", "data", "error", F.to_json("edits").alias("edits"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for prefix, uri in SPACES.items():
            ET.register_namespace(prefix, uri)
        for pdf in batches:
            pdf["data"] = [_with_cells(data, raw) if raw else data for data, raw in zip(pdf["data"], pdf["edits"], strict=True)]
            yield pdf.drop(columns="edits")

    return rows.mapInPandas(run, PARTS)


def _with_cells(data: bytes, raw: str) -> bytes:
    import json

    tree = ET.fromstring(bytes(data))
    paras = _children(tree, "p")
    for e in json.loads(raw):
        try:
            table = _tables(paras[e["para_index"]])[e["table_idx"]]
            cell = _children(_children(table, "tr")[e["row"]], "tc")[e["col"]]
        except IndexError:
            continue
        nodes = [t for t in cell.iter() if _local(t.tag) == "t"]
        for k, node in enumerate(nodes):
            node.text = (e.get("new_text") or "") if k == 0 else ""
    return ET.tostring(tree, encoding="utf-8", xml_declaration=True)


# Paragraph styles that would number a second time what the text numbers.
NUMBERED = ("8", "9", "10")


def without_numbering(xml: Column, ids: Sequence[str] = NUMBERED) -> Column:
    """Header XML whose paragraph styles `ids` do not number by themselves."""
    for i in ids:
        # From the style's start tag to its heading, without running into another style.
        pattern = rf'(<(?:\w+:)?paraPr\b(?=[^>]*\bid="{re.escape(i)}")[^>]*>(?:(?!</(?:\w+:)?paraPr>).)*?<(?:\w+:)?heading\b[^>]*\btype=")NUMBER"'
        xml = F.regexp_replace(xml, f"(?s){pattern}", '$1NONE"')
    return xml


def write(df: DataFrame, folder: str) -> DataFrame:
    """Zips parts (path, part, data) into packages under `folder`; returns (path, file, n_parts).

    A package appears under its name only when it is whole and never replaces another.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name = group["path"].iloc[0].rpartition("/")[2]
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for part, data in sorted(zip(group["part"], group["data"], strict=True), key=lambda x: (x[0] != "mimetype", x[0])):
                info = zipfile.ZipInfo(part, (1980, 1, 1, 0, 0, 0))
                info.compress_type = zipfile.ZIP_STORED if part == "mimetype" else zipfile.ZIP_DEFLATED
                z.writestr(info, bytes(data))
        temporary = f"{base}/.{name}.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(temporary) as out:
            out.write(buffer.getvalue())
        if system.get_file_info(f"{base}/{name}").type != fs.FileType.NotFound:
            with system.open_input_stream(f"{base}/{name}") as old:
                same = old.read() == buffer.getvalue()
            system.delete_file(temporary)
            if not same:  # the same bytes are those of an attempt of this very task
                raise FileExistsError(f"{base}/{name}")
        else:
            system.move(temporary, f"{base}/{name}")
        return pd.DataFrame({"path": [group["path"].iloc[0]], "file": [name], "n_parts": [len(group)]})

    return df.filter("data is not null").groupBy("path").applyInPandas(run, "path string, file string, n_parts int")


def table_paragraphs(cells_: DataFrame) -> DataFrame:
    """(path, seq, p): paragraphs with a table each, from (path, seq, row, col, text, width, height).

    The first row tells how many columns there are; longer rows are cut, shorter ones filled.
    Width and height are the table's, in package units, or null.
    """
    wide = cells_.groupBy("path", "seq").agg(F.max(F.when(F.col("row") == 0, F.col("col"))).alias("_last"), F.max("row").alias("_rows"), F.max("width").alias("_width"), F.max("height").alias("_height"))
    rows = cells_.groupBy("path", "seq", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("text")))).alias("_texts"))
    rows = rows.join(wide, ["path", "seq"]).filter("_last is not null")
    text = lambda c: X.escape_html(F.coalesce(F.try_element_at("_texts", c), F.lit("")))
    cell = lambda c: F.concat(F.lit("<hp:tc><hp:subList><hp:p><hp:run><hp:t>"), F.replace(text(c), F.lit("&nbsp;"), F.lit(" ")), F.lit('</hp:t></hp:run></hp:p></hp:subList><hp:cellAddr colAddr="'), c, F.lit('" rowAddr="'), F.col("row"), F.lit('"/><hp:cellSpan colSpan="1" rowSpan="1"/></hp:tc>'))
    tr = F.concat(F.lit("<hp:tr>"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("_last")), cell), ""), F.lit("</hp:tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", tr.alias("tr")))), lambda r: r["tr"]), "")
    size = F.when(F.first("_width").isNotNull() | F.first("_height").isNotNull(), F.concat(F.lit('<hp:sz width="'), F.coalesce(F.first("_width"), F.lit(0)), F.lit('" height="'), F.coalesce(F.first("_height"), F.lit(0)), F.lit('"/>'))).otherwise("")
    p = F.concat(F.lit('<hp:p paraPrIDRef="0" styleIDRef="0"><hp:run charPrIDRef="0"><hp:tbl treatAsChar="0" rowCnt="'), F.first("_rows") + 1, F.lit('" colCnt="'), F.first("_last") + 1, F.lit('">'), size, body, F.lit("</hp:tbl></hp:run></hp:p>"))
    return rows.groupBy("path", "seq").agg(p.alias("p"))


def with_front(paragraphs_: DataFrame, cover: DataFrame) -> DataFrame:
    """Paragraphs led by those of a cover (the same columns) and a list of the headings H1 to H3."""
    before = F.lit(1 << 40)
    front = cover.withColumn("seq", F.col("seq") - 2 * before)
    listed = paragraphs_.filter(F.col("type").isin("H1", "H2", "H3")).withColumn("seq", F.col("seq") - before).withColumn("type", F.lit("contents"))
    return front.unionByName(listed).unionByName(paragraphs_)


def added(paragraphs_: DataFrame, tables: DataFrame, cells_: DataFrame) -> DataFrame:
    """(path, paragraphs_added, tables_added, errors): `tables` (path, seq) without a first row are errors."""
    first = cells_.filter("row = 0").select("path", "seq").distinct().withColumn("_fine", F.lit(True))
    asked = tables.select("path", "seq").join(first, ["path", "seq"], "left")
    error = F.when(F.col("_fine").isNull(), F.concat(F.lit("table at "), F.col("seq"), F.lit(" has no rows")))
    asked = asked.groupBy("path").agg(F.count("_fine").alias("tables_added"), F.array_sort(F.collect_list(error)).alias("errors"))
    own = paragraphs_.groupBy("path").agg(F.count("*").alias("paragraphs_added"))
    none = F.array().cast("array<string>")
    return own.join(asked, "path", "full").select("path", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("paragraphs_added", "tables_added")), F.coalesce("errors", none).alias("errors"))


def section_xml(paragraphs_: DataFrame, tables: DataFrame | None = None, properties: DataFrame | None = None, lead: DataFrame | None = None) -> DataFrame:
    """(path, part, data): a section from paragraphs (path, seq, type, text, para, char, style),
    which may have `xml` of their own.

    `tables` are cells as `table_paragraphs` takes them; `properties` (path, xml) are a template's
    section properties, which stay before everything else; `lead` (path, seq, p) are paragraphs
    as XML that come next.
    """
    text = X.escape_html(F.col("text"))
    ref = lambda name, c: F.concat(F.lit(f' {name}="'), F.coalesce(F.col(c).cast("string"), F.lit("0")), F.lit('"'))
    p = F.concat(F.lit("<hp:p"), ref("paraPrIDRef", "para"), ref("styleIDRef", "style"), F.lit("><hp:run"), ref("charPrIDRef", "char"), F.lit("><hp:t>"), F.replace(text, F.lit("&nbsp;"), F.lit(" ")), F.lit("</hp:t></hp:run></hp:p>"))
    if "xml" in paragraphs_.columns:
        p = F.coalesce("xml", p)
    rows = paragraphs_.select("path", F.col("seq").cast("long").alias("seq"), p.alias("p"))
    if lead is not None:
        rows = rows.unionByName(lead.select("path", (F.col("seq") - F.lit(1 << 61)).alias("seq"), "p"))
    if tables is not None:
        rows = rows.unionByName(table_paragraphs(tables).withColumn("seq", F.col("seq").cast("long")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "p"))), lambda r: r["p"]), "")
    sections = rows.groupBy("path").agg(body.alias("_body"))
    if properties is not None:
        # Joined to whole sections: a union with their paragraphs would cost these another exchange.
        kept = F.concat(F.lit('<hp:p paraPrIDRef="0" styleIDRef="0"><hp:run charPrIDRef="0">'), "xml", F.lit("</hp:run></hp:p>"))
        first = properties.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(kept)), "").alias("_first"))
        sections = sections.join(first.hint("shuffle_hash"), "path", "full").select("path", F.concat(F.coalesce("_first", F.lit("")), F.coalesce("_body", F.lit(""))).alias("_body"))
    head = f'<?xml version="1.0" encoding="UTF-8"?><hs:sec xmlns:hs="{SPACES["hs"]}" xmlns:hp="{SPACES["hp"]}">'
    xml = F.concat(F.lit(head), "_body", F.lit("</hs:sec>"))
    return sections.select("path", F.lit("Contents/section0.xml").alias("part"), F.encode(xml, "UTF-8").alias("data"))


def render_html(found: DataFrame, cells_: DataFrame, most: int = 500_000) -> DataFrame:
    """(path, html): paragraphs in order; one with tables shows only those."""
    key = ["path", "part", "para_index"]
    row = cells_.groupBy(*key, "table_idx", "row").agg(F.array_sort(F.collect_list(F.struct("col", F.concat(F.lit("<td>"), X.escape_html(F.col("text")), F.lit("</td>")).alias("td")))).alias("tds"))
    row = row.withColumn("tr", F.concat(F.lit("<tr>"), F.array_join(F.transform("tds", lambda c: c["td"]), ""), F.lit("</tr>")))
    table = row.groupBy(*key, "table_idx").agg(F.array_sort(F.collect_list(F.struct("row", "tr"))).alias("trs"))
    table = table.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("table_idx", F.concat(F.lit("<table>"), F.array_join(F.transform("trs", lambda r: r["tr"]), ""), F.lit("</table>")).alias("t")))).alias("ts"))
    table = table.select(*key, F.array_join(F.transform("ts", lambda t: t["t"]), "").alias("_tables"))
    plain = F.when(F.col("all_text") == "", F.lit('<p style="margin:0">&nbsp;</p>')).otherwise(F.concat(F.lit('<p style="margin:0">'), X.escape_html(F.col("all_text")), F.lit("</p>")))
    if "_styled" in found.columns:
        plain = F.coalesce("_styled", plain)
    df = found.join(table, key, "left").select("path", section_number(F.col("part")).alias("section"), "para_index", F.coalesce("_tables", plain).alias("html"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "para_index", "html"))), lambda r: r["html"]), "\n")
    return df.groupBy("path").agg(F.substring(body, 1, most).alias("html"))


def render_styled(found: DataFrame, cells_: DataFrame, runs_: DataFrame, header_: DataFrame, most: int = 500_000) -> DataFrame:
    """(path, html) as `render_html`, with runs as spans of their character style and indented paragraphs."""
    chars = header_.filter("kind = 'charPr'").select("path", F.col("id").alias("char"), styles.char_css("font", "height_pt", "bold", "italic", "underline").alias("_css")).dropDuplicates(["path", "char"])
    indents = header_.filter("kind = 'paraPr'").select("path", F.col("id").alias("para"), "indent_em").dropDuplicates(["path", "para"])
    text = X.escape_html(F.col("text"))
    span = F.when(F.coalesce("_css", F.lit("")) == "", text).otherwise(F.concat(F.lit('<span style="'), "_css", F.lit('">'), text, F.lit("</span>")))
    pieces = runs_.filter("text <> ''").join(chars, ["path", "char"], "left").withColumn("span", span)
    pieces = pieces.groupBy("path", "part", "para_index").agg(F.first("para").alias("para"), F.array_sort(F.collect_list(F.struct("run", "span"))).alias("spans"))
    pieces = pieces.join(indents, ["path", "para"], "left")
    style = F.concat(F.lit("margin:0"), F.coalesce(F.concat(F.lit("; "), F.nullif(styles.para_css("indent_em"), F.lit(""))), F.lit("")))
    whole = F.concat(F.lit('<p style="'), style, F.lit('">'), F.array_join(F.transform("spans", lambda s: s["span"]), ""), F.lit("</p>"))
    shown = pieces.select("path", "part", "para_index", whole.alias("_styled"))
    return render_html(found.join(shown, ["path", "part", "para_index"], "left"), cells_, most)


def any_of(names: Sequence[str]) -> str:
    """A pattern for `parts` that takes just these parts: no other is decompressed."""
    return "^(" + "|".join(re.escape(n) for n in names) + ")$"
