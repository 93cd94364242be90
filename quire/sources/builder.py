"""Whole packages from a template: headings in its own form, its other parts, manifest and version."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import outline
from quire.sources import containers, headers, packages, shared

#: Stand in a template's headings for what is put there.
TEXT, NUMBER = "", ""
FIRST_SECTION, HEADER, MANIFEST = "Contents/section0.xml", "Contents/header.xml", "Contents/content.hpf"


def _first(node: ET.Element, name: str) -> ET.Element | None:
    return next((n for n in node.iter() if packages._local(n.tag) == name), None)


def _form(paragraph: ET.Element, numbered: bool) -> str:
    """A heading of the template as text, with marks where its own text and number stood."""
    paragraph.attrib.pop("pageBreak", None)
    for node in list(paragraph.iter()):
        for child in list(node):
            if packages._local(child.tag).lower() == "linesegarray":
                node.remove(child)
    cells = [n for n in paragraph.iter() if packages._local(n.tag) == "tc"] if numbered else []
    if len(cells) >= 3:
        for cell, mark in ((cells[0], NUMBER), (cells[2], f" {TEXT}")):
            if (t := _first(cell, "t")) is not None:
                t.text = mark
    elif not any(packages._local(n.tag) == "tbl" for n in paragraph.iter()) or not numbered:
        if (t := _first(paragraph, "t")) is not None:
            t.text = TEXT
    return ET.tostring(paragraph, encoding="unicode")


def _heading_rows(tree: ET.Element) -> Iterator[tuple]:
    paras = packages._children(tree, "p")
    section = _first(tree, "secPr")
    properties = ET.tostring(section, encoding="unicode") if section is not None else None
    yield _form(paras[1], False) if len(paras) > 1 else None, _form(paras[2], True) if len(paras) > 2 else None, properties


def headings(sections: DataFrame) -> DataFrame:
    """(path, h1, h2, properties): the forms of a template's headings, its second and third
    paragraph, and its section properties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for prefix, uri in packages.SPACES.items():
            ET.register_namespace(prefix, uri)
        for batch in batches:
            rows = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("data"), strict=True):
                try:
                    rows += [(path, *r) for r in _heading_rows(ET.fromstring(data.as_buffer()))]
                except ET.ParseError:
                    continue
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["path", "h1", "h2", "properties"])

    return sections.filter((F.col("part") == FIRST_SECTION) & F.col("data").isNotNull()).select("path", "data").mapInArrow(run, "path string, h1 string, h2 string, properties string")


def formed(paragraphs: DataFrame, forms: DataFrame) -> DataFrame:
    """Adds `xml` to the headings of paragraphs (path, template, seq, type, text): a copy of the
    template's form, with a page break before each H1 and from a chapter's second H2 on."""
    rows = outline.page_breaks(paragraphs.withColumn("doc_id", F.col("path"))).drop("doc_id")
    rows = rows.join(forms.select(F.col("path").alias("template"), "h1", "h2"), "template", "left")
    form = F.when(F.col("type") == "H1", F.col("h1")).when(F.col("type") == "H2", F.col("h2"))
    text = F.when(F.contains(form, F.lit(NUMBER)), F.regexp_replace("text", r"^\d+\s+", "")).otherwise(F.col("text"))
    plain = F.replace(X.escape_html(text), F.lit("&nbsp;"), F.lit(" "))
    filled = F.replace(F.replace(form, F.lit(TEXT), plain), F.lit(NUMBER), F.col("h2_number").cast("string"))
    broken = F.when(F.col("page_break"), F.regexp_replace(filled, r"^<([\w:]+)", '<$1 pageBreak="1"')).otherwise(filled)
    return rows.withColumn("xml", broken).drop("h1", "h2", "h2_number", "page_break")


def _manifests(manifests: DataFrame, sections: DataFrame) -> DataFrame:
    """Manifests (path, part, data) that name all sections (path, part) of their package."""
    xml = F.decode("data", "UTF-8")
    names = sections.groupBy("path").agg(F.array_sort(F.collect_set(F.regexp_replace("part", r"^Contents/|\.xml$", ""))).alias("_names"))
    absent = F.filter("_names", lambda n: ~F.contains(F.col("_xml"), n))
    items = F.array_join(F.transform(absent, lambda n: F.concat(F.lit('<opf:item id="'), n, F.lit('" href="Contents/'), n, F.lit('.xml" media-type="application/xml"/>'))), "")
    refs = F.array_join(F.transform(absent, lambda n: F.concat(F.lit('<opf:itemref idref="'), n, F.lit('"/>'))), "")
    rows = manifests.join(names, "path", "left").withColumn("_xml", xml).withColumn("_items", F.coalesce(items, F.lit(""))).withColumn("_refs", F.coalesce(refs, F.lit("")))
    # Ends of the lists, whatever their prefix; a manifest without them takes the names at its own end.
    with_refs = F.regexp_replace(F.col("_xml"), r"(</(?:\w+:)?spine>)", F.concat(F.col("_refs"), F.lit("$1")))
    with_items = F.regexp_replace(with_refs, r"(</(?:\w+:)?manifest>)", F.concat(F.col("_items"), F.lit("$1")))
    left = F.filter("_names", lambda n: ~F.contains(with_items, n))
    bare = F.when(F.size(left) > 0, F.concat(with_items, F.lit("\n<!-- "), F.array_join(left, " "), F.lit(" -->"))).otherwise(with_items)
    return rows.select("path", "part", F.encode(F.coalesce(bare, "_xml"), "UTF-8").alias("data"))


def assembled(documents: DataFrame, templates: DataFrame, made: DataFrame) -> DataFrame:
    """(path, part, data) of whole packages: of each document (path, template) the made parts
    (path, part, data), the template's other parts, and a manifest that names all sections.

    Headers do not number what the text numbers, and all XML is repaired.
    """
    made = shared.cut(made.select("path", "part", "data"))
    own = documents.select("path", "template").distinct()
    theirs = own.join(templates.filter("data is not null").select(F.col("path").alias("template"), "part", "data"), "template").drop("template")
    rest = theirs.join(made.select("path", "part").distinct(), ["path", "part"], "left_anti")
    parts = rest.unionByName(made)
    sections = parts.filter(F.col("part").rlike(packages.SECTION)).select("path", "part")
    is_manifest = F.col("part") == MANIFEST
    parts = parts.filter(~is_manifest).unionByName(_manifests(parts.filter(is_manifest), sections))
    header = F.encode(packages.without_numbering(F.decode("data", "UTF-8")), "UTF-8")
    return packages.repaired(parts.withColumn("data", F.when(F.col("part") == HEADER, header).otherwise(F.col("data"))))


def build(documents: DataFrame, paragraphs: DataFrame, templates: DataFrame, tables: DataFrame | None = None, fronts: DataFrame | None = None, reference: DataFrame | None = None) -> DataFrame:
    """(path, part, data) of whole packages from templates.

    `documents` (path, template), `paragraphs` (path, seq, type, text, para, char, style),
    `templates` parts; `tables` as `packages.table_paragraphs` takes them.  With `reference`,
    header parts by document path, and `fronts`, section parts that lead the document, their
    styles are merged into the template's header.
    """
    forms = headings(templates)
    rows = formed(paragraphs.join(documents.select("path", "template"), "path"), forms)
    properties = documents.join(forms.select(F.col("path").alias("template"), F.col("properties").alias("xml")), "template").select("path", "xml").filter("xml is not null")
    made, lead = None, None
    if fronts is not None and reference is not None:
        own = documents.join(templates.filter(F.col("part") == HEADER).select(F.col("path").alias("template"), "part", "data"), "template").drop("template")
        both = headers.merge(own, reference, fronts)
        made = both.filter(F.col("part") == HEADER).select("path", "part", "data")
        lead = _inner(both.filter(F.col("part").rlike(packages.SECTION)))
    section = packages.section_xml(rows, tables, properties, lead)
    return assembled(documents, templates, section if made is None else section.unionByName(made))


def _inner(sections: DataFrame) -> DataFrame:
    """(path, seq, p): the paragraphs of section parts as XML, without section properties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for prefix, uri in packages.SPACES.items():
            ET.register_namespace(prefix, uri)
        for batch in batches:
            rows = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("data"), strict=True):
                for k, p in enumerate(packages._children(ET.fromstring(data.as_buffer()), "p")):
                    for node in list(p.iter()):
                        for child in [c for c in node if packages._local(c.tag) == "secPr"]:
                            node.remove(child)
                    rows.append((path, k, ET.tostring(p, encoding="unicode")))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string()), strict=True)], ["path", "seq", "p"])

    return sections.select("path", "data").mapInArrow(run, "path string, seq long, p string")


def write(parts: DataFrame, folder: str) -> None:
    """Writes whole packages; see `containers.write`."""
    containers.write(parts, folder)
