"""Headers merged: styles of one package taken over into another's header, with all they refer to.

What a style needs is a graph: a named style its paragraph and character styles and the style
that follows it, a paragraph style borders and tab stops, a character style borders and fonts.
Nodes and references are rows; what is needed is their closure, new ids come from the operators
for styles, and only the XML itself is changed in Python, one header at a time.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import checklist, styles
from quire.sources import packages, shared

# Kinds of nodes with the elements that hold them, and the attributes that refer to them.
HOLDERS = {"borderFill": "borderFills", "tabPr": "tabProperties", "charPr": "charProperties", "paraPr": "paraProperties", "style": "styles", "fontface": "fontfaces"}
REFERENCES = {"borderFillIDRef": "borderFill", "tabPrIDRef": "tabPr", "charPrIDRef": "charPr", "paraPrIDRef": "paraPr", "styleIDRef": "style", "nextStyleIDRef": "style"}
SCRIPTS = ("hangul", "latin", "hanja", "japanese", "other", "symbol", "user")
COUNTS = ("itemCnt", "count")

KEY = ["path", "kind", "id"]


def _references(node: ET.Element) -> Iterator[tuple[ET.Element, str, str]]:
    """(element, attribute, kind) of all references under a node."""
    for child in node.iter():
        for name, kind in REFERENCES.items():
            if child.get(name):
                yield child, name, kind
        if packages._local(child.tag) == "fontRef":
            for name in SCRIPTS:
                if child.get(name):
                    yield child, name, "fontface"


def _nodes(tree: ET.Element) -> Iterator[tuple]:
    for node in tree.iter():
        kind = packages._local(node.tag)
        if kind in HOLDERS and (node.get("id") or "").isdigit():
            yield kind, int(node.get("id")), node.get("name"), [{"kind": k, "id": int(e.get(a))} for e, a, k in _references(node) if e.get(a).isdigit()]


def nodes(parts: DataFrame) -> DataFrame:
    """(path, kind, id, name, needs): the styles of header parts and what each refers to."""
    need = pa.list_(pa.struct([("kind", pa.string()), ("id", pa.int64())]))
    return _typed(parts, _nodes, "kind string, id long, name string, needs array<struct<kind: string, id: bigint>>", ["kind", "id", "name", "needs"], [pa.string(), pa.int64(), pa.string(), need])


def _typed(parts: DataFrame, reader: Callable, schema: str, names: list[str], types: list) -> DataFrame:
    """Rows of `reader` for the tree of each part, led by its path; broken XML gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("data"), strict=True):
                try:
                    tree = ET.fromstring(data.as_buffer())
                except ET.ParseError:
                    continue
                out += [(path, *row) for row in reader(tree)]
            cols = list(zip(*out, strict=True)) if out else [[]] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), *types], strict=True)], ["path", *names])

    return parts.filter("data is not null").select("path", "data").mapInArrow(run, f"path string, {schema}")


def _used(tree: ET.Element) -> Iterator[tuple]:
    yield from {(k, int(e.get(a))) for e, a, k in _references(tree) if e.get(a).isdigit()}


def used(sections: DataFrame) -> DataFrame:
    """(path, kind, id): the styles that section parts name."""
    return _typed(sections, _used, "kind string, id long", ["kind", "id"], [pa.string(), pa.int64()]).distinct()


def needed(found: DataFrame, start: DataFrame) -> DataFrame:
    """(path, kind, id) of the nodes that `start` reaches by references; rounds follow the longest chain."""
    edges = found.select(*KEY, F.explode("needs").alias("to")).select(*KEY, F.col("to.kind").alias("_kind"), F.col("to.id").alias("_id")).distinct()
    reached = start.select(*KEY).distinct().join(found.select(*KEY).distinct(), KEY)
    n, before = reached.count(), -1
    while n != before:
        more = reached.join(edges, KEY).select("path", F.col("_kind").alias("kind"), F.col("_id").alias("id"))
        # Ids of styles only, some hundred a package.
        reached = shared.cut(reached.unionByName(more.join(found.select(*KEY).distinct(), KEY)).distinct())
        n, before = reached.count(), n
    return reached


def ids(own: DataFrame, other: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, kind, old_id, new_id) for the wanted nodes of `other`.

    A font whose name `own` has is that font; all else is put behind the largest id of its kind.
    """
    group = F.struct("path", "kind").alias("group")
    mine = own.select(group, "id", "name")
    theirs = other.join(wanted, KEY, "left_semi").select(group, "id", "name")
    is_font = F.col("group.kind") == "fontface"
    fonts = styles.font_ids(mine.filter(is_font), theirs.filter(is_font))
    rest = styles.new_ids(mine.filter(~is_font).select("group", "id"), theirs.filter(~is_font).select("group", "id"))
    return fonts.unionByName(rest).select("group.path", "group.kind", F.col("old_id").cast("long").alias("old_id"), F.col("new_id").cast("long").alias("new_id"))


def _renamed(node: ET.Element, new: dict[tuple[str, int], int]) -> None:
    for child, name, kind in list(_references(node)):
        value = child.get(name)
        if value.isdigit() and (kind, int(value)) in new:
            child.set(name, str(new[kind, int(value)]))


def _merged(own: bytes, other: bytes, new: dict[tuple[str, int], int]) -> bytes:
    tree, source = ET.fromstring(own), ET.fromstring(other)
    holders = {packages._local(n.tag): n for n in tree.iter()}
    there = {(packages._local(n.tag), n.get("id")) for n in tree.iter() if packages._local(n.tag) in HOLDERS}
    space = tree.tag.rpartition("}")[0]
    for node in list(source.iter()):
        kind = packages._local(node.tag)
        number = node.get("id") or ""
        if kind not in HOLDERS or not number.isdigit() or (kind, int(number)) not in new:
            continue
        to = str(new[kind, int(number)])
        if (kind, to) in there:
            continue  # a font of that name, or the same node once more
        there.add((kind, to))
        holder = holders.get(HOLDERS[kind])
        if holder is None:
            holder = holders[HOLDERS[kind]] = ET.SubElement(tree, f"{space}}}{HOLDERS[kind]}" if space else HOLDERS[kind])
        copy = ET.fromstring(ET.tostring(node))
        copy.set("id", to)
        _renamed(copy, new)
        holder.append(copy)
        for name in COUNTS:
            if (holder.get(name) or "").isdigit():
                holder.set(name, str(int(holder.get(name)) + 1))
                break
    return ET.tostring(tree, encoding="utf-8", xml_declaration=True)


def _as_json(found: DataFrame) -> DataFrame:
    """(path, ids): the new ids of a package as one text."""
    return found.groupBy("path").agg(F.to_json(F.collect_list(F.struct("kind", "old_id", "new_id"))).alias("ids"))


def _each(rows: DataFrame, change: Callable, columns: list[str], schema: str) -> DataFrame:
    """`change(*columns, ids)` gives the new `data` of each row; XML that is broken is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for prefix, uri in packages.SPACES.items():
            ET.register_namespace(prefix, uri)
        for batch in batches:
            data, errors = [], []
            for *given, text in zip(*(batch.column(c) for c in columns), batch.column("ids").to_pylist(), strict=True):
                new = {(r["kind"], r["old_id"]): r["new_id"] for r in json.loads(text or "[]")}
                try:
                    data.append(change(*(g.as_py() for g in given), new))
                    errors.append(None)
                except ET.ParseError as e:
                    data.append(given[0].as_py())
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("part"), pa.array(data, pa.binary()), pa.array(errors, pa.string())], ["path", "part", "data", "error"])

    return rows.mapInArrow(run, schema)


def merged(own: DataFrame, other: DataFrame, found: DataFrame) -> DataFrame:
    """(path, part, data, error): the headers of `own` with the nodes of `other` that `found` names.

    `own` and `other` are header parts of the same paths, `found` what `ids` gives.
    """
    pairs = own.select("path", "part", F.col("data").alias("own")).join(other.select("path", F.col("data").alias("other")), "path").join(_as_json(found), "path", "left")
    return _each(pairs, _merged, ["own", "other"], packages.PARTS)


def _rewritten(data: bytes, new: dict[tuple[str, int], int]) -> bytes:
    tree = ET.fromstring(data)
    _renamed(tree, new)
    for node in list(tree.iter()):  # line positions of the other package's fonts
        for child in list(node):
            if packages._local(child.tag).lower() == "linesegarray":
                node.remove(child)
    return ET.tostring(tree, encoding="utf-8", xml_declaration=True)


def rewritten(sections: DataFrame, found: DataFrame) -> DataFrame:
    """(path, part, data, error): section parts that name the new ids."""
    rows = sections.select("path", "part", "data").join(_as_json(found), "path", "left")
    return _each(rows, _rewritten, ["data"], packages.PARTS)


def merge(own: DataFrame, other: DataFrame, sections: DataFrame) -> DataFrame:
    """(path, part, data, error): merged headers, and `sections` of `other` that fit them."""
    mine, theirs = nodes(own), nodes(other)
    found = ids(mine, theirs, needed(theirs, used(sections)))
    return checklist.union_all([merged(own, other, found), rewritten(sections, found)])
