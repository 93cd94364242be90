"""Required documents against a file listing: dates, keywords, best match, status, plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.window import Window

from quire.functions import text as T
from quire.functions.frames import once

# How dates stand in file names and texts, in the order in which they are tried; what
# follows one without separators; the words before a date of issue, and how far behind them it may be.
BEHIND = "(?=[._-]|$)"
NAME_DATES = (
    (r"(\d{4})[-_.](\d{2})[-_.](\d{2})", False),
    (r"_(\d{4})(\d{2})(\d{2})" + BEHIND, False),
    (r"(\d{2})(\d{2})(\d{2})_", True),
)
TEXT_DATES = (
    r"(20\d{2})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일",
    r"(20\d{2})\s*[.\-]\s*(\d{1,2})\s*[.\-]\s*(\d{1,2})\.?",
    r"(20\d{2})-(\d{2})-(\d{2})",
    r"(20\d{2})(\d{2})(\d{2})",
)
ISSUE_KEYWORDS = ("발행일", "발급일", "등록일", "작성일", "조회일")
NEAR = 80
#: Characters of hints, with one for each, that one automaton holds on average.
MOST_HINT_CHARS = 1 << 24


def stem(path: Column) -> Column:
    """A file's name without its last extension."""
    name = F.element_at(F.split(path, r"[/\\]", -1), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def _date(text: Column, pattern: str, short: bool = False) -> Column:
    """The first match of a pattern as a date; null if it is none in the calendar."""
    whole = F.regexp_extract(text, f"(?U){pattern}", 0)

    def as_date(match: Column) -> Column:
        # The three numbers are looked for in the short match only, not thrice in the text.
        y, m, d = (F.regexp_extract(match, f"(?U){pattern.removesuffix(BEHIND)}", k) for k in (1, 2, 3))
        if short:
            y = F.concat(F.when(y.try_cast("int") < 50, "20").otherwise("19"), y)
        found = F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
        return F.when(F.year(found) > 0, found)

    return F.get(F.transform(F.filter(F.array(whole), lambda x: x != ""), as_date), F.lit(0))


def date_in_name(path: Column) -> Column:
    name = stem(path)
    return F.coalesce(*(_date(name, p, short) for p, short in NAME_DATES))


def date_in_text(text: Column) -> Column:
    """A date within NEAR characters behind the first issue keyword that has one, else the text's first."""
    first = lambda t: F.coalesce(*(_date(t, p) for p in TEXT_DATES))
    windows = []
    for word in ISSUE_KEYWORDS:
        at = F.instr(text, word)
        windows.append(F.when(at > 0, first(F.substr(text, at, F.lit(len(word) + NEAR)))))
    return F.coalesce(*windows, first(text))


def dated(files: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Files (path, …) with issued_date and issued_source: the name first, then the text.

    Only files without a date in their name are joined to texts (path, text).
    """
    df = once(files, issued_date=date_in_name(F.col("path")))
    sure = df.filter("issued_date is not null").withColumn("issued_source", F.lit("filename"))
    open_ = df.filter("issued_date is null")
    if texts is None:
        return df.withColumn("issued_source", F.when(F.col("issued_date").isNotNull(), "filename").otherwise("unknown"))
    read = open_.drop("issued_date").join(texts.select("path", "text"), "path", "left").withColumn("issued_date", date_in_text(F.col("text"))).drop("text")
    return sure.unionByName(read.withColumn("issued_source", F.when(F.col("issued_date").isNotNull(), "text").otherwise("unknown")))


def _plain(text: Column) -> Column:
    return F.lower(F.translate(text, "_ -", ""))


def has_keyword(path: Column, hints: Column) -> Column:
    """Whether a name holds one of the hints, without regard to case, blanks, hyphens and underscores."""
    return _holds(_plain(stem(path)), F.transform(hints, _plain))


def _holds(name: Column, hints: Column) -> Column:
    return F.exists(hints, lambda h: (h != "") & F.contains(name, h))


def _automaton(hints: list[tuple[str, int]]) -> ahocorasick.Automaton:
    asked: dict[str, list[int]] = {}
    for hint, seq in hints:
        asked.setdefault(hint, []).append(seq)
    found = ahocorasick.Automaton()
    for hint, seqs in asked.items():
        found.add_word(hint, seqs)
    found.make_automaton()
    return found


def _asked(automaton: ahocorasick.Automaton, names: list[str | None]) -> pa.Array:
    """For each name the documents one of whose hints stands in it."""
    return pa.array([sorted({seq for _, seqs in automaton.iter(n) for seq in seqs}) if n and len(automaton) else [] for n in names], pa.list_(pa.int64()))


def _shipped(hints: list[tuple[str, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(hints)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_file"), _asked(automaton, batch.column("_name").to_pylist())], ["_file", "_seqs"])

    return run


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams groups of hints, each before the names that run through it."""
    place, hints, automaton = None, [], None
    for batch in batches:
        key = list(zip(batch.column("_group").to_pylist(), batch.column("_salt").to_pylist(), batch.column("_late").to_pylist(), strict=True))
        cuts = [k for k in range(1, len(key)) if key[k] != key[k - 1]]
        for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True) if key else ():
            part = batch.slice(lo, hi - lo)
            if key[lo][:2] != place:
                place, hints, automaton = key[lo][:2], [], None
            if not key[lo][2]:
                hints += zip(part.column("_name").to_pylist(), part.column("_seq").to_pylist(), strict=True)
                continue
            if automaton is None:
                automaton, hints = _automaton(hints), []
            yield pa.RecordBatch.from_arrays([part.column("_file"), _asked(automaton, part.column("_name").to_pylist())], ["_file", "_seqs"])


def matches(required: DataFrame, files: DataFrame) -> DataFrame:
    """Required documents (seq, id, name, is_required, max_age_days, hints) with each file that matches; outer.

    Names run through an automaton of all hints, so the number of hints does not multiply the work.
    Hints of at most MOST_HINT_CHARS characters are shipped to the names; more of them are dealt
    into groups of that size by document, and names run through each group.
    """
    hint = F.explode(F.array_distinct(F.filter(F.transform("hints", _plain), lambda h: h != ""))).alias("_name")
    hints = required.select(F.col("seq").cast("long").alias("_seq"), hint)
    named = files.select(F.struct(*files.columns).alias("_file"), _plain(stem(F.col("path"))).alias("_name"))
    schema = T_.StructType([named.schema["_file"], T_.StructField("_seqs", T_.ArrayType(T_.LongType()))])
    total = hints.agg(F.sum(F.length("_name") + 1)).first()[0] or 0
    if total <= MOST_HINT_CHARS:
        hits = named.mapInArrow(_shipped([(r["_name"], r["_seq"]) for r in hints.collect()]), schema)
    else:
        groups, salts = -(-total // MOST_HINT_CHARS), files.sparkSession.sparkContext.defaultParallelism
        each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
        right = named.select(each.alias("_group"), F.pmod(F.xxhash64("_file.path"), F.lit(salts)).cast("int").alias("_salt"), F.lit(True).alias("_late"), "_name", F.lit(None).cast("long").alias("_seq"), "_file")
        left = hints.withColumn("_group", F.pmod(F.xxhash64("_seq"), F.lit(groups)).cast("int")).select("_group", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), F.lit(False).alias("_late"), "_name", "_seq", F.lit(None).cast(named.schema["_file"].dataType).alias("_file"))
        both = right.unionByName(left).repartition("_group", "_salt").sortWithinPartitions("_group", "_salt", "_late")
        hits = both.mapInArrow(_streamed, schema)
    hits = hits.select(F.explode("_seqs").alias("_at"), "_file.*")
    hits = hits.select(F.col("_at").cast(required.schema["seq"].dataType).alias("seq"), "path", *(c for c in files.columns if c != "path"))
    return required.join(hits, "seq", "left")


def best(found: DataFrame) -> DataFrame:
    """One row a required document: the latest dated file, else the first by path.

    An aggregation, so that the files of a document are reduced where they are read.
    """
    first = F.struct(F.col("issued_date").isNull(), -F.unix_date("issued_date"), "path")
    rest = [c for c in found.columns if c != "seq"]
    df = found.groupBy("seq").agg(F.min_by(F.struct(*rest), first).alias("_best"), F.count("path").alias("n_matches"))
    return df.select("seq", *(F.col("_best")[c].alias(c) for c in rest), "n_matches")


def status(df: DataFrame, today: Column) -> DataFrame:
    """Adds age_days and status: missing, warning (limit set, date unknown or too old) or ok."""
    age = F.datediff(today, "issued_date")
    late = F.col("max_age_days").isNotNull() & (F.col("issued_date").isNull() | (age > F.col("max_age_days")))
    return df.withColumn("age_days", age).withColumn("status", F.when(F.col("path").isNull(), "missing").when(late, "warning").otherwise("ok"))


def rollup(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts by status, and whether the set can be handed in: no required document missing or unknown."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    blocked = F.col("is_required") & F.col("status").isin("missing", "unknown")
    return df.groupBy(*by).agg(*map(count, ("ok", "warning", "missing", "unknown")), F.coalesce(F.bool_and(~blocked), F.lit(True)).alias("submittable"))


def plan(df: DataFrame, template: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(seq, number, source, target) of the files to hand in, led by the columns `by` that name a tender.

    Numbers run over all documents of a tender, so missing ones leave gaps; equal targets get
    _1, _2, … .  Without `by` the list is one tender's.
    """
    numbers = df.withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy("seq")))
    ext = F.regexp_extract("path", r"(?<=[^/\\])(\.[^./\\]+)$", 1)
    name = template if template is not None else F.concat(F.format_string("%02d_", "number"), T.safe_file_name(F.col("name")), ext)
    there = numbers.filter("path is not null").withColumn("_target", T.safe_file_name(name))
    again = F.row_number().over(Window.partitionBy(*by, "_target").orderBy("seq")) - 1
    bare, tail = F.regexp_replace("_target", r"(?<=.)\.[^.]+$", ""), F.regexp_extract("_target", r"(?<=.)(\.[^.]+)$", 1)
    there = there.withColumn("_again", again)
    target = F.when(F.col("_again") == 0, F.col("_target")).otherwise(F.concat(bare, F.lit("_"), F.col("_again"), tail))
    return there.select(*by, "seq", "number", F.col("path").alias("source"), target.alias("target"))


def unmatched(files: DataFrame, planned: DataFrame) -> DataFrame:
    """Files that no planned copy uses; a second-best match is one of them."""
    return files.join(planned.select(F.col("source").alias("path")), "path", "left_anti")


def report(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One text with a line for each document, in order."""
    line = F.concat_ws(" | ", F.format_string("%02d", "seq"), "name", "status", F.coalesce("path", F.lit("-")))
    rows = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("report"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
