"""A data source and sink of containers: zipped packages and compound files.

Reading: files are listed, small ones grouped and large ones sliced by their bytes, and a task
reads a container's directory and the wanted parts by byte ranges.  Filters on `path` and `part`
reach the directory, so that no other part is read or inflated; a schema without `data` reads
directories only.  Files are reached by pyarrow's file systems; `packages.parts` and
`records.streams` read whole files by Spark's own instead.

Writing: parts of a package, together and in order, stream into a zip under a temporary name;
one part is held at a time.  Only when all tasks have succeeded are packages named, by a plan
written before, so that `finish` can end what a lost driver has begun.  None is ever replaced.

The driver holds no package's name for long: tasks leave lists of what they wrote, the plan is
written and read by the line, and files are found a folder at a time and dealt to tasks compressed.
"""

from __future__ import annotations

import fnmatch
import io
import json
import os
import re
import uuid
import zipfile
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from quire.sources.compound import MAGIC, Compound, Damaged

SCHEMA = "path string, part string, size long, data binary, error string"
#: Bytes that a task reads at most on average, what opening a file counts for, and the least that
#: is worth a task of its own.
SLICE_BYTES, OPEN_BYTES, LEAST_BYTES = 64 << 20, 64 << 10, 4 << 20
#: Bytes that rows handed on together hold at most, and what a row counts for; larger parts go alone.
BATCH_BYTES, ROW_BYTES = 1 << 20, 256
#: Bytes of a part that a row can hold (Arrow's 32-bit offsets).
MOST_PART = (1 << 31) - 1
STAGE = "_writing-"
#: Files that the driver looks at together, and hashes of names that it holds at most (about).
GROUP, HASHES = 1_000, 1 << 22


def system_of(folder: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a folder, the folder there, and what stands before such paths in Spark."""
    if "://" in folder:
        system, base = fs.FileSystem.from_uri(folder)
        scheme = folder.partition("://")[0]
        return system, base.rstrip("/"), "file:" if scheme == "file" else f"{scheme}://"
    return fs.LocalFileSystem(), folder.removeprefix("file:").rstrip("/"), "file:"


@dataclass
class Slice(InputPartition):
    """Parts of files: all of them, or those of one file that begin within `lo` to `hi`."""

    packed: bytes
    lo: int = 0
    hi: int | None = None

    @classmethod
    def of(cls, files: list[tuple[str, int]], lo: int = 0, hi: int | None = None) -> Slice:
        return cls(zlib.compress(json.dumps(files).encode()), lo, hi)

    @property
    def files(self) -> list[tuple[str, int]]:
        """(path, size)."""
        return [(path, n) for path, n in json.loads(zlib.decompress(self.packed))]


def planned(files: Iterable[tuple[str, int]], each: int = SLICE_BYTES, tasks: int = 1, weight: int | None = None) -> list[Slice]:
    """Large files are sliced by `each`; small ones share a task, in smaller groups where they would
    else be fewer than `tasks`.  With `weight`, what all of them count for, they are passed once."""
    if weight is None:
        files = list(files)
        weight = sum(n + OPEN_BYTES for _, n in files)
    most = min(each, max(LEAST_BYTES, weight // max(tasks, 1) + 1))
    out, held, size = [], [], 0
    for path, n in files:
        if n > each:
            out += [Slice.of([(path, n)], at, at + each if at + each < n else None) for at in range(0, n, each)]
            continue
        if held and size + n + OPEN_BYTES > most:
            out.append(Slice.of(held))
            held, size = [], 0
        held.append((path, n))
        size += n + OPEN_BYTES
    return out + [Slice.of(held)] if held else out


def _grouped(rows: Iterable, n: int = GROUP) -> Iterator[list]:
    rows = iter(rows)
    while group := list(islice(rows, n)):
        yield group


def _entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, int | None]]:
    """(path, size) of what a folder holds, folders without a size; a missing one holds nothing."""
    if not isinstance(system, fs.LocalFileSystem):
        for i in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if i.type in (fs.FileType.File, fs.FileType.Directory):
                yield i.path, i.size if i.type == fs.FileType.File else None
        return
    try:
        entries = os.scandir(folder or "/")
    except FileNotFoundError:
        return
    with entries:
        for e in entries:
            try:
                if e.is_dir() or e.is_file():
                    yield f"{folder}/{e.name}", None if e.is_dir() else e.stat().st_size
            except FileNotFoundError:  # gone since
                continue


def _found(system: fs.FileSystem, base: str) -> Iterator[tuple[str, int]]:
    """(path, size) of the files under a folder, in no order; what is being written is left out."""
    folders = [base]
    while folders:
        for path, size in _entries(system, folders.pop()):
            if STAGE in path:
                continue
            if size is None:
                folders.append(path)
            else:
                yield path, size


def _listed(files: Iterable[tuple[str, int]]) -> pa.Table:
    """Files (path, size) by path, in the bytes of their paths and few more."""
    schema = pa.schema([("path", pa.large_string()), ("size", pa.int64())])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*group, strict=True), schema.types, strict=True)], schema=schema) for group in _grouped(files, 10 * GROUP)]
    return pa.Table.from_batches(batches, schema).sort_by("path")


def _rows(table: pa.Table) -> Iterator[tuple[str, int]]:
    for batch in table.to_batches(GROUP):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _reads(f: Filter) -> re.Pattern | None:
    """A pattern for the text that a filter lets pass, if it is of a kind that can be pushed."""
    if f.attribute not in (("part",), ("path",)):
        return None
    if isinstance(f, EqualTo):
        return re.compile(re.escape(f.value) + r"\Z", re.DOTALL)
    if isinstance(f, In):
        return re.compile("(?:" + "|".join(re.escape(v) for v in f.value if v is not None) + r")\Z", re.DOTALL)
    for kind, before, after in ((StringStartsWith, "", ""), (StringEndsWith, ".*", r"\Z"), (StringContains, ".*", "")):
        if isinstance(f, kind):
            return re.compile(before + re.escape(f.value) + after, re.DOTALL)
    return None


class _Reader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.folder, self.columns = options["path"], columns
        self.pattern = options.get("pattern", "*").lower()
        self.each = int(options.get("slicebytes", SLICE_BYTES))  # names of options come in lower case
        self.tasks = int(options.get("tasks", 1))
        self.wanted: dict[str, list[re.Pattern]] = {"path": [], "part": []}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            pattern = _reads(f) if hasattr(f, "attribute") else None
            if pattern is None:
                yield f
            else:
                self.wanted[f.attribute[0]].append(pattern)

    def _fits(self, column: str, value: str) -> bool:
        return all(p.match(value) for p in self.wanted[column])

    def partitions(self) -> Sequence[InputPartition]:
        system, base, before = system_of(self.folder)
        wanted = ((p, n) for p, n in _found(system, base) if fnmatch.fnmatchcase(p.rpartition("/")[2].lower(), self.pattern) and self._fits("path", before + p))
        files = _listed((p.removeprefix(f"{base}/"), n) for p, n in wanted)
        weight = sum(n + OPEN_BYTES for _, n in _rows(files))
        # A plan without tasks is an error, so an empty one stands for no files.
        return planned(_rows(files), self.each, self.tasks, weight) or [Slice.of([])]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        system, base, before = system_of(self.folder)
        types = {"path": pa.string(), "part": pa.string(), "size": pa.int64(), "data": pa.binary(), "error": pa.string()}
        held, weight = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([row[c] for row in held], types[c]) for c in self.columns], self.columns)

        for name, size in partition.files:
            path = f"{base}/{name}"
            with system.open_input_file(path) as file:
                for part, n, data, error in parts_of(file, size, lambda p: self._fits("part", p), "data" in self.columns, partition.lo, partition.hi):
                    more = ROW_BYTES + (len(data) if data is not None else 0)
                    if held and weight + more > BATCH_BYTES:
                        yield batch()
                        held, weight = [], 0
                    held.append({"path": before + path, "part": part, "size": n, "data": data, "error": error})
                    weight += more
                    if weight >= BATCH_BYTES:  # no large part is held while the next is read
                        yield batch()
                        held, weight = [], 0
        if held:
            yield batch()


def parts_of(file, size: int, wanted, with_data: bool = True, lo: int = 0, hi: int | None = None) -> Iterator[tuple]:
    """(part, size, data, error) of one container; what is damaged is a row with an error."""
    file.seek(0)
    compound = file.read(len(MAGIC)) == MAGIC
    try:
        if compound:
            if lo:
                return  # its streams lie anywhere: they belong to the first slice
            container = Compound(file, size)
            found = [(name, entry["size"], name, entry) for name, entry in container.streams()]
        else:
            container = zipfile.ZipFile(file)
            infos = [i for i in container.infolist() if not i.is_dir() and lo <= i.header_offset and (hi is None or i.header_offset < hi)]
            found = [(i.filename, i.file_size, i) for i in infos]
    except (Damaged, zipfile.BadZipFile, OSError, ValueError) as e:
        if not lo:
            yield None, None, None, str(e) or type(e).__name__
        return
    for name, n, *where in found:
        if not wanted(name):
            continue
        if n > MOST_PART:
            yield name, n, None, "part is too large"
            continue
        try:
            yield name, n, container.read(*where) if with_data else None, None
        except Exception as e:  # a damaged part holds up no other
            yield name, n, None, str(e) or type(e).__name__


class Containers(DataSource):
    """Options: path (a folder), pattern (of file names, whatever their case), sliceBytes, tasks (as
    many as there should be at least, where the files are worth it)."""

    @classmethod
    def name(cls) -> str:
        return "containers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema.fieldNames())

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("packages are never replaced: use mode append")
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format `containers` known and lets Spark hand its filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Containers)


def read(spark: SparkSession, folder: str, pattern: str = "*", columns: str | None = None) -> DataFrame:
    """(path, part, size, data, error); `columns`, a schema of some of them, leaves out the rest."""
    register(spark)
    reader = spark.read.format("containers").option("pattern", pattern).option("tasks", spark.sparkContext.defaultParallelism)
    return (reader.schema(columns) if columns else reader).load(folder)


class _Out:
    """A stream that zipfile cannot seek in."""

    def __init__(self, out):
        self.out = out

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()


@dataclass
class Written(WriterCommitMessage):
    """The file in which a task lists its packages (temporary name, name), and how many they are."""

    listed: str
    packages: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def _stage(self) -> tuple[fs.FileSystem, str, str]:
        system, base, _ = system_of(self.folder)
        return system, base, f"{base}/{STAGE}{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, stage = self._stage()
        system.create_dir(stage, recursive=True)
        done, current, names = Written(f"{stage}/{uuid.uuid4().hex}.json", 0), None, set()
        zipped = out = None

        def close() -> None:
            if zipped is not None:
                zipped.close()
                out.close()
                _put(moves, [(temporary, current.rpartition("/")[2])], not done.packages)
                done.packages += 1

        with system.open_output_stream(done.listed, buffer_size=1 << 16) as moves:
            for batch in iterator:
                for path, part, data in zip(batch.column("path").to_pylist(), batch.column("part").to_pylist(), batch.column("data"), strict=True):
                    if path != current:
                        close()
                        current, temporary, names = path, f"{stage}/{uuid.uuid4().hex}", set()
                        out = system.open_output_stream(temporary)
                        zipped = zipfile.ZipFile(_Out(out), "w", zipfile.ZIP_DEFLATED)
                    if part in names:
                        raise ValueError(f"{path} has {part} twice")
                    names.add(part)
                    info = zipfile.ZipInfo(part, (1980, 1, 1, 0, 0, 0))
                    info.compress_type = zipfile.ZIP_STORED if part == "mimetype" else zipfile.ZIP_DEFLATED
                    with zipped.open(info, "w", force_zip64=len(data.as_buffer()) > MOST_PART // 2) as to:
                        to.write(data.as_buffer())
            close()
            moves.write(b"]")
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, base, stage = self._stage()
        tasks = [m for m in messages if m and m.packages]

        def moves() -> Iterator[tuple[str, str]]:
            return ((temporary, f"{base}/{name}") for m in tasks for temporary, name in _moves(system, m.listed))

        taken = list(islice(_repeated(lambda: (name for _, name in moves()), sum(m.packages for m in tasks)), 5))
        if tasks:
            with system.open_output_stream(f"{stage}/plan.part", buffer_size=1 << 16) as out:
                for k, group in enumerate(_grouped(moves())):
                    taken += [i.path for i in system.get_file_info([name for _, name in group]) if i.type != fs.FileType.NotFound]
                    if len(taken) >= 5:
                        break
                    _put(out, group, not k)
                out.write(b"]")
        if taken:
            self.abort(messages)
            raise FileExistsError(", ".join(taken[:5]))
        if tasks:
            system.move(f"{stage}/plan.part", f"{stage}/plan.json")
        _finish(system, stage)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, stage = self._stage()
        if system.get_file_info(stage).type == fs.FileType.Directory:
            system.delete_dir(stage)


def _put(out: pa.NativeFile, moves: list[tuple[str, str]], first: bool) -> None:
    """Writes moves, one a line, on to a list in JSON, which they begin if they are the first."""
    out.write((("[" if first else ",\n") + ",\n".join(map(json.dumps, moves))).encode())


def _moves(system: fs.FileSystem, path: str) -> Iterator[list[str]]:
    """The moves of a list in JSON, some lines at a time; a list in one line is taken too."""
    with system.open_input_stream(path) as file:
        for lines in _grouped(io.BufferedReader(file)):
            text = b"".join(lines).strip().rstrip(b",")
            yield from json.loads((b"" if text.startswith(b"[[") else b"[") + text + (b"" if text.endswith(b"]]") else b"]"))


def _repeated(names: Callable[[], Iterator[str]], n: int) -> Iterator[str]:
    """Names, of about n, that come more than once; only those whose hashes do are held, a group at a time."""
    import numpy as np  # here alone, as each of the driver's workers imports this module

    rounds = -(-n // HASHES)
    for k in range(rounds):
        hashes = np.sort(np.fromiter((h for h in map(hash, names()) if h % rounds == k), np.int64))
        twice = np.unique(hashes[1:][hashes[1:] == hashes[:-1]])
        for group in _grouped(twice.tolist()):
            some = set(group)
            yield from (name for name, times in Counter(name for name in names() if hash(name) in some).items() if times > 1)


def _finish(system: fs.FileSystem, stage: str) -> int:
    """Carries out a stage's plan, or what is left of it, and clears it away; without a plan nothing was promised."""
    moved = 0
    if system.get_file_info(f"{stage}/plan.json").type == fs.FileType.File:
        for group in _grouped(_moves(system, f"{stage}/plan.json")):
            for (temporary, name), info in zip(group, system.get_file_info([temporary for temporary, _ in group]), strict=True):
                if info.type == fs.FileType.File:
                    system.move(temporary, name)
                    moved += 1
    if system.get_file_info(stage).type == fs.FileType.Directory:
        system.delete_dir(stage)
    return moved


def finish(folder: str) -> int:
    """Names the packages of writes whose driver was lost while it named them; clears away other stages.

    Only to be called while nobody writes to the folder.
    """
    system, base, _ = system_of(folder)
    stages = [i.path for i in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if i.type == fs.FileType.Directory and i.base_name.startswith(STAGE)]
    return sum(_finish(system, s) for s in stages)


def write(parts: DataFrame, folder: str) -> None:
    """Zips parts (path, part, data) into packages under `folder`, named as the last step of `path`.

    The part named mimetype comes first, as readers expect.
    """
    register(parts.sparkSession)
    rows = parts.filter("data is not null").select("path", "part", "data")
    ordered = rows.repartition("path").sortWithinPartitions("path", F.col("part") != "mimetype", "part")
    ordered.write.format("containers").mode("append").save(folder)
