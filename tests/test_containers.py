from __future__ import annotations

import io
import os
import random
import struct
import sys
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from compound_files import END, compound_file  # noqa: E402

from quire.sources import containers, packages, records, router  # noqa: E402
from quire.sources.compound import Compound, Damaged  # noqa: E402


def opened(raw):
    return Compound(io.BytesIO(raw), len(raw))


def contents(raw):
    c = opened(raw)
    return {name: c.read(name, entry) for name, entry in c.streams()}


rng = random.Random(1)
STREAMS = {"FileHeader": bytes(range(256)), "PrvText": "미리".encode("utf-16-le"), "BodyText/Section0": rng.randbytes(5000), "BodyText/Section10": rng.randbytes(64), "Empty": b"", "A/B/deep": rng.randbytes(4095), "A/B/long": rng.randbytes(70_001)}


@pytest.mark.parametrize("shift", [9, 12])
@pytest.mark.parametrize("shuffled", [False, True])
def test_streams_come_back(shift, shuffled):
    assert contents(compound_file(STREAMS, shift, shuffled=shuffled)) == STREAMS


def test_tables_beyond_the_header():
    """More table sectors than the header lists: 7 MB and more of small sectors."""
    big = {"big": rng.randbytes(8_000_000), "small": b"s"}
    assert contents(compound_file(big)) == big


class Counted(io.BytesIO):
    n = 0

    def read(self, size=-1):
        data = super().read(size)
        self.n += len(data)
        return data


def test_only_the_wanted_stream_is_read():
    raw = compound_file({"big": rng.randbytes(4_000_000), "small": b"s" * 5000})
    file = Counted(raw)
    c = Compound(file, len(raw))
    assert c.read("small", dict(c.streams())["small"]) == b"s" * 5000
    assert file.n < 60_000


@pytest.mark.parametrize(
    "how, what",
    [
        (lambda t, s, e: t.__setitem__(1, 0), "circle"),
        (lambda t, s, e: t.__setitem__(1, 10**6), "no table"),
        (lambda t, s, e: t.__setitem__(1, 0xFFFFFFFF), "ends in"),
        (lambda t, s, e: t.__setitem__(1, END), "missing"),
    ],
)
def test_a_damaged_chain_is_an_error_of_its_stream(how, what):
    c = opened(compound_file({"long": rng.randbytes(6000), "other": rng.randbytes(5000)}, damage=how))
    entries = dict(c.streams())
    with pytest.raises(Damaged, match=what):
        c.read("long", entries["long"])
    assert len(c.read("other", entries["other"])) == 5000


def test_damaged_trees_and_files():
    def circle(t, s, e):
        e[-1]["right"] = 1

    with pytest.raises(Damaged, match="circle"):
        opened(compound_file({"a": b"1", "b": b"2"}, damage=circle)).streams()
    with pytest.raises(Damaged, match="no directory entry"):
        opened(compound_file({"a": b"1"}, damage=lambda t, s, e: e[1].__setitem__("right", 77))).streams()
    for raw in (b"", b"PK", compound_file({"a": b"1"})[:700], b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(504)):
        with pytest.raises((Damaged, struct.error)):
            opened(raw).streams()
    raw = bytearray(compound_file(STREAMS))
    for _ in range(300):  # whatever is changed, nothing runs on for ever or fails otherwise
        copy = bytearray(raw)
        for _ in range(8):
            copy[rng.randrange(len(copy))] = rng.randrange(256)
        try:
            c = opened(bytes(copy))
            for name, entry in c.streams():
                try:
                    c.read(name, entry)
                except Damaged:
                    pass
        except Damaged:
            pass


def records_of(*rows):
    out = b""
    for tag, data in rows:
        data = data.encode("utf-16-le") if isinstance(data, str) else data
        size = min(len(data), 0xFFF)
        out += struct.pack("<I", tag | size << 20) + (struct.pack("<I", len(data)) if size == 0xFFF else b"") + data
    return out


def deflated(raw):
    z = zlib.compressobj(9, zlib.DEFLATED, -15)
    return z.compress(raw) + z.flush()


HEADER = b"s" * 36 + b"\1\0\0\0"
TAG = records.PARAGRAPH_TEXT


@pytest.fixture(scope="module")
def legacy(tmp_path_factory):
    base = tmp_path_factory.mktemp("legacy")
    long = "가나다 " * 3000
    sections = {"BodyText/Section0": deflated(records_of((TAG, "첫째"), (5, b"x" * 70))), "BodyText/Section2": deflated(records_of((TAG, long))), "BodyText/Section10": deflated(records_of((TAG, "열째")))}
    preview = {"PrvText": "미리보기 글".encode("utf-16-le")}
    (base / "body.hwp").write_bytes(compound_file({"FileHeader": HEADER, **preview, **sections}, shuffled=True))
    (base / "Preview.HWP").write_bytes(compound_file({"FileHeader": HEADER, **preview, "BodyText/Section0": deflated(records_of((5, b"none")))}))

    def cut(table, small, entries):  # the first stream that is long enough: the second section
        start = next(e for e in entries if e["path"].endswith("Section0"))["start"]
        small[start] = start

    (base / "damaged chain.hwp").write_bytes(compound_file({"FileHeader": HEADER, **preview, "BodyText/Section0": deflated(records_of((TAG, "".join(chr(0xAC00 + rng.randrange(9000)) for _ in range(200)))))}, damage=cut))
    (base / "nothing.hwp").write_bytes(compound_file({"FileHeader": HEADER, "DocInfo": b"x"}))
    (base / "chain only.hwp").write_bytes(compound_file({"BodyText/Section0": b"0" * 300}, damage=lambda t, s, e: s.__setitem__(1, 0)))
    (base / "no container.hwp").write_bytes(b"plain")
    (base / "zip.hwp").write_bytes(b"PK\x03\x04")
    return base, f"첫째\n{long.strip()} \n열째"


def named(df):
    return {r.path.rpartition("/")[2]: r for r in df.collect()}


def test_legacy_files_give_body_else_preview(spark, legacy):
    base, body = legacy
    got = {k: (r.text, r.source, r.error) for k, r in named(records.texts(records.streams(spark, str(base)), None)).items()}
    assert got["body.hwp"] == (body, "body", None)
    assert got["Preview.HWP"] == ("미리보기 글", "preview", None)
    assert got["damaged chain.hwp"] == ("미리보기 글", "preview", None)
    assert got["nothing.hwp"] == (None, "none", "no text")
    assert got["chain only.hwp"][:2] == (None, "none") and "circle" in got["chain only.hwp"][2]
    assert "compound" in got["zip.hwp"][2] and got["no container.hwp"][2]
    short = named(records.texts(records.streams(spark, str(base)), 10))["body.hwp"].text
    assert short.startswith("첫째\n") and "생략" in short


def test_damaged_streams_are_rows(spark, legacy):
    rows = records.streams(spark, str(legacy[0])).filter("error is not null").collect()
    assert {(r.path.rpartition("/")[2], r.name) for r in rows} == {("damaged chain.hwp", "BodyText/Section0"), ("chain only.hwp", "BodyText/Section0"), ("no container.hwp", None), ("zip.hwp", None)}


def section(text):
    return f'<hs:sec xmlns:hs="{packages.SPACES["hs"]}" xmlns:hp="{packages.SPACES["hp"]}"><hp:p><hp:run><hp:t>{text}</hp:t></hp:run></hp:p></hs:sec>'


def test_router_reads_every_name(spark, legacy, tmp_path):
    base, body = legacy
    for f in base.iterdir():
        (tmp_path / f.name).write_bytes(f.read_bytes())
    names = ["with blank.txt", "per%cent.txt", "per%25cent.md", "a+b.txt", "한글 이름.TXT", "hash#tag.Md", "Mixed.Txt", "semi;colon.mD"]
    for k, n in enumerate(names):
        (tmp_path / n).write_text(f"text {k}", encoding="utf-8")
    long = "long " * 120_000
    for n, text in (("큰 것.HwpX", long), ("p%20q.hwpx", "inside")):
        with zipfile.ZipFile(tmp_path / n, "w") as z:
            z.writestr("Contents/section0.xml", section(text))
            z.writestr("Contents/section1.xml", section(""))
    with zipfile.ZipFile(tmp_path / "broken.hwpx", "w") as z:
        z.writestr("Contents/section0.xml", "<broken")
    listed = packages.listing(spark, str(tmp_path))
    converted = listed.filter(F.col("path").rlike("nothing.hwp|body.hwp")).select("path", F.lit("converted").alias("text"))
    got = {k: (r.text, r.error) for k, r in named(router.documents(spark, str(tmp_path), converted)).items()}
    assert len(got) == len(list(tmp_path.iterdir()))
    assert [got[n] for n in names] == [(f"text {k}", None) for k in range(len(names))]
    assert got["큰 것.HwpX"] == (long, None) and got["p%20q.hwpx"] == ("inside", None)
    assert got["body.hwp"] == (body, None) and got["nothing.hwp"] == ("converted", None) and got["Preview.HWP"] == ("미리보기 글", None)
    assert "section0" in got["broken.hwpx"][1] and "circle" in got["chain only.hwp"][1]
    cut = {k: r.text for k, r in named(router.documents(spark, str(tmp_path), most=100)).items()}
    assert len(cut["큰 것.HwpX"]) < 200 and cut["Mixed.Txt"] == "text 6"


def test_streams_expand_in_bounded_memory():
    """2 GB of records, of which two are text, in a process that may not grow by 200 MB."""
    import subprocess

    code = """
import resource, struct, zlib
from quire.sources import records
tag = records.PARAGRAPH_TEXT
z = zlib.compressobj(1, zlib.DEFLATED, -15)
out = [z.compress(struct.pack('<I', tag | 4 << 20) + 'ab'.encode('utf-16-le'))]
block = struct.pack('<II', 5 | 0xFFF << 20, 64 << 20)
zeros = bytes(1 << 20)
for _ in range(32):
    out.append(z.compress(block))
    out += [z.compress(zeros) for _ in range(64)]
out.append(z.compress(struct.pack('<I', tag | 4 << 20) + 'cd'.encode('utf-16-le')) + z.flush())
data = b''.join(out)
del out
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert records._paragraphs(data, True) == ['ab', 'cd']
grown = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before
assert grown < 200 << 10, grown
"""
    subprocess.run([sys.executable, "-c", code], check=True, env=os.environ, timeout=300)


def test_records_in_pieces_are_those_of_the_whole():
    raw = records_of(*((rng.choice([5, TAG]), rng.randbytes(rng.choice([0, 3, 100, 5000]))) for _ in range(60))) + b"\x01\x02"
    for cut in (1, 7, 4096):
        reader, got = records.RecordReader(lambda t: t == TAG), []
        for at in range(0, len(raw), cut):
            got += reader.feed(raw[at : at + cut])
        assert got == [r for r in records.records(raw) if r[0] == TAG]


# The data source


@pytest.fixture(scope="module")
def zips(tmp_path_factory):
    base = tmp_path_factory.mktemp("zips")
    big = {f"Contents/part{k:03}.bin": rng.randbytes(60_000) for k in range(60)} | {"Contents/section0.xml": section("x").encode()}
    with zipfile.ZipFile(base / "big.hwpx", "w") as z:
        for n, d in big.items():
            z.writestr(n, d)
    for k in range(5):
        with zipfile.ZipFile(base / f"s{k}.HWPX", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("mimetype", "m")
            z.writestr("Contents/section0.xml", section(f"small {k}"))
    (base / "bad.hwpx").write_bytes(b"no zip")
    (base / "c.hwp").write_bytes(compound_file(STREAMS))
    (base / "other.txt").write_text("x")
    return base, big


def test_one_part_of_a_large_package_is_read_by_ranges(zips):
    base, big = zips
    raw = (base / "big.hwpx").read_bytes()
    file = Counted(raw)
    got = list(containers.parts_of(file, len(raw), lambda n: n == "Contents/part041.bin"))
    assert got == [("Contents/part041.bin", 60_000, big["Contents/part041.bin"], None)]
    assert file.n < 60_000 + 100_000 < len(raw) // 20
    file = Counted(raw)
    assert len(list(containers.parts_of(file, len(raw), lambda n: True, with_data=False))) == 61 and file.n < 100_000


def test_slices_of_a_file_are_its_parts(spark, zips):
    base, big = zips
    df = containers.read(spark, str(base), "*.hwpx").filter("path like '%big%'")
    whole = {r.part: bytes(r.data) for r in df.collect()}
    register = spark.read.format("containers").option("pattern", "big.*").option("sliceBytes", 300_000).load(str(base))
    assert register.rdd.getNumPartitions() > 10
    rows = register.collect()
    assert {r.part: bytes(r.data) for r in rows} == whole == big and len(rows) == len(big)


def test_filters_reach_the_directory(spark, zips):
    base, _ = zips
    df = containers.read(spark, str(base), "*.hwpx").filter("part = 'Contents/section0.xml' and path like '%/s%'")
    assert len(df.collect()) == 5
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "section0" not in plan and "/s" not in plan.split("Filter", 1)[-1]  # only the check for nulls is left
    assert {r.part for r in containers.read(spark, str(base), "*.hwp").filter(F.col("part").isin("PrvText", "A/B/deep", "none")).collect()} == {"PrvText", "A/B/deep"}
    assert containers.read(spark, str(base)).filter("part like 'Body%' and part like '%10'").count() == 1
    sizes = containers.read(spark, str(base), columns="path string, part string, size long")
    assert sizes.columns == ["path", "part", "size"] and sizes.filter("part = 'Contents/part000.bin'").first()["size"] == 60_000
    errors = containers.read(spark, str(base)).filter("error is not null").collect()
    assert {r.path.rpartition("/")[2] for r in errors} == {"bad.hwpx", "other.txt"}
    assert containers.read(spark, str(base), "*.none").count() == 0


def test_parts_of_the_source_are_those_of_the_whole_reader(spark, zips):
    base, _ = zips
    own = packages.parts(spark, str(base), pattern="*.[hH][wW][pP][xX]").filter("part is not null").select("path", "part", F.sha2("data", 256).alias("h"))
    other = containers.read(spark, str(base), "*.hwpx").filter("part is not null").select("path", "part", F.sha2("data", 256).alias("h"))
    assert own.exceptAll(other).count() == 0 == other.exceptAll(own).count() and own.count() == 71


# The sink


def test_packages_appear_whole(spark, tmp_path):
    rows = [(f"in/{k}.hwpx", part, bytearray(f"{k} {part}".encode() * 50)) for k in range(7) for part in ("Contents/section0.xml", "mimetype", "Contents/header.xml")]
    df = spark.createDataFrame([*rows, ("in/0.hwpx", "skipped", None)], "path string, part string, data binary").repartition(5)
    out = tmp_path / "out"
    containers.write(df, str(out))
    assert sorted(p.name for p in out.iterdir()) == [f"{k}.hwpx" for k in range(7)]
    with zipfile.ZipFile(out / "3.hwpx") as z:
        assert z.namelist() == ["mimetype", "Contents/header.xml", "Contents/section0.xml"] and z.testzip() is None
        assert z.infolist()[0].compress_type == zipfile.ZIP_STORED and z.read("mimetype") == b"3 mimetype" * 50
    before = {p.name: p.read_bytes() for p in out.iterdir()}
    more = spark.createDataFrame([("3.hwpx", "a", bytearray(b"x")), ("new.hwpx", "a", bytearray(b"x"))], "path string, part string, data binary")
    with pytest.raises(Exception, match="FileExistsError"):
        containers.write(more, str(out))
    with pytest.raises(Exception, match="FileExistsError|same.hwpx"):
        containers.write(spark.createDataFrame([("x/same.hwpx", "a", bytearray(b"x")), ("y/same.hwpx", "a", bytearray(b"y"))], "path string, part string, data binary"), str(out))
    assert {p.name: p.read_bytes() for p in out.iterdir()} == before


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    twice = spark.createDataFrame([("a.hwpx", "p", bytearray(b"x")), ("b.hwpx", "p", bytearray(b"x")), ("b.hwpx", "p", bytearray(b"y"))], "path string, part string, data binary")
    with pytest.raises(Exception, match="twice"):
        containers.write(twice, str(tmp_path / "out"))
    assert list((tmp_path / "out").iterdir()) == []


def test_a_lost_driver_is_made_up_for(tmp_path):
    writer = containers._Writer(str(tmp_path))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a.hwpx", "b.hwpx"]), pa.array(["p", "p"]), pa.array([b"1", b"2"])], ["path", "part", "data"])
    message = writer.write(iter([batch]))
    again = containers._Writer(str(tmp_path))
    again.write(iter([batch]))  # a job that never came to its end

    class Lost(Exception):
        pass

    moved = []
    real = containers._finish

    def half(system, stage):
        import json

        with system.open_input_stream(f"{stage}/plan.json") as f:
            temporary, name = json.loads(f.read())[0]
        system.move(temporary, name)
        moved.append(name)
        raise Lost

    containers._finish = half
    try:
        with pytest.raises(Lost):
            writer.commit([message, None])
    finally:
        containers._finish = real
    assert len([p for p in tmp_path.iterdir() if p.suffix == ".hwpx"]) == 1
    assert containers.finish(str(tmp_path)) == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.hwpx", "b.hwpx"]


# What the driver holds


def _batches(names):
    import pyarrow as pa

    for at in range(0, len(names), 500):
        some = names[at : at + 500]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(["p"] * len(some)), pa.array([b"1"] * len(some))], ["path", "part", "data"])


def test_the_driver_holds_no_names_of_packages(tmp_path):
    import pickle
    import tracemalloc

    peaks = []
    for n, folder in ((3_000, "few"), (9_000, "out")):
        names = [f"m{k}.hwpx" for k in range(n)]
        writer = containers._Writer(str(tmp_path / folder))
        message = writer.write(_batches(names))
        assert len(pickle.dumps(message)) < 1_000
        tracemalloc.start()
        try:
            writer.commit([message, None])
            peaks.append(tracemalloc.get_traced_memory()[1])
        finally:
            tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0], peaks
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(names)
    slices = containers._Reader({"path": str(tmp_path / "out"), "tasks": "8"}, ["path", "part"]).partitions()
    assert [n for s in slices for n, _ in s.files] == sorted(names) and len(slices) > 8
    assert sum(len(pickle.dumps(s)) for s in slices) < 15 * len(names)


def test_names_of_two_tasks_are_compared_in_rounds(tmp_path, monkeypatch):
    monkeypatch.setattr(containers, "HASHES", 16)
    names = [f"m{k % 90}.hwpx" for k in range(100)]
    assert sorted(containers._repeated(lambda: iter(names), len(names))) == sorted(f"m{k}.hwpx" for k in range(10))
    assert list(containers._repeated(lambda: iter(names[:90]), 90)) == [] == list(containers._repeated(lambda: iter(()), 0))
    writer = containers._Writer(str(tmp_path / "out"))
    tasks = [writer.write(_batches(part)) for part in ([f"x/{n}" for n in names[:50]], [], [f"y/{n}" for n in names[49:90]])]
    with pytest.raises(FileExistsError, match="m49.hwpx$"):
        writer.commit(tasks)
    assert list((tmp_path / "out").iterdir()) == []


def test_a_plan_of_one_line_is_finished(tmp_path):
    import json

    stage = tmp_path / f"{containers.STAGE}1"
    stage.mkdir()
    names = ["a.hwpx", "b],[.hwpx", "한.hwpx"]
    for k in range(3):
        (stage / f"t{k}").write_bytes(b"")
    (stage / "plan.json").write_text(json.dumps([(f"{stage}/t{k}", f"{tmp_path}/{n}") for k, n in enumerate(names)]))
    assert containers.finish(str(tmp_path)) == 3 and sorted(p.name for p in tmp_path.iterdir()) == sorted(names)


def test_files_are_found_a_folder_at_a_time(tmp_path):
    for name in ("b", "a/c", "a/d/e", f"{containers.STAGE}1/x", "한 글\n.hwpx"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "link").symlink_to(tmp_path / "b")
    (tmp_path / "dead").symlink_to(tmp_path / "none")
    want = [("a/c", 3), ("a/d/e", 5), ("b", 1), ("link", 1), ("한 글\n.hwpx", 13)]
    for system, base, _ in (containers.system_of(str(tmp_path)), containers.system_of(f"file://{tmp_path}")):
        found = containers._listed((p.removeprefix(f"{base}/"), n) for p, n in containers._found(system, base))
        assert list(containers._rows(found)) == want
        assert list(containers._found(system, f"{base}/none")) == []
