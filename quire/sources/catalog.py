"""A small catalog of templates kept as a table: unique ids and names, one default, safe file names."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA = "id string, name string, file string, is_default boolean, added_at date"


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a new small file; false if there is one of that name already, whoever wrote it."""
    from py4j.protocol import Py4JJavaError

    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    local = system.makeQualified(target).toUri()
    if local.getScheme() == "file":
        # The local file system looks and creates in two steps; a hard link is one.
        name = local.getPath()
        os.makedirs(os.path.dirname(name), exist_ok=True)
        temporary = f"{os.path.dirname(name)}/.{uuid.uuid4().hex}"
        with open(temporary, "w", encoding="utf-8") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(temporary, name)
        except FileExistsError:
            return False
        finally:
            os.unlink(temporary)
        return True
    try:
        out = system.create(target, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


class Catalog:
    """Each change writes a new version of the table and then takes the next number of a log.

    Only one of several writers gets a number; the others read what is current by then and make
    their change anew, with all its checks, so that no change is lost.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _current(self) -> tuple[str | None, int]:
        try:
            numbers = self.spark.read.schema("version string, seq long").json(f"{self.folder}/log/*.json")
            row = numbers.orderBy(F.col("seq").desc()).first()
        except Exception as e:  # the folder is not there before the first change
            if "PATH_NOT_FOUND" not in str(e):
                raise
            row = None
        return (row["version"], row["seq"]) if row else (None, -1)

    def _read(self, version: str | None) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{version}")

    def rows(self) -> DataFrame:
        return self._read(self._current()[0])

    def _change(self, change: Callable[[DataFrame], tuple[DataFrame, str | None]]) -> str | None:
        """Carries out `change`, which gives new rows and an answer, on what is current when it counts."""
        while True:
            current, seq = self._current()
            rows, answer = change(self._read(current))
            version = f"v-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.folder}/{version}")
            if put_if_absent(self.spark, f"{self.folder}/log/{seq + 1:012}.json", json.dumps({"version": version, "seq": seq + 1}) + "\n"):
                return answer

    def add(self, id: str, name: str, file: str, added_at: str, default: bool = False) -> str:
        """Adds an entry; returns the file name, made unique.  The first entry is the default."""

        def change(rows: DataFrame) -> tuple[DataFrame, str]:
            if rows.filter((F.col("id") == id) | (F.col("name") == name)).limit(1).count():
                raise ValueError(f"id {id!r} or name {name!r} is there already")
            base, dot, ext = file.rpartition(".")
            base, tail, unique = base or ext, dot + (ext if dot else ""), file
            if rows.filter(F.col("file") == file).limit(1).count():
                # The least free number: one behind a taken one, or 1; only that comes back.
                number = F.substr("file", F.lit(len(base) + 2), F.length("file") - len(base) - 1 - len(tail))
                named = F.col("file").startswith(f"{base}_") & F.col("file").endswith(tail) & number.rlike("^[1-9][0-9]{0,17}$")
                taken = rows.filter(named).select(number.cast("long").alias("n"))
                free = taken.select((F.col("n") + 1).alias("n")).unionByName(self.spark.range(1, 2).select(F.col("id").alias("n"))).join(taken, "n", "left_anti")
                unique = f"{base}_{free.agg(F.min('n')).first()[0]}{tail}"
            first = not rows.limit(1).count()
            new = self.spark.createDataFrame([(id, name, unique, default or first)], "id string, name string, file string, is_default boolean").withColumn("added_at", F.lit(added_at).cast("date"))
            if default:
                rows = rows.withColumn("is_default", F.lit(False))
            return rows.unionByName(new), unique

        return self._change(change)

    def remove(self, id: str) -> None:
        def change(rows: DataFrame) -> tuple[DataFrame, None]:
            entry = rows.filter(F.col("id") == id).first()
            if entry is None:
                raise KeyError(id)
            if entry["is_default"]:
                raise ValueError("the default cannot be removed")
            return rows.filter(F.col("id") != id), None

        self._change(change)

    def set_default(self, id: str) -> None:
        def change(rows: DataFrame) -> tuple[DataFrame, None]:
            if not rows.filter(F.col("id") == id).limit(1).count():
                raise KeyError(id)
            return rows.withColumn("is_default", F.col("id") == id), None

        self._change(change)


def next_version(names: DataFrame, base: str, ext: str) -> DataFrame:
    """(name): base_vNNN with the number behind the largest among names (name)."""
    number = F.regexp_extract("name", r"_v(\d{3})", 1).try_cast("int")
    mine = names.filter(F.col("name").startswith(base)).agg(F.coalesce(F.max(number), F.lit(0)).alias("n"))
    return mine.select(F.concat(F.lit(f"{base}_v"), F.lpad((F.col("n") + 1).cast("string"), 3, "0"), F.lit(ext)).alias("name"))


def versioned(documents: DataFrame, names: DataFrame, prefix: str, day: str, ext: str = ".hwpx") -> DataFrame:
    """(path, name): for each document (path) prefix_day_vNNN, numbered on from the largest number
    among names (name) of the folder and its archive."""
    number = F.regexp_extract("name", r"_v(\d{3})", 1).try_cast("int")
    top = names.agg(F.coalesce(F.max(number), F.lit(0)).alias("_top"))
    rows = documents.select("path").distinct().withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(prefix)).orderBy("path")))
    rows = rows.withColumn("_one", F.lit(1)).join(F.broadcast(top.withColumn("_one", F.lit(1))), "_one")
    last = F.col("_top") + F.col("_n")
    padded = F.when(last < 1000, F.lpad(last.cast("string"), 3, "0")).otherwise(last.cast("string"))
    return rows.select("path", F.concat(F.lit(f"{prefix}_{day}_v"), padded, F.lit(ext)).alias("name"))


def overlaid(defaults: DataFrame, given: DataFrame) -> DataFrame:
    """Default settings (key, value) with those given in their place."""
    df = defaults.join(given.select("key", F.col("value").alias("_own")), "key", "left")
    return df.select("key", F.coalesce("_own", "value").alias("value"))
