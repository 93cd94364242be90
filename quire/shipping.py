"""Makes the package importable on executors that do not share the driver's module path."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the context, once, unless the module path that workers inherit holds it."""
    sc = spark.sparkContext
    if str(PACKAGE.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) and _inherited(str(PACKAGE.parent)):
        return
    if sc.applicationId not in _shipped:
        folder = tempfile.mkdtemp(prefix="spark-")
        sc.addPyFile(shutil.make_archive(f"{folder}/{PACKAGE.name}", "zip", PACKAGE.parent, PACKAGE.name))
        _shipped.add(sc.applicationId)


def _inherited(path: str) -> bool:
    """Whether the JVM was started with the path in its environment, so that its workers have it."""
    from pyspark import SparkContext

    jvm = SparkContext._jvm
    return jvm is not None and path in (jvm.java.lang.System.getenv("PYTHONPATH") or "").split(os.pathsep)


def ships(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, preceded by `ship`."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
