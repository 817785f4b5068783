"""Registered queries and the SQL that each must agree with."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for what a query writes and reads again: in the shared folder, or a temporary one in local mode. It goes with the driver."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.TemporaryDirectory(prefix="loamstone-")
        atexit.register(made.cleanup)
        return f"file://{made.name}/{name}"
    path = f"{base.rstrip('/')}/loamstone-{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    atexit.register(_delete_quietly, jvm, conf, path)
    return path


def _delete_quietly(jvm, conf, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone by now
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
