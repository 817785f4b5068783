"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = " \t\n\x0b\x0c\r"
#: Bytes that are broadcast at most.
BROADCAST_BYTES = 64 << 20
_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the shared folder of spark.checkpoint.dir, deleted when the driver ends.

    Where that is unset, in local mode only, it is a temporary folder.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base:
            _scratch[app] = f"{base.rstrip('/')}/loamstone-{app}"
            atexit.register(_delete_quietly, *_files(spark), _scratch[app])
        elif spark.sparkContext.master.startswith("local"):
            folder = tempfile.TemporaryDirectory(prefix="loamstone-")
            atexit.register(folder.cleanup)
            _scratch[app] = f"file://{folder.name}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _scratch[app]


def _files(spark: SparkSession) -> tuple:
    """What deleting takes; it outlives the session."""
    return spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()


def _delete(jvm, conf, path: str) -> None:
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def _delete_quietly(jvm, conf, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone by now
        _delete(jvm, conf, path)


def materialise(df: DataFrame, label: str, *, partition_by: tuple[str, ...] = (), **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut and lost executors cost no rework."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).partitionBy(*partition_by).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._loamstone_path = path
    return back


def materialise_sorted(df: DataFrame, label: str, keys: tuple[str, ...], buckets: int, **options: str) -> DataFrame:
    """Write df as a table of `buckets` sorted files, dealt by a hash of the keys, in the shared folder, and read it back.

    df should come from an aggregate or join by the keys, in as many shuffle
    partitions, so that each bucket is one file. A merge join or an aggregate by the
    keys then reads such tables without an exchange, and inside sorted_reads() without a sort.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{name}"
    df.write.options(**options).bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    back = spark.table(name)
    back._loamstone_path, back._loamstone_table = path, name
    return back


@contextlib.contextmanager
def sorted_reads(spark: SparkSession):
    """While this is open, plans rely on the order inside bucket files."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(*frames: DataFrame) -> None:
    """Delete what was materialised for these frames; other frames are left alone."""
    for df in frames:
        if table := getattr(df, "_loamstone_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        path = getattr(df, "_loamstone_path", None)
        if path:
            _delete(*_files(df.sparkSession), path)


def fits(df: DataFrame, rows: int, size: Column | None = None) -> bool:
    """Whether df, which must be materialised, has at most so many rows and, by the size of each, BROADCAST_BYTES bytes."""
    found = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.lit(16) if size is None else size), F.lit(0)).alias("bytes")).first()
    return found["n"] <= rows and found["bytes"] <= BROADCAST_BYTES


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: the optimizer would else inline it into every lambda that uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_fold(text: Column) -> Column:
    """An injective image of text with A-Z lower-cased and every other character kept.

    The UTF-8 bytes are read as Latin-1 characters and lower-cased. That maps
    lead bytes C0-DE to E0-FE, which stays injective as the number of
    continuation bytes tells the two apart, so two images are equal exactly
    if the texts are equal but for the case of A-Z. Only hashes and
    comparisons of it are meaningful; it is far cheaper than translate().
    """
    return F.lower(F.decode(text.cast("binary"), "ISO-8859-1"))


def unit_hash(*cols: Column) -> Column:
    """A uniform double in (0, 1) that depends on the values of cols alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) * F.lit(2.0**-53)
