"""Session-bound helpers: the shared folder, tables that cut lineage, counting rows."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where the session names none and its master is local (tests) a
    temporary folder is made; on a cluster a folder must be named.
    """
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="vaultlens-")
        spark.conf.set("spark.checkpoint.dir", own)
    return own.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage like checkpoint(), survives the loss of executors and,
    other than a row checkpoint, keeps column pruning and filters on files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vaultlens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(df_or_path: DataFrame | str) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    paths = [df_or_path] if isinstance(df_or_path, str) else df_or_path.inputFiles()
    for spark, path in list(_written):
        if any(path.split("://")[-1] in p for p in paths):
            _delete(spark, path)
            _written.remove((spark, path))


@contextmanager
def scratch() -> Iterator[None]:
    """Delete at its end the tables that materialize() writes within: for sessions that live long, once results are taken."""
    before = len(_written)
    try:
        yield
    finally:
        for spark, path in _written[before:]:
            _delete(spark, path)
        del _written[before:]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path of any file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone; the folder's owner cleans up
        pass


@atexit.register
def _cleanup() -> None:
    for spark, path in _written:
        _delete(spark, path)


def counting_rows(df: DataFrame, key: str, time: str) -> DataFrame:
    """Of each key the row with the latest time; rows without a key are dropped.

    Rows equal in key and time are equal throughout, so any of them serves. A
    null time is older than any other. row_number() = 1 plans a limit per key
    before the shuffle, so a key with very many copies sends one row per task.
    """
    n = "__rank_of_key"
    w = Window.partitionBy(key).orderBy(F.col(time).desc_nulls_last())
    return df.where(F.col(key).isNotNull()).withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session, so that their Python need not have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        base = os.path.join(tempfile.mkdtemp(prefix="vaultlens-"), "vaultlens")
        with zipfile.ZipFile(base + ".zip", "w") as z:
            for at, _, names in os.walk(os.path.join(root, "vaultlens")):
                for n in names:
                    if n.endswith(".py"):
                        z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), root))
        spark.sparkContext.addPyFile(base + ".zip")
        _shipped.add(app)


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """df with a running number from 0 in the given order, without a task that sees all rows.

    Rows are sorted by range, each range is numbered by itself, and the counts
    of the ranges before it, a row per range, are added.
    """
    at = F.monotonically_increasing_id()
    s = df.orderBy(*order).withColumns({"__range": F.shiftright(at, 33), "__nth": at.bitwiseAND(F.lit((1 << 33) - 1))})
    s = materialize(s, "numbered")
    before = F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = s.groupBy("__range").count().select("__range", before.alias("__before"))
    return s.join(F.broadcast(start), "__range").withColumn(name, F.col("__nth") + F.col("__before")).drop("__range", "__nth", "__before")
