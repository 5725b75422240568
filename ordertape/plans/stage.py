"""Stage tables: written cuts of a plan in the cluster's shared folder.

A stage table replaces lineage that would otherwise be recomputed (or lost with
an executor). It is plain Parquet below ``spark.checkpoint.dir``, so every
executor can read it and a lost executor loses nothing.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN_KEY = "ordertape.local.checkpoint.dir"
_KEPT: dict[tuple[str, str], DataFrame] = {}  # by application and name
_SWEPT: set[str] = set()
#: While a table is written: the job's shuffle files go as soon as it ends, not when the driver next collects its garbage.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session.

    Only a purely local master may fall back on a folder of its own; on a
    cluster a machine-local folder would be invisible to other executors.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(_OWN_KEY, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="ordertape-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set(_OWN_KEY, f"file://{folder}")
    return f"file://{folder}"


def _home(spark: SparkSession) -> str:
    """The folder of this application's stage tables; it goes when the driver ends."""
    home = f"{shared_dir(spark)}/stages/{spark.sparkContext.applicationId}"
    if home not in _SWEPT:
        _SWEPT.add(home)
        atexit.register(_sweep, spark, home)
    return home


def _sweep(spark: SparkSession, home: str) -> None:
    try:
        delete(spark, home)
    except Exception:  # noqa: BLE001 - the session was stopped before: its owner clears the shared folder
        pass


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_home(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """For jobs that write a table: their shuffle files go when they end."""
    before = spark.conf.get(_CLEANED, None)
    spark.conf.set(_CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANED) if before is None else spark.conf.set(_CLEANED, before)


def put(df: DataFrame, path: str, **options: str) -> None:
    """Write ``df`` in place of what is there; its shuffle files go with the job."""
    with cleaned(df.sparkSession):
        df.write.mode("overwrite").options(**{"compression": "zstd", **options}).parquet(path)


def save(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a stage table and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    put(df, path, **options)
    # the schema is known: no footer is read to infer it, and empty tables keep their columns
    table = spark.read.schema(df.schema).parquet(path)
    table._stage_path = path
    return table


def once(spark: SparkSession, name: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage table that is written at its first use and read again by later plans of the application."""
    at = (spark.sparkContext.applicationId, f"{name} {key}")
    if at not in _KEPT:
        _KEPT[at] = save(build(), name)
    table = _KEPT[at]
    again = spark.read.schema(table.schema).parquet(table._stage_path)
    again._stage_path = table._stage_path
    return again


def held(spark: SparkSession, name: str, key: str) -> bool:
    """Whether :func:`once` has written the table in this application."""
    return (spark.sparkContext.applicationId, f"{name} {key}") in _KEPT


def drop(*tables: DataFrame) -> None:
    """Delete stage tables that no later plan reads."""
    for table in tables:
        path = getattr(table, "_stage_path", None)
        if path is not None:
            delete(table.sparkSession, path)
