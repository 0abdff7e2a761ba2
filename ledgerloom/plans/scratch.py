"""Tables written part-way through a plan, in the folder all machines share.

Iterative plans cut their lineage here: a written table survives a lost
executor, which a local checkpoint does not.  The folder is the one the cluster
names in ``spark.checkpoint.dir``; only where that is unset and driver and
executors are one process (tests, a laptop) a folder under the system's
temporary directory is used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OPEN: dict[str, tuple[SparkSession, str]] = {}
#: With this, Spark deletes a query's shuffle files as it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.conf.get("spark.master", "")
    if not named and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or f"file://{tempfile.gettempdir()}/ledgerloom-scratch").rstrip("/")


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The table lives until :func:`release` or the end of the driver, the shuffle
    files of its plan only until it is written.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    _OPEN[path] = (spark, path)
    return back


def release(df: DataFrame | None) -> None:
    """Delete a table made by :func:`materialize`; others are left alone."""
    path = getattr(df, "_scratch_path", None)
    if path in _OPEN:
        _remove(*_OPEN.pop(path))


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in list(_OPEN.values()):
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return
