"""Session helpers: the shared folder for staged tables and reliable checkpoints."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
#: Deletes an execution's shuffle files when it ends; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CLEANING: dict[str, list] = {}
_LOCK = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a ``local`` session without that setting gets a temporary folder; on a cluster the
    setting is required, because a machine-local folder does not survive an executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        folder = tempfile.mkdtemp(prefix="eventide-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_DIRS[app] = folder
    return _LOCAL_DIRS[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/eventide/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Executions that begin inside delete their shuffle files at their end; several threads may be inside."""
    name = spark._jsparkSession.sessionUUID()
    with _LOCK:
        inside = _CLEANING.setdefault(name, [0, None])
        if inside[0] == 0:
            inside[1] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        inside[0] += 1
    try:
        yield
    finally:
        with _LOCK:
            inside[0] -= 1
            if inside[0] == 0:
                spark.conf.unset(_CLEANUP) if inside[1] is None else spark.conf.set(_CLEANUP, inside[1])


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a columnar table and read it back.

    Used where several later passes need the same rows: it cuts the lineage, survives the loss
    of executors, keeps column pruning and gives the optimizer real table sizes, so that AQE
    decides between broadcast and shuffle joins on facts. What was shuffled for it goes when it is written.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with _shuffles_deleted(spark):
        df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


def release(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: whatever was made from them must be staged itself."""
    for df in staged:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
