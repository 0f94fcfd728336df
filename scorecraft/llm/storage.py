"""Intermediate results: kept for several readers, or written to the cluster's
shared checkpoint folder so that what follows has a short plan and lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only where that is unset and all runs
    on one machine (tests) a scratch folder is made."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="llm-checkpoint-"))
    return sc.getCheckpointDir()


_held: list[DataFrame] = []
_written: list[tuple[DataFrame, str]] = []


#: Spark's setting (4.1) that deletes a query's shuffle files when it ends; those below held frames stay.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries inside are deleted as each ends.  Else they stay on disk until
    the driver happens to collect its garbage, on a long run for all its steps together."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: a lost executor
    costs a re-read instead of the whole history, so the shuffle files behind it go.  The
    table ``instead_of``, from an earlier ``cut``, is deleted then."""
    path = f"{ready(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with swept(df.sparkSession):
        df.write.parquet(path)
    if instead_of is not None:
        _delete(instead_of)
    _written.append((df.sparkSession.read.parquet(path), path))
    return _written[-1][0]


def drop_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _delete(table: DataFrame) -> None:
    for frame, path in [w for w in _written if w[0] is table]:
        _written[:] = [w for w in _written if w[0] is not frame]
        drop_folder(frame.sparkSession, path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``make`` written as a table in the shared folder; all that was held and
    written for it is given back.  The table stands until ``release``."""
    before_held, before_written = list(_held), list(_written)
    out = cut(make())
    let_go(*[h for h in _held if not any(h is b for b in before_held)])
    for table, _ in list(_written):
        if table is not out and not any(table is t for t, _ in before_written):
            _delete(table)
    return out


def hold(df: DataFrame) -> DataFrame:
    """``df`` kept for several readers, in memory with spill to disk; lost parts are
    computed again.  Frames that others have unpersisted since (``clearCache``) are forgotten,
    else their plans would stay in the driver's memory."""
    _held[:] = [h for h in _held if h.storageLevel.useMemory or h.storageLevel.useDisk]
    _held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return _held[-1]


def let_go(*frames: DataFrame) -> None:
    """Give back frames of ``hold`` and tables of ``cut`` that nothing reads any more."""
    for df in frames:
        if any(df is t for t, _ in _written):
            _delete(df)
        else:
            _held[:] = [h for h in _held if h is not df]
            df.unpersist()


def release() -> None:
    """Give back all that is held and the tables of ``cut``; results that were not
    written before need them."""
    let_go(*list(_held))
    for table, _ in list(_written):
        _delete(table)
