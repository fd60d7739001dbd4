"""Intermediate tables in the folder that the cluster shares.

``spark.checkpoint.dir`` names the folder; only where it is unset and Spark runs on this machine alone, as in tests, a
temporary one is made.  A settled table cuts the lineage: its rows survive the executors that computed them, and
nondeterministic expressions below it are evaluated once.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URL; a folder of this machine only if there are no other machines."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"file://{tempfile.mkdtemp(prefix='graphwright-')}"
    return _own[app]


def delete(spark: SparkSession, path: str) -> None:
    """Removes a settled table."""
    if spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Spark's setting that deletes a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files when they end: nothing reads them again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Folder:
    """A new folder in the shared one; ``drop`` removes it when nothing needs it any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/graphwright-{uuid.uuid4().hex}"
        _paths.append(self)

    def drop(self) -> None:
        if self in _paths:
            _paths.remove(self)
            delete(self.spark, self.path)


class Settled(Folder):
    """A table written to a folder; ``df`` reads it again."""

    def __init__(self, df: DataFrame, spark: SparkSession | None = None, counted: bool = False, observed: dict[str, Column] | None = None):
        super().__init__(spark or df.sparkSession)
        wanted = (observed or {}) | ({"n": F.count(F.lit(1))} if counted else {})
        seen = Observation() if wanted else None
        rows = df.observe(seen, *[x.alias(name) for name, x in wanted.items()]) if wanted else df
        with own_shuffles(self.spark):
            rows.write.parquet(self.path)
        #: Aggregates of the rows as they were written, and their number.
        self.seen = seen.get if wanted else {}
        self.rows = self.seen.get("n")
        self.df = self.spark.read.schema(df.schema).parquet(self.path)


@contextlib.contextmanager
def lifetime() -> Iterator[list[Folder]]:
    """Settled tables that are made inside are dropped at the end, but for those put in the list; what is lazy must have been written by then."""
    before, kept = set(_paths), []
    try:
        yield kept
    finally:
        for x in [x for x in _paths if x not in before and x not in kept]:
            x.drop()


#: Bytes of an Arrow batch between the JVM and Python, where the session leaves Spark's default of 64 MB.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that rows with long texts don't add up in a worker's memory; for a session's owner to call."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("bB") == str(64 << 20):
        spark.conf.set(key, BATCH_BYTES)


#: Steps of a plan that cost no more when they are repeated than what they read.
_CHEAP = ["Project", "Filter", "SubqueryAlias", "Union", "LocalRelation", "LogicalRelation", "Relation", "Range", "LogicalRDD"]


def _steps(plan) -> Iterator[str]:
    yield plan.getClass().getSimpleName()
    for i in range(plan.children().size()):
        yield from _steps(plan.children().apply(i))


def stable(df: DataFrame) -> DataFrame:
    """The frame itself if it only reads, filters and projects; else settled, for loops that read it again and again."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return df if all(x in _CHEAP for x in _steps(plan)) else Settled(df).df


_paths: list[Folder] = []


@atexit.register
def _clean() -> None:
    for x in list(_paths):
        try:
            x.drop()
        except Exception:  # noqa: BLE001  the session may have ended before
            return
