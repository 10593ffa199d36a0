"""Session settings and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

PREFIX = "gridspark-cut-"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWNER: ContextVar[Cuts | None] = ContextVar("gridspark_cuts", default=None)


class Cuts:
    """Owner of the tables that :func:`cut` stores inside its ``with`` block.

    Leaving the block deletes nothing, as results are lazy; :meth:`clear` deletes this owner's
    tables and no others. Tables stored outside any block stay in the shared folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self._token = spark, [], None

    def __enter__(self) -> Cuts:
        self._token = _OWNER.set(self)
        return self

    def __exit__(self, *_) -> None:
        _OWNER.reset(self._token)

    def clear(self) -> int:
        """Delete the tables, once their results are used; returns how many there were."""
        sc, n = self.spark.sparkContext, len(self.paths)
        while self.paths:
            p = sc._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        return n


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "gridspark", checkpoint_dir: str | None = None) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session.

    ``checkpoint_dir``: the shared folder; a new scratch folder where none is given.
    """
    return (
        SparkSession.builder.master(master)
        .config("spark.checkpoint.dir", checkpoint_dir or tempfile.mkdtemp(prefix="spark-"))
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a scratch folder serves a session in local mode; on a cluster a
    machine-local folder would be lost with its node, so the setting is required there.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if named:
        if not current.isDefined():
            sc.setCheckpointDir(named)
        return named
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    root = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(root)
    return root


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside the block take their shuffles off the disks, instead of when the JVM happens to collect them."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, release: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends at a stored table, so the loss of an executor replays
    nothing and a range slice or a loop round is never computed anew. The plan's
    size estimate restarts from the real file sizes, which keeps long loops cheap
    to plan. With ``release`` the shuffles of the write leave the disks with its end.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{PREFIX}{uuid.uuid4().hex}"
    with released(spark) if release else nullcontext():
        df.write.parquet(path)
    if (owner := _OWNER.get()) is not None:
        owner.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)
