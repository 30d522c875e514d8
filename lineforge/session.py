"""Session settings and the shared folder that written intermediates go to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MAX_FIELDS = "spark.sql.codegen.maxFields"
FUSED_FIELDS = 40


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting within the block; afterwards it is what it was."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Settings for what is written within the block.

    Shuffle files go as soon as their rows are written; otherwise they stay until the driver
    happens to collect its garbage, and a job of many writes has the shuffles of all of them
    on disk. Rows of more than ``FUSED_FIELDS`` columns don't get one generated method for
    all operators of a stage: to compile it takes some 300 MB beside an executor's heap.
    """
    with setting(spark, SHUFFLE_CLEANUP, "true"), setting(spark, MAX_FIELDS, str(FUSED_FIELDS)):
        yield


def build_session(app: str = "lineforge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Shuffle width, executor memory and the shared folder belong to the cluster
    and are left to its defaults unless passed in ``conf``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Failing that, the checkpoint directory the application has set. Only a local
    session may run without either; it then gets a temporary folder, which serves as
    its checkpoint directory from then on.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="lineforge-"))
    return context.getCheckpointDir()


def drop_runs(spark: SparkSession, older_than_hours: float = 48.0) -> list[str]:
    """Delete written intermediates older than that; returns their names.

    Frames built on them can't be read afterwards, so this is for a time when no job of
    that age runs any more.
    """
    paths = spark._jvm.org.apache.hadoop.fs
    root = paths.Path(f"{shared_dir(spark)}/lineforge")
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    limit = spark._jvm.java.lang.System.currentTimeMillis() - older_than_hours * 3_600_000
    gone = [s.getPath() for s in system.listStatus(root) if s.getModificationTime() <= limit]
    for path in gone:
        system.delete(path, True)
    return sorted(path.getName() for path in gone)


def constant_rows(spark: SparkSession, rows: Sequence[Sequence[str]], *names: str) -> DataFrame:
    """A few rows of texts as constants of the plan.

    Rows handed over by ``createDataFrame`` pass Python workers on the executors, which stay
    there and take memory as long as the application runs.
    """
    made = [F.struct(*(F.lit(value).alias(name) for name, value in zip(names, row, strict=True))) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*made)))


def run_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared one; never reused, so nothing is overwritten."""
    return f"{shared_dir(spark)}/lineforge/{purpose}-{uuid.uuid4().hex}"
