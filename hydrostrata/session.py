"""Session construction and the few session settings the operators rely on."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "hydrostrata", master: str | None = None, **conf: object) -> SparkSession:
    """A session with UTC time, AQE and Arrow on; ``conf`` overrides any setting.

    ``master`` is left to the launcher unless given, so the same code runs on a cluster.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's ``spark.checkpoint.dir``.

    Only where no folder is configured at all, as in tests on one machine, a local one is made; it goes with the process.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not (context.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="hydrostrata-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Whether shuffle files go when the query that wrote them has ended, not only when the driver collects garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries built inside drop their shuffle files at their end: for chains of checkpoints, of which none reads a shuffle of another."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)


_STORED: dict[tuple[str, str], dict[str, DataFrame]] = {}


def stored(spark: SparkSession, name: str, build: Callable[[], dict[str, DataFrame]], partitioned: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """The tables of ``build()``, written once a session to the shared folder under ``name`` and read from there.

    ``partitioned`` names the columns by which a table is laid out.
    """
    key = (spark.sparkContext.applicationId, name)
    if key not in _STORED:
        base = f"{shared_folder(spark).rstrip('/')}/{key[0]}-{hashlib.sha256(name.encode()).hexdigest()[:16]}"
        tables = build()
        for table, df in tables.items():
            columns = (partitioned or {}).get(table, [])
            laid = df.repartition(*columns) if columns else df
            laid.write.mode("overwrite").partitionBy(*columns).parquet(f"{base}/{table}")
        _STORED[key] = {table: spark.read.schema(df.schema).parquet(f"{base}/{table}").select(*df.columns) for table, df in tables.items()}
    return _STORED[key]


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` hash-partitioned for work that is heavy per row, so that few bytes do not mean few tasks.

    The number is given, so adaptive execution does not merge the partitions: the session's shuffle
    partitions, and at least two a core. The hash is one of its own, else the planner would take the
    partitioning of an aggregation before it, which adaptive execution does merge.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, F.xxhash64(*columns))
