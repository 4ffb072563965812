"""Session set-up and the shared folder for tables that cut lineage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}
_shipped: set[str] = set()


def session(app: str = "tallygrid", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the results rely on (UTC, adaptive execution).

    On a cluster, name a shared folder in ``spark.checkpoint.dir`` and start
    shuffles wide (``spark.sql.adaptive.coalescePartitions.initialPartitionNum``
    of some ten thousand for 100 TB): adaptive execution merges what is small,
    but cannot split a plain aggregation that started too narrow.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder; a cluster
    without it is an error, because a folder of one machine is lost with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="tallygrid-")
    return _local_folders[app]


def checkpoint_ready(spark: SparkSession) -> None:
    """Let iterative fits cut their lineage in the shared folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        base = Path(tempfile.mkdtemp(prefix="tallygrid-py-")) / package.name
        spark.sparkContext.addPyFile(
            shutil.make_archive(str(base), "zip", package.parent, package.name)
        )
        _shipped.add(app)


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The copy outlives executors and keeps column and partition pruning, so it
    serves where one result feeds several jobs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
