"""Which landed files an update must read: a list of those already loaded.

A load notes each file it read with its size, its time of change, its last date
and its unreadable dates. An unchanged file that ends before the window to be
loaded has nothing for it and is not opened. If no file changed, came or went and
the window starts no earlier than the last one did, that load took the same rows
and nothing is read. What the store shows is the same as after reading all.

The list of folders comes from the file system; no content is read for it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from .count_files import CSV_NAMES, plain_path
from .store import read_or_empty

LIST_SCHEMA = (
    "run int, file string, size bigint, changed timestamp, "
    "last_date date, unread bigint, since date, source string"
)


@dataclass(frozen=True)
class Pending:
    """Files to read for a load, and the listing to note once it is done."""

    files: list[str]
    listing: DataFrame
    source: str
    since: date | None
    run: int


def pending(
    spark: SparkSession, root: str, source: str, paths: str | Iterable[str], since: date | None
) -> Pending | None:
    """What a load of ``source`` from ``since`` on has to read; None if nothing new landed."""
    log = _noted(spark, root, source)
    last = log.orderBy(F.desc("run")).select("run", "since").first()
    present = listed(spark, paths)
    compared = present.join(_newest(log), "file", "full_outer")
    gone = F.col("size").isNull()
    same = F.coalesce(
        (F.col("size") == F.col("known_size")) & (F.col("changed") == F.col("known_changed")),
        F.lit(False),
    )
    # a forgotten file is noted without a size
    differs = F.when(gone, F.col("known_size").isNotNull()).otherwise(~same)
    reaches = F.lit(since is None) | (F.col("unread") > 0)
    if since is not None:
        reaches = reaches | F.coalesce(F.col("last_date") >= F.lit(since), F.lit(False))
    # only files to be opened, and those that went, come to the driver
    rows = (
        compared.select("file", gone.alias("gone"), differs.alias("differs"),
                        (~gone & (~same | reaches)).alias("needed"))
        .where("needed or differs")
        .collect()
    )
    if last and not any(row.differs for row in rows) and _covers(last.since, since):
        return None
    files = sorted(plain_path(row.file) for row in rows if row.needed)
    listing = compared.where(differs | (~gone & reaches)).select("file", "size", "changed")
    return Pending(files, listing, source, since, last.run + 1 if last else 1)


def note(spark: SparkSession, root: str, load: Pending, staged: DataFrame | None) -> None:
    """Write down the files of a finished load; ``staged`` has its rows with their ``file``.

    Rows before the window were left out of ``staged``: a file without any other
    ends the day before at the latest.
    """
    before = F.date_sub(F.lit(load.since).cast("date"), 1)
    entries = load.listing
    if staged is None:
        read = spark.createDataFrame([], "file string, last_date date, unread bigint")
    else:
        read = staged.groupBy("file").agg(
            F.max("date").alias("last_date"), F.count_if(F.col("date").isNull()).alias("unread")
        )
    (
        entries.join(read, "file", "left")
        .select(
            F.lit(load.run).alias("run"),
            "file",
            "size",
            "changed",
            F.coalesce("last_date", before).alias("last_date"),
            F.coalesce("unread", F.lit(0)).alias("unread"),
            F.lit(load.since).cast("date").alias("since"),
        )
        .write.mode("append")
        .parquet(f"{root}/files/source={load.source}")
    )


def listed(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """Landed CSV files with size and time of change, as the file system tells them."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", CSV_NAMES)
        .load([paths] if isinstance(paths, str) else list(paths))
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_modification_time").alias("changed"),
        )
    )


def _noted(spark: SparkSession, root: str, source: str) -> DataFrame:
    return read_or_empty(spark, f"{root}/files", LIST_SCHEMA).where(F.col("source") == source)


def _newest(log: DataFrame) -> DataFrame:
    """What is known of each file from the last load that noted it."""
    entry = F.struct("size", "changed", "last_date", "unread")
    newest = log.groupBy("file").agg(F.max_by(entry, "run").alias("entry"))
    return newest.select(
        "file",
        F.col("entry.size").alias("known_size"),
        F.col("entry.changed").alias("known_changed"),
        "entry.last_date",
        "entry.unread",
    )


def _covers(earlier: date | None, since: date | None) -> bool:
    """Whether a window from ``earlier`` on holds the one from ``since`` on (None: all)."""
    return earlier is None or (since is not None and since >= earlier)
