"""Raw count files in either published layout as typed rows."""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Iterable
from functools import reduce
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..fixed import ARCHIVE_COLUMNS, PORTAL_COLUMNS
from ..functions.text import archive_timestamp, lenient_int, normal_name

LAYOUTS = (PORTAL_COLUMNS, ARCHIVE_COLUMNS)
CSV_NAMES = "*.[cC][sS][vV]"
# no normalised column name starts with an underscore and ends in a space
FILE = "_file "


def read_count_files(
    spark: SparkSession, paths: str | Iterable[str], with_file: bool = False
) -> DataFrame:
    """Typed (sensor_id, date, hour, count) rows of all CSV files under ``paths``.

    Unreadable values become NULL; ``operators.clean`` judges them. ``with_file``
    adds the URI of each row's file as ``file``.
    """
    return typed_counts(read_as_text(spark, paths, with_file))


def read_as_text(
    spark: SparkSession, paths: str | Iterable[str], with_file: bool = False
) -> DataFrame:
    """All files as text columns under normalised names, united by name.

    A CSV scan binds columns by position, so files are read per header: one
    scan for each distinct column order, never one per file.
    """
    by_header = _files_by_header(spark, [paths] if isinstance(paths, str) else list(paths))
    needed = {name for layout in LAYOUTS for name in layout}
    parts = []
    for header, files in by_header.items():
        names = _unique(normal_name(name) for name in header)
        schema = ", ".join(f"`{name}` string" for name in names)
        rows = spark.read.schema(schema).option("header", True).option("escape", '"').csv(files)
        file = [F.col("_metadata.file_path").alias(FILE)] if with_file else []
        parts.append(rows.select(*[name for name in names if name in needed], *file))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def typed_counts(text: DataFrame) -> DataFrame:
    """Pick the layout by its columns and cast; the first layout that fits wins."""
    columns = {normal_name(name): name for name in text.columns if name != FILE}
    file = [F.col(FILE).alias("file")] if FILE in text.columns else []
    if set(PORTAL_COLUMNS) <= columns.keys():
        sensor, day, hour, count = (F.col(columns[name]) for name in PORTAL_COLUMNS)
        return text.select(
            lenient_int(sensor).alias("sensor_id"),
            _iso_date(day).alias("date"),
            lenient_int(hour, "tinyint").alias("hour"),
            lenient_int(count).alias("count"),
            *file,
        )
    if set(ARCHIVE_COLUMNS) <= columns.keys():
        sensor, moment, count = (F.col(columns[name]) for name in ARCHIVE_COLUMNS)
        # two steps, so that the text is parsed once for both date and hour
        stamped = text.select(
            lenient_int(sensor).alias("sensor_id"),
            archive_timestamp(moment).alias("stamp"),
            lenient_int(count).alias("count"),
            *file,
        )
        return stamped.select(
            "sensor_id",
            F.to_date("stamp").alias("date"),
            F.hour("stamp").cast("tinyint").alias("hour"),
            "count",
            *[F.col("file") for _ in file],
        )
    raise _unrecognised(columns, text.inputFiles())


def _files_by_header(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files grouped by header line, found in one distributed scan.

    Only lines naming every column of a layout are kept, so a handful of rows
    per file reaches the aggregation. Hidden files and folders (leading '.' or
    '_') are already skipped by the file source.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", CSV_NAMES)
        .text(paths)
    )
    files = [plain_path(uri) for uri in lines.inputFiles()]
    if not files:
        raise RuntimeError(f"No CSV files found in {', '.join(paths)}")
    plain = F.lower("value")
    squeezed = F.regexp_replace(plain, "[^a-z0-9]+", "_")
    # the first word of a name is in its header as it stands: rows of counts never reach the pattern
    is_header = reduce(
        lambda a, b: a | b,
        [
            reduce(lambda a, b: a & b, [
                *[plain.contains(c.split("_")[0]) for c in layout],
                *[squeezed.contains(c) for c in layout],
            ])
            for layout in LAYOUTS
        ],
    )
    headers = (
        lines.where(is_header)
        .select(
            F.col("_metadata.file_path").alias("file"),
            "value",
            F.monotonically_increasing_id().alias("position"),
        )
        .groupBy("file")
        .agg(F.min_by("value", "position").alias("header"))
        .collect()
    )
    by_header = defaultdict(list)
    for row in headers:
        by_header[tuple(next(csv.reader([row.header.lstrip("﻿")])))].append(plain_path(row.file))
    known = {file for group in by_header.values() for file in group}
    unknown = sorted(set(files) - known)
    if unknown:
        first = spark.read.text(unknown[0]).head(1)
        names = next(csv.reader([first[0].value])) if first else []
        raise _unrecognised([normal_name(name) for name in names], unknown)
    return {header: sorted(group) for header, group in by_header.items()}


def plain_path(uri: str) -> str:
    """One spelling for a file's URI: 'file:/a%20b' and 'file:///a b' are the same."""
    parts = urlsplit(uri)
    return unquote(f"{parts.scheme}://{parts.netloc}{parts.path}")


def _iso_date(text: Column) -> Column:
    # a bare year or year-month would otherwise be read as its first day
    day = F.replace(F.trim(text), F.lit("/"), F.lit("-"))
    return F.when(day.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), day.try_cast("date"))


def _unique(names: Iterable[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for name in names:
        seen[name] = seen.get(name, -1) + 1
        out.append(name if not seen[name] else f"{name}_{seen[name]}")
    return out


def _unrecognised(columns: Iterable[str], files: Iterable[str]) -> ValueError:
    names = [file.rsplit("/", 1)[-1] for file in files]
    return ValueError(
        f"Unrecognised counts file format, columns: {', '.join(sorted(columns))}; "
        f"files: {', '.join(names)}"
    )
