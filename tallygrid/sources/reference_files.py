"""Sensors, weather payloads and the calendar's reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..fixed import EVENT_DAYS, SCHOOL_TERMS
from ..functions.text import normal_name
from . import schemas


def read_sensors(spark: SparkSession, path: str) -> DataFrame:
    """Sensor locations as published: inferred types, normalised names."""
    rows = spark.read.csv(path, header=True, inferSchema=True, escape='"')
    return rows.toDF(*[normal_name(name) for name in rows.columns])


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    return _dated_csv(spark, path, schemas.TERMS)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return _dated_csv(spark, path, schemas.EVENTS)


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    return _dated_csv(spark, path, schemas.HOLIDAYS)


def _dated_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    # Columns beyond the schema (source, note) are never parsed; binding is by
    # header name because the columns are text first.
    text = spark.read.csv(path, header=True)
    return text.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def known_terms(spark: SparkSession) -> DataFrame:
    """The published school terms of 2024-2027."""
    return _dated_rows(spark, SCHOOL_TERMS, schemas.TERMS)


def known_events(spark: SparkSession) -> DataFrame:
    """The event days of 2024-2026."""
    return _dated_rows(spark, EVENT_DAYS, schemas.EVENTS)


def _dated_rows(spark: SparkSession, rows, schema) -> DataFrame:
    text = spark.createDataFrame([tuple(map(str, row)) for row in rows], schema.names)
    return text.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def read_weather_payload(spark: SparkSession, path: str) -> DataFrame:
    """Weather responses as saved: one JSON document per file."""
    return spark.read.schema(schemas.WEATHER_PAYLOAD).json(path, multiLine=True)
