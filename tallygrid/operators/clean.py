"""Quality gate, duplicates and conflicts of freshly read counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..fixed import BAD_SAMPLE_ROWS, MAX_BAD_SHARE
from ..sources.schemas import COUNT_KEYS


def is_valid() -> Column:
    """All four values present, an hour of the day, a count of zero or more."""
    return F.coalesce(
        F.col("sensor_id").isNotNull()
        & F.col("date").isNotNull()
        & F.col("hour").between(0, 23)
        & (F.col("count") >= 0),
        F.lit(False),
    )


def quality_counts(staged: DataFrame) -> DataFrame:
    """One row: rows read and rows that fail the validity rule."""
    return staged.agg(
        F.count("*").alias("total_rows"), F.count_if(~is_valid()).alias("bad_rows")
    )


def check_quality(staged: DataFrame, source: str, limit: float = MAX_BAD_SHARE) -> int:
    """Raise when more than ``limit`` of the rows are bad; returns the rows read."""
    total, bad = quality_counts(staged).first()
    if total and bad / total > limit:
        sample = staged.where(~is_valid()).take(BAD_SAMPLE_ROWS)
        raise ValueError(
            f"More than {limit:.0%} of {source} rows failed to parse "
            f"({bad} of {total}), for example: {sample}"
        )
    return total


def keys_with_extremes(staged: DataFrame) -> DataFrame:
    """Per sensor and hour the least and greatest count, of valid rows and of all rows.

    With only extremes to keep, repeats of a hot key are merged before the
    shuffle. Invalid rows enter the grouping without a count instead of being
    filtered: a filter would move below the casts and parse every text twice.
    """
    usable = F.when(is_valid(), F.col("count"))
    return staged.groupBy(*COUNT_KEYS).agg(
        F.min(usable).alias("lowest"),
        F.max(usable).alias("highest"),
        F.min("count").alias("any_lowest"),
        F.max("count").alias("any_highest"),
    )


def agreed(keys: DataFrame) -> DataFrame:
    """The keys whose valid rows agree, with their count."""
    return keys.where(F.col("lowest") == F.col("highest")).select(
        *COUNT_KEYS, F.col("lowest").alias("count")
    )


def conflicts() -> list[Column]:
    """Number and dates of the keys with differing counts, as aggregates over all keys."""
    differs = F.col("any_lowest") != F.col("any_highest")
    return [
        F.count_if(differs).alias("keys"),
        F.min(F.when(differs, F.col("date"))).alias("first_date"),
        F.max(F.when(differs, F.col("date"))).alias("last_date"),
    ]


def one_per_key(staged: DataFrame) -> DataFrame:
    """Valid rows, one per sensor and hour.

    Equal repeats collapse; a key with differing counts is dropped whole.
    """
    return agreed(keys_with_extremes(staged))


def conflict_report(staged: DataFrame) -> DataFrame:
    """One row: keys with differing counts and the dates they span.

    Looks at every row with a count, valid or not.
    """
    return keys_with_extremes(staged).agg(*conflicts())


def one_per_key_observed(staged: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows of ``one_per_key``, and the conflict report taken while they are computed.

    The batch is shuffled once; the report is there after the first action on
    the rows.
    """
    report = Observation()
    return agreed(keys_with_extremes(staged).observe(report, *conflicts())), report
