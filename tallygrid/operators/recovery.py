"""Then-vs-now regression on log sensor-days, fitted with grouped sums.

The model is ``ln(total) ~ sensor + month + weekday x period`` with standard
errors clustered by week. Sensor terms are removed by working with deviations
from each sensor's mean, which leaves 24 columns however many sensors there
are; coefficients and clustered errors of those columns are the same as in the
full model. Everything that grows with the data is a ``groupBy`` in Spark; the
24 x 24 solve runs per fit inside ``mapInPandas``.

Many fits (time windows, sensor groups, single sensors) go through the same
jobs: they are just values of the ``fit`` column.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from math import erfc, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..fixed import DAY_GROUPS, NORMAL_95, REFERENCE_WEEKDAY, WEEKDAYS
from ..functions.joins import broadcast_up_to
from ..params import Params
from ..session import ship_package, written

MONTHS = tuple(range(2, 13))
OTHER_DAYS = tuple(d for d in WEEKDAYS if d != REFERENCE_WEEKDAY)
TERMS = (
    *[f"month:{m}" for m in MONTHS],
    *[f"dow:{d}" for d in OTHER_DAYS],
    "recent",
    *[f"recent:{d}" for d in OTHER_DAYS],
)
WIDTH = len(TERMS)
CELL = ["fit", "sensor_id", "month", "dow", "period"]


def design_flags(params: Params) -> list[str]:
    """SQL conditions of the 24 indicator columns, in the order of ``TERMS``."""
    recent = f"period <> '{params.base_label}'"
    day = [f"dow = '{d}'" for d in OTHER_DAYS]
    return [
        *[f"month = {m}" for m in MONTHS],
        *day,
        recent,
        *[f"({recent} AND {is_day})" for is_day in day],
    ]


def design_vector(params: Params) -> Column:
    """The indicators as an array of 0.0 / 1.0."""
    flags = [f"CAST({flag} AS DOUBLE)" for flag in design_flags(params)]
    return F.expr(f"array({', '.join(flags)})")


def observations(days: DataFrame, fits: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Rows per fit: ``fits`` maps a name to its window column and row condition.

    One pass over the sensor-days: each row lists the fits it belongs to.
    Totals of zero have no logarithm and drop out.
    """
    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    condition & (F.col(window) > 0),
                    F.struct(F.lit(name).alias("fit"), F.ln(window).alias("y")),
                )
                for name, (window, condition) in fits.items()
            ]
        )
    )
    return days.withColumn("_entry", F.explode(entries)).select(
        F.col("_entry.fit").alias("fit"),
        "sensor_id",
        "month",
        "dow",
        "period",
        "week",
        F.col("_entry.y").alias("y"),
    )


def per_sensor_observations(days: DataFrame, window: str) -> DataFrame:
    """One fit per sensor, for however many sensors there are."""
    return days.where(F.col(window) > 0).select(
        F.col("sensor_id").cast("string").alias("fit"),
        "sensor_id",
        "month",
        "dow",
        "period",
        "week",
        F.ln(window).alias("y"),
    )


def weekly_cells(obs: DataFrame) -> DataFrame:
    """Rows and sum of logs per fit, sensor, month, weekday, period and week.

    All later sums start from these.
    """
    return obs.groupBy(*CELL, "week").agg(
        F.count("*").cast("double").alias("n"), F.sum("y").alias("sy")
    )


def sensor_sums(weekly: DataFrame, params: Params) -> DataFrame:
    """Per fit and sensor: rows, sum of logs and the sums of the 24 indicators."""
    return weekly.groupBy("fit", "sensor_id").agg(
        F.sum("n").alias("n"),
        F.sum("sy").alias("sy"),
        F.expr(
            "array("
            + ", ".join(f"sum(IF({flag}, n, 0D))" for flag in design_flags(params))
            + ")"
        ).alias("sz"),
    )


# places of a packed sum: the upper triangle, and the right-hand side as column ``WIDTH``
PACKED = np.triu_indices(WIDTH, 0, WIDTH + 1)


def packed_sums(rows: DataFrame) -> DataFrame:
    """Per fit, the sum over its rows of ``w * v_i * v_j`` and ``w * v_i * value``.

    ``rows`` are (fit, v, value, w). Each Arrow batch gives one array of fixed
    length per fit, in the order of ``PACKED``; the arrays add up map-side.
    """
    ship_package(rows.sparkSession)
    partial = rows.select("fit", "v", "value", "w").mapInArrow(
        _outer, "fit string, sums array<double>"
    )
    whole = Summarizer.sum(array_to_vector("sums"))
    return partial.groupBy("fit").agg(vector_to_array(whole).alias("sums"))


def _outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, names = pd.factorize(batch.column("fit").to_pandas(), use_na_sentinel=False)
        v = batch.column("v").flatten().to_numpy().reshape(-1, WIDTH)
        value, weight = (batch.column(name).to_numpy() for name in ("value", "w"))
        right, left = np.column_stack([v, value]), v * weight[:, None]
        order = np.argsort(codes, kind="stable")
        ends = np.searchsorted(codes[order], np.arange(1, len(names)))
        sums = [(left[own].T @ right[own])[PACKED] for own in np.split(order, ends)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(sums, pa.list_(pa.float64()))], ["fit", "sums"]
        )


def packed_equations(weekly: DataFrame, sums: DataFrame, params: Params) -> DataFrame:
    """Within-sensor Gram matrix and right-hand side per fit, packed.

    Sum over cells minus the sensors' own means. Without sensor and week a fit
    has at most 168 cells, so only those go to Python.
    """
    cells = weekly.groupBy("fit", "month", "dow", "period").agg(
        F.sum("n").alias("n"), F.sum("sy").alias("sy")
    )
    raw = cells.select(
        "fit", design_vector(params).alias("v"), (F.col("sy") / F.col("n")).alias("value"), F.col("n").alias("w")
    )
    means = sums.select(
        "fit", F.col("sz").alias("v"), F.col("sy").alias("value"), (-1 / F.col("n")).alias("w")
    )
    return packed_sums(raw.unionByName(means))


def normal_equations(weekly: DataFrame, sums: DataFrame, params: Params) -> DataFrame:
    """The same as one row per entry (fit, i, j, x): ``j = 24`` is the right-hand side."""
    places = [F.array(*[F.lit(int(n)) for n in side]) for side in PACKED]
    listed = packed_equations(weekly, sums, params).select("fit", F.posexplode("sums").alias("n", "x"))
    i, j = (F.get(side, F.col("n")) for side in places)
    return listed.select("fit", i.alias("i"), j.alias("j"), "x")


def coefficients(equations: DataFrame) -> DataFrame:
    """Solve each fit's packed sums: coefficients and the inverse Gram matrix (flattened)."""
    ship_package(equations.sparkSession)
    return equations.mapInPandas(_solve, "fit string, beta array<double>, inverse array<double>")


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for fit, sums in zip(batch["fit"], batch["sums"]):
            gram, right = _matrix(sums)
            inverse = np.linalg.pinv(gram, rcond=1e-10, hermitian=True)
            rows.append((fit, (inverse @ right).tolist(), inverse.ravel().tolist()))
        yield pd.DataFrame(rows, columns=["fit", "beta", "inverse"])


def _matrix(sums) -> tuple[np.ndarray, np.ndarray]:
    whole = np.zeros((WIDTH, WIDTH + 1))
    whole[PACKED] = sums
    upper = whole[:, :WIDTH]
    return upper + np.triu(upper, 1).T, whole[:, WIDTH]


def cluster_scores(
    weekly: DataFrame, sums: DataFrame, betas: DataFrame, params: Params
) -> DataFrame:
    """Per fit and week, the sum of (indicator - sensor mean) x residual.

    ``betas`` is a stored table of one row per fit: counted and broadcast while
    fits are few, so that a fit over all sensors is no hot key; as many fits as
    sensors join by shuffle without one.
    """
    solved = broadcast_up_to(betas.select("fit", "beta"), betas.count())
    means = sums.join(solved, "fit").select(
        "fit",
        "sensor_id",
        "beta",
        F.transform("sz", lambda s: s / F.col("n")).alias("mean_z"),
        (F.col("sy") / F.col("n")).alias("mean_y"),
    )
    deviation = F.zip_with(design_vector(params), "mean_z", lambda z, m: z - m)
    fitted = F.aggregate(
        F.zip_with("deviation", "beta", lambda d, b: d * b), F.lit(0.0), lambda a, x: a + x
    )
    return (
        weekly.join(means, ["fit", "sensor_id"])
        .withColumn("deviation", deviation)
        .withColumn("residual", F.col("sy") - F.col("n") * (F.col("mean_y") + fitted))
        .groupBy("fit", "week")
        .agg(
            F.expr(
                f"array({', '.join(f'sum(deviation[{i}] * residual)' for i in range(WIDTH))})"
            ).alias("score")
        )
    )


def fit_sizes(weekly: DataFrame) -> DataFrame:
    """Rows, clusters and model columns per fit, and the levels it has seen."""
    columns = (
        F.col("sensors")
        + (F.size("months") - 1)
        + (F.size("dows") - 1)
        + F.size("dows") * (F.size("periods") - 1)
    )
    return (
        weekly.groupBy("fit")
        .agg(
            F.sum("n").alias("rows"),
            F.countDistinct("sensor_id").alias("sensors"),
            F.countDistinct("week").alias("weeks"),
            F.collect_set("month").alias("months"),
            F.collect_set("dow").alias("dows"),
            F.collect_set("period").alias("periods"),
        )
        .select("fit", "rows", "sensors", "weeks", "dows", "periods", columns.alias("columns"))
    )


def fit_recovery(obs: DataFrame, params: Params) -> DataFrame:
    """One row per fit: coefficients, clustered covariance, sizes.

    The covariance carries the usual finite-sample factor
    G / (G - 1) * (n - 1) / (n - k) with G clusters and k model columns. Cells, sums
    and coefficients are written, as several of the sums start from them.
    """
    weekly = written(weekly_cells(obs), "regression-cells")
    sums = written(sensor_sums(weekly, params), "regression-sums")
    betas = written(
        coefficients(packed_equations(weekly, sums, params)), "regression-coefficients"
    )
    scores = cluster_scores(weekly, sums, betas, params)
    meat = packed_sums(
        scores.select("fit", F.col("score").alias("v"), F.lit(0.0).alias("value"), F.lit(1.0).alias("w"))
    ).withColumnRenamed("sums", "meat")
    return betas.join(meat, "fit").join(fit_sizes(weekly), "fit")


def contrasts(fitted: DataFrame, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Weighted recent-vs-base effects per fit: log estimate, standard error, p-value.

    A contrast over a weekday or period the fit never saw is NULL.
    """
    named = {name: dict(w) for name, w in weights.items()}
    columns = ["fit", "contrast", "estimate", "se", "p", "sensors"]

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for fit in batch.itertuples(index=False):
                inverse = np.asarray(fit.inverse).reshape(WIDTH, WIDTH)
                meat, _ = _matrix(fit.meat)
                free = fit.rows - fit.columns
                scale = (
                    fit.weeks / (fit.weeks - 1) * (fit.rows - 1) / free
                    if fit.weeks > 1 and free > 0
                    else np.nan
                )
                covariance = scale * inverse @ meat @ inverse
                beta = np.asarray(fit.beta)
                for name, w in named.items():
                    seen = len(fit.periods) == 2 and set(w) <= set(fit.dows)
                    vector = _contrast_vector(w)
                    estimate = float(vector @ beta) if seen else None
                    variance = float(vector @ covariance @ vector)
                    error = sqrt(variance) if seen and variance >= 0 else None
                    p = erfc(abs(estimate / error) / sqrt(2)) if error else None
                    rows.append((fit.fit, name, estimate, error, p, int(fit.sensors)))
            yield pd.DataFrame(rows, columns=columns)

    return fitted.mapInPandas(
        evaluate,
        "fit string, contrast string, estimate double, se double, p double, sensors bigint",
    )


def _contrast_vector(weights: Mapping[str, float]) -> np.ndarray:
    vector = np.zeros(WIDTH)
    for day, weight in weights.items():
        vector[TERMS.index("recent")] += weight
        if day != REFERENCE_WEEKDAY:
            vector[TERMS.index(f"recent:{day}")] += weight
    return vector


def saturated_recovery(days: DataFrame, window: str, params: Params) -> DataFrame:
    """Recovery per weekday without sensor and month terms.

    With only weekday x period the model is saturated, so each ratio is the
    quotient of two geometric means.
    """
    is_base = F.col("period") == params.base_label
    log = F.ln(window)
    return (
        days.where(F.col(window) > 0)
        .groupBy("dow")
        .agg(
            F.exp(F.avg(F.when(~is_base, log)) - F.avg(F.when(is_base, log))).alias("ratio"),
            F.count("*").alias("sensor_days"),
        )
    )


def recovery_ratios(contrast_rows: DataFrame) -> DataFrame:
    """Recent level as a share of the base year, with a 95 % interval."""
    reach = NORMAL_95 * F.col("se")
    return contrast_rows.select(
        "fit",
        "contrast",
        F.exp("estimate").alias("ratio"),
        F.exp(F.col("estimate") - reach).alias("low"),
        F.exp(F.col("estimate") + reach).alias("high"),
        "sensors",
    )


def single_days() -> dict[str, dict[str, float]]:
    return {day: {day: 1.0} for day in WEEKDAYS}


def gap_weights() -> dict[str, float]:
    """Monday and Friday against Tuesday to Thursday."""
    edge, middle = DAY_GROUPS["Mon + Fri"], DAY_GROUPS["Tue–Thu"]
    return {**edge, **{day: -weight for day, weight in middle.items()}}


def by_weekday(fitted: DataFrame) -> DataFrame:
    """Recovery of each weekday."""
    return recovery_ratios(contrasts(fitted, single_days())).withColumnRenamed("contrast", "day")


def by_day_group(fitted: DataFrame) -> DataFrame:
    """Recovery of Mon + Fri, Tue-Thu and the weekend."""
    return recovery_ratios(contrasts(fitted, DAY_GROUPS)).withColumnRenamed("contrast", "days")


def monfri_gap(fitted: DataFrame) -> DataFrame:
    """How much further Mon + Fri sit below the base than Tue-Thu, with p-value."""
    rows = contrasts(fitted, {"gap": gap_weights()})
    reach = NORMAL_95 * F.col("se")
    return rows.select(
        "fit",
        (F.exp("estimate") - 1).alias("gap"),
        (F.exp(F.col("estimate") - reach) - 1).alias("low"),
        (F.exp(F.col("estimate") + reach) - 1).alias("high"),
        "p",
        "sensors",
    )
