"""Connected components of a table of links, by alternating stars.

Each round ties every node's larger neighbours to its smallest one, then its
smaller ones. Trees become stars in a logarithmic number of rounds. A node with
very many links is summed map-side and its links stay rows: none is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..session import written


def _least(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v"), F.col("u")))
    near = both.join(_least(both), "u").where(F.col("v") > F.col("u"))
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.union(own).where("u != v").distinct()


def _held(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links, written, and a count and checksum taken while writing."""
    seen = Observation()
    checked = links.observe(
        seen,
        F.count(F.lit(1)).alias("n"),
        F.sum(F.shiftright(F.xxhash64("u", "v"), 24)).alias("s"),
    )
    return written(checked, "links"), (seen.get["n"], seen.get["s"])


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, label`` of every node that has a link; ``label`` is the smallest node reachable."""
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    held, state = _held(pairs.where("u != v").distinct())
    before = None
    while state[0] and state != before:
        before = state
        held, state = _held(small_star(large_star(held)))
    stars = held.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.union(stars.select("label", "label").distinct())
