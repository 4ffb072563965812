"""Voronoi rounds for cells of documents that are too many for one task.

A round takes every such cell at once. Its pivots are documents of the cell,
chosen by hash; they visit every block of the cell, so that all distances to
them are known and their own links are complete. A document within ``FAR`` of a
pivot belongs to the region of its nearest one and visits the others' regions by
the windows of the triangle inequality. Documents farther from all pivots, and
those within the radius of that bound, are one region more: it keeps them from
widening the windows of all others. Documents linked to one pivot, or to pivots that share a
document or a link, are one class and need no comparison with each other: a
region of one class is done. The others are joined again in a next round where
they have become smaller, and by one task where they fit it.

A cell that its pivots do not divide, as the windows cover each other, is
compared in blocks: the documents outside its largest class with all others. With
no more than a block of them, a document is copied twice.

Nothing here is collected: a cell has one row of pivots and of region sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ship_package, written
from .shared import broadcast_if_small
from .text import ShingleSets, released, slices

# per cent of the union that two sets must share; the radius is what is left
SHARED = 75
RADIUS = (100 - SHARED) / 100
# pivots of a cell in one round
CELL_PIVOTS = 12
# distance that documents of a pivot's region have at most, so that their windows
# leave out documents that share nothing with the pivot
FAR = 0.95 - RADIUS
# copies for a document up to which a cell is divided into its regions, and the
# share of the cell that a region may have to be divided again
COPIES = 2
SMALLER = 0.8


def pivots_of(members: DataFrame, block: int) -> DataFrame:
    """``cell, pivots, parts``: the least documents by some hashes, and the blocks of the cell."""
    chosen = [F.min_by("h", F.xxhash64("cell", "h", F.lit(k))) for k in range(CELL_PIVOTS)]
    cells = members.groupBy("cell").agg(
        F.array_distinct(F.array(*chosen)).alias("pivots"),
        F.ceil(F.count("*") / block).cast("int").alias("parts"),
    )
    return broadcast_if_small(cells, "cell-pivots", 128)


def measured(members: DataFrame, texts: DataFrame, block: int) -> DataFrame:
    """Every document of a cell and its distances ``d`` to the cell's pivots.

    ``linked`` are the pivots within the radius, and ``mask`` their positions;
    a pivot has its own. ``nearest`` and ``least`` are of the nearest pivot.
    """
    spark = members.sparkSession
    ship_package(spark)
    cells = pivots_of(members, block)
    part = F.pmod(F.xxhash64("h", F.lit("block")), F.col("parts")).cast("int")
    placed = members.join(cells, "cell").where(~F.array_contains("pivots", F.col("h")))
    placed = placed.select("cell", part.alias("block"), "h", F.lit(-1).alias("pivot"))
    visits = cells.select("cell", "parts", F.posexplode("pivots").alias("pivot", "h")).select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), "h", "pivot"
    )
    rows = placed.unionByName(visits).join(texts, "h").select("cell", "block", "pivot", "h", "text")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(partitions, "cell", "block").sortWithinPartitions("cell", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = ShingleSets()
        key, held = None, []
        for batch in batches:
            for part in slices(batch):
                cell, block, pivot, h = (part.column(n).to_pylist() for n in range(4))
                found = sets.of_column(part.column(4))
                for n, here in enumerate(zip(cell, block, strict=True)):
                    if here != key:
                        if held:
                            yield distances(key, held)
                        key, held = here, []
                    held.append((pivot[n], h[n], found[n]))
        if held:
            yield distances(key, held)

    schema = (
        "cell long, h long, pivot boolean, mask int, nearest int, least double, "
        "d array<double>, linked array<long>"
    )
    return rows.mapInArrow(released(run), schema)


def distances(key: tuple[int, int], held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    """The documents of a block, and of the first block the pivots, with their distances."""
    cell, block = key
    pivots = sorted((k, h, own) for k, h, own in held if k >= 0)
    members = [(h, own) for k, h, own in held if k < 0]
    visitors = len(members)
    if block == 0:
        members += [(h, own) for _, h, own in pivots]
    h = np.array([m[0] for m in members], np.int64)
    sizes = np.array([len(m[1]) for m in members], np.int64)
    flat = np.concatenate([np.empty(0, np.uint64), *(m[1] for m in members)])
    owner = np.repeat(np.arange(len(members)), sizes)
    d = np.empty((len(members), len(pivots)))
    near = np.empty(d.shape, bool)
    for k, (_, _, own) in enumerate(pivots):
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        shared = np.bincount(owner[own[at] == flat], minlength=len(members))
        union = sizes + len(own) - shared
        d[:, k] = 1 - shared / union
        near[:, k] = 100 * shared >= SHARED * union
    ids = np.array([p[1] for p in pivots], np.int64)
    each = np.r_[0, np.cumsum(near.sum(1))].astype(np.int32)
    ends = np.arange(len(members) + 1, dtype=np.int32) * len(pivots)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(members), cell)),
            pa.array(h),
            pa.array(np.arange(len(members)) >= visitors),
            pa.array((near << np.arange(len(pivots))).sum(1).astype(np.int32)),
            pa.array(d.argmin(1).astype(np.int32)),
            pa.array(d.min(1)),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(d.ravel())),
            pa.ListArray.from_arrays(pa.array(each), pa.array(ids[near.nonzero()[1]])),
        ],
        ["cell", "h", "pivot", "mask", "nearest", "least", "d", "linked"],
    )


def joined_masks(masks: Column) -> Column:
    """Masks that meet in a position as one, until all are disjoint: the classes of a cell."""
    return F.aggregate(
        F.filter(masks, lambda m: m != 0),
        F.array().cast("array<int>"),
        lambda held, m: F.concat(
            F.filter(held, lambda x: x.bitwiseAND(m) == 0),
            F.array(
                F.aggregate(
                    F.filter(held, lambda x: x.bitwiseAND(m) != 0), m, lambda a, x: a.bitwiseOR(x)
                )
            ),
        ),
    )


def windows(found: DataFrame) -> DataFrame:
    """``cell, k, h, size, own``: the regions ``k`` that every document but the pivots is in.

    ``own`` is the number of its class in the cell, -1 for none; ``size`` counts
    the cell. Region -1 is the whole cell, the last one that of far documents.
    """
    every = range(CELL_PIVOTS)
    is_near = F.col("least") <= FAR
    reach = [F.max(F.when(is_near & (F.col("nearest") == k), F.col("least"))) for k in every]
    cells = found.groupBy("cell").agg(
        F.collect_set("mask").alias("masks"),
        F.array(*reach).alias("reach"),
        F.count_if(~F.col("pivot")).alias("size"),
    )
    cells = cells.select("cell", "reach", "size", joined_masks(F.col("masks")).alias("classes"))
    cells = broadcast_if_small(cells, "cell-windows", 256)
    inside = [
        F.when(
            is_near
            & F.get("reach", F.lit(k)).isNotNull()
            & (
                (F.col("nearest") == k)
                | (
                    F.get("d", F.lit(k))
                    <= F.least(F.col("least") + 2 * RADIUS, F.get("reach", F.lit(k)) + RADIUS) + 1e-9
                )
            ),
            F.lit(k),
        )
        for k in every
    ]
    inside.append(F.when(F.col("least") > FAR - RADIUS - 1e-9, F.lit(CELL_PIVOTS)))
    own = F.array_position(
        F.transform("classes", lambda c: c.bitwiseAND(F.col("mask")) != 0), F.lit(True)
    )
    return (
        found.where(~F.col("pivot"))
        .join(cells, "cell")
        .select(
            "cell",
            F.explode(F.array_compact(F.array(F.lit(-1), *inside))).alias("k"),
            "h",
            "size",
            (own - 1).cast("int").alias("own"),
        )
    )


def open_regions(rows: DataFrame) -> DataFrame:
    """``cell, k, n, others, largest``: the regions to go on with.

    ``others`` counts the documents outside the class ``largest``. Regions of one
    class are done; a cell whose others overlap too much stays whole.
    """
    classes = [
        F.struct(F.count_if(F.col("own") == c).alias("n"), F.lit(c).alias("own"))
        for c in range(CELL_PIVOTS)
    ]
    sizes = rows.groupBy("cell", "k").agg(
        F.count("*").alias("n"), F.first("size").alias("size"), F.greatest(*classes).alias("most")
    )
    sizes = sizes.select(
        "cell", "k", "n", "size", (F.col("n") - F.col("most.n")).alias("others"), F.col("most.own").alias("largest")
    )
    sizes = written(sizes.where("n > 1 and others > 0"), "region-sizes")
    copies = F.sum(F.when(F.col("k") >= 0, F.col("n")).otherwise(0))
    divided = sizes.groupBy("cell").agg((copies <= COPIES * F.first("size")).alias("divided"))
    both = sizes.join(divided, "cell").where((F.col("k") >= 0) == F.col("divided"))
    return broadcast_if_small(both.drop("divided", "size"), "open-regions", 64)


def in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """``cell, a, b, h``: the others of a region, in blocks ``a``, with all of it, in blocks ``b``."""
    outside = F.col("own") != F.col("largest")
    a_parts, b_parts = (F.ceil(F.col(n) / block).cast("int") for n in ("others", "n"))
    a = F.pmod(F.xxhash64("h", F.lit("a")), a_parts).cast("int")
    b = F.pmod(F.xxhash64("h", F.lit("b")), b_parts).cast("int")
    everywhere = F.transform(
        F.sequence(F.lit(0), a_parts - 1), lambda x: F.struct(x.alias("a"), b.alias("b"))
    )
    also = F.transform(
        F.sequence(F.lit(0), b_parts - 1), lambda x: F.struct(a.alias("a"), x.alias("b"))
    )
    places = F.when(outside, F.array_union(everywhere, also)).otherwise(everywhere)
    return rows.select("cell", F.explode(places).alias("place"), "h").select("cell", "place.*", "h")


def divide(
    members: DataFrame, texts: DataFrame, block: int
) -> tuple[list[DataFrame], list[DataFrame], int]:
    """Links ``h, p`` and groups ``cell, a, b, h`` yet to be joined, and the number of rounds.

    ``members`` (``cell, h``) are cells of more than two blocks.
    """
    links, groups, rounds = [], [], 0
    while not members.isEmpty():
        rounds += 1
        found = written(measured(members, texts, block), "cell-distances")
        pairs = found.select("h", F.explode("linked").alias("p"))
        links.append(pairs.where("h != p"))
        rows = windows(found)
        rows = written(
            rows.join(open_regions(rows), ["cell", "k"]).withColumn(
                "cell", F.xxhash64("cell", "k", F.lit(rounds))
            ),
            "cell-regions",
        )
        fits = F.col("n") <= 2 * block
        again = ~fits & (F.col("k") >= 0) & (F.col("n") <= SMALLER * F.col("size"))
        groups.append(rows.where(fits).select("cell", F.lit(0).alias("a"), F.lit(0).alias("b"), "h"))
        groups.append(in_blocks(rows.where(~fits & ~again), block))
        members = rows.where(again).select("cell", "h")
    return links, groups, rounds
