"""Exact Jaccard join of word-shingle sets: a prefix filter, and metric regions in large groups.

The distance 1 - J of two sets is a metric. Documents link when their distance
is at most ``RADIUS`` (J of 0.75 or more), and the join returns the classes
that the links form.

1. *Prefix filter.* Candidates meet by common shingles in a global order, rare
   ones first; no document is a pivot here. Two documents within the radius
   differ in at most a quarter of either set, so of a first quarter and ``l``
   shingles more, ``l`` at least are common. A document is replicated to the
   groups of that many, with ``l`` about ``SPARE`` per cent of its set: a linked
   pair meets in at least as many. Most shingles stand in one document only, and
   their groups close at once. The others are divided by bands of set sizes, two
   for each document, as sizes of linked documents differ by a third at most.
   Documents left in fewer groups than any partner would need leave the others
   too, again where that removes much. Groups with the same members are one.
2. *Cells.* Groups that share documents are one cell, so that copies are compared
   once and not in each of their groups; where such a chain holds more than
   ``CHAIN`` documents, every group stays a cell of its own. A cell of more than
   two blocks of ``BLOCK`` documents is divided by Voronoi regions in rounds over
   all cells (``regions.py``), until its parts fit one task.
3. *Voronoi regions in a task.* Groups above ``DIRECT`` are divided by pivots far from each
   other, to which the distances of all documents are computed. Each document
   belongs to the region of its nearest pivot. By the triangle inequality a
   document y can only link to one of another pivot's region if its distance to
   that pivot is at most its own least distance plus twice the radius, and at
   most the region's largest distance plus the radius: inside these windows it is
   replicated. Regions are joined again in the same way, until they are small
   or overlap so much that joining them in turn would save less than half, and
   then compared directly. Documents of one class need no comparison any more.

Equal texts are collapsed first, and every text is shuffled once, into a table
bucketed by a hash with which pairs are joined. Counts of shared shingles are
exact but for collisions of 64-bit hashes.

Cases: documents of fewer than five words have one shingle; those without
words, null texts included, have none and link with nothing. Repeated rows and
null ids keep their rows; a class of null ids alone has a null class id. A text
of any length is one set; a task holds one such text, or some megabytes of
shorter ones. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import ship_package, written
from .components import components
from .copies import BATCH_ROWS, distinct_texts
from .regions import RADIUS, SHARED, divide
from .shared import arrow_rows, broadcast_if_small
from .text import ShingleSets, released, slices

# per cent of a set by which a document is replicated beyond what it may miss
SPARE = 6
# bits of a shingle's hash that name its groups, and of the band of set sizes below them;
# shingles that agree in the first are one group, so more documents meet and none is lost
PIVOT_BITS = 40
BAND_BITS = 7
# a round of the prefix filter shuffles all rows twice: another follows only where one left
# no more than this share of them; what stays is compared, so results are the same
WORTH = 0.75
# the most frequent shingles that tasks know of; they only decide the order
KNOWN_FREQUENT = 1 << 18
# documents of a chain of regions that may form one cell, and of one block of it
CHAIN = 1 << 14
BLOCK = 512
# documents that are compared directly, and pivots of a larger region
DIRECT = 8
PIVOTS = 6


def frequent_shingles(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of batches, sorted, and their counts: at most ``KNOWN_FREQUENT``."""
    pairs = table.where(F.col("often").isNotNull()).select(
        F.explode(F.arrays_zip("often", "often_n")).alias("s")
    )
    top = (
        pairs.groupBy(F.col("s.often").alias("shingle"))
        .agg(F.sum("s.often_n").alias("n"))
        .orderBy(F.desc("n"), "shingle")
        .limit(KNOWN_FREQUENT)
        .toArrow()
    )
    values = top.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(values)
    return values[order], top.column("n").to_numpy()[order]


def texts_of(table: DataFrame) -> DataFrame:
    """The distinct texts that have shingles."""
    return table.where(F.col("text").isNotNull())


def outer_regions(table: DataFrame) -> DataFrame:
    """``pivot, h, n``: the single-shingle regions that a document is replicated to."""
    ship_package(table.sparkSession)
    shared = table.sparkSession.sparkContext.broadcast(frequent_shingles(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = ShingleSets()
        known, counts = shared.value
        for batch in batches:
            for part in slices(batch):
                pivots, sizes = [], []
                for own in sets.of_column(part.column(1)):
                    n = len(own)
                    if len(known) and n:
                        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                        often = np.where(known[at] == own, counts[at], 0)
                        own = own[np.argsort(often, kind="stable")]
                    # what may be missing, and the spare ones
                    pivots.append(own[: n - -(-SHARED * n // 100) + -(-SPARE * n // 100)])
                    sizes.append(n)
                each = np.fromiter(map(len, pivots), np.int64, len(pivots))
                flat = np.concatenate([np.empty(0, np.uint64), *pivots]) >> np.uint64(64 - PIVOT_BITS)
                h = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(flat.view(np.int64)),
                        pa.array(np.repeat(h, each)),
                        pa.array(np.repeat(np.array(sizes, np.int32), each)),
                    ],
                    ["pivot", "h", "n"],
                )

    return texts_of(table).select("h", "text").mapInArrow(released(run), "pivot long, h long, n int")


def common_at_least(n: Column) -> Column:
    """Fewest outer regions that a document of ``n`` shingles shares with a linked one."""
    smaller = F.ceil(n * SHARED / 100)
    return F.ceil(smaller * SPARE / 100)


def not_alone(rows: DataFrame, *region: str) -> DataFrame:
    """The rows of the regions that hold two documents or more."""
    size = F.count("*").over(Window.partitionBy(*region))
    return rows.withColumn("size", size).where(F.col("size") > 1).drop("size")


def in_bands(rows: DataFrame) -> DataFrame:
    """``pivot, region, h, mark``: each row in its band of set sizes and as a guest in the next larger one.

    Documents that can link are of one band or of neighbouring ones. Guests meet
    each other in their own band, so a region of guests alone is dropped. A region
    is a shingle and a band; ``mark`` is twice the set size, and one more for a guest.
    """
    # a little wider than the ratio of sizes that a link allows
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(101 / SHARED)))
    region = F.shiftleft("pivot", BAND_BITS) + band
    mark = 2 * F.col("n").cast("long")
    places = F.array(
        F.struct(region.alias("region"), mark.alias("mark")),
        F.struct((region + 1).alias("region"), (mark + 1).alias("mark")),
    )
    placed = rows.select("pivot", "h", F.explode(places).alias("place"))
    return placed.select("pivot", "place.region", "h", "place.mark")


def banded(rows: DataFrame) -> DataFrame:
    """The same without the shingle."""
    return in_bands(rows).drop("pivot")


def with_hosts(rows: DataFrame, *outer: str) -> DataFrame:
    """The rows of the banded regions in which two documents meet that are not both guests.

    ``rid`` is equal for regions of one band with the same documents. ``outer`` are columns that
    the region decides: rows that are together by these already need no shuffle.
    """
    same, band = Window.partitionBy(*outer, "region"), F.col("region").bitwiseAND((1 << BAND_BITS) - 1)
    met = rows.withColumns(
        {
            "guests": F.min(F.col("mark") % 2).over(same),
            "size": F.count("*").over(same),
            "members": F.sum(F.shiftright(F.xxhash64("h"), 16)).over(same),
        }
    ).where("guests = 0 AND size > 1")
    return met.select("region", "h", "mark", F.xxhash64("size", "members", band).alias("rid"))


def met_enough(rows: DataFrame) -> DataFrame:
    """The rows of the documents that are in as many regions of a band as any partner needs."""
    # one document has one mark in a band
    regions = F.count("*").over(Window.partitionBy("h", "mark"))
    size = F.shiftright("mark", 1)
    return rows.withColumn("k", regions).where(F.col("k") >= common_at_least(size)).drop("k")


def first_regions(table: DataFrame) -> DataFrame:
    """``rid, m, h``: outer regions of two or more documents, equal ones once.

    ``m`` is a document in one of its bands.
    """
    # the bands of a shingle are where its rows are: one shuffle for both
    shared = not_alone(outer_regions(table), "pivot")
    with arrow_rows(table.sparkSession, BATCH_ROWS):
        rows = written(with_hosts(in_bands(shared), "pivot"), "banded-regions")
    before = rows.count()
    while before:
        rows = written(with_hosts(met_enough(rows.drop("rid"))), "banded-regions")
        after = rows.count()
        if after > WORTH * before:
            break
        before = after
    band = F.col("region").bitwiseAND((1 << BAND_BITS) - 1)
    rows = rows.select("rid", band.cast("int").alias("band"), "h").distinct()
    return rows.select("rid", F.xxhash64("h", "band").alias("m"), "h")


def cells(regions: DataFrame) -> DataFrame:
    """``cell, h, size``: the documents that must meet, each in its cells."""
    least = regions.groupBy("rid").agg(F.min("m").alias("lead"))
    ties = regions.join(least, "rid").where("m != lead").select("m", "lead").distinct()
    chains = written(components(ties, "m", "lead"), "chains")
    sizes = chains.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") <= CHAIN)
    # a chain's documents stay where they are, however many it has
    sizes = broadcast_if_small(sizes, "chain-sizes", 32)
    short = chains.join(sizes, "label").withColumnRenamed("node", "m")
    documents = regions.select("m", "h").distinct()
    by_chain = short.join(documents, "m").select(F.col("label").alias("cell"), "h", "size")
    rest = regions.join(short.select("m"), "m", "left_anti")
    own = rest.groupBy("rid").agg(F.count("*").alias("size"))
    by_region = rest.join(own, "rid").select(F.col("rid").alias("cell"), "h", "size")
    return by_chain.unionByName(by_region)


def blocks(placed: DataFrame) -> DataFrame:
    """``cell, a, b, h``: the groups of rows of cells of at most two blocks."""
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("h"), parts).cast("int"))
    met = placed.select("cell", "h", "own", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    return met.select(
        "cell", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "h"
    )


class MetricJoin:
    """Links among the sets of one group, by recursive Voronoi regions."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        # the inverted index: for each shingle the documents that hold it
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        values, self.begin, counts = np.unique(flat[order], return_index=True, return_counts=True)
        self.end = self.begin + counts
        at = np.empty(len(flat), np.int64)
        at[order] = np.repeat(np.arange(len(values)), counts)
        self.at = np.split(at, np.cumsum(self.sizes)[:-1])
        self.parent = list(range(len(sets)))
        self.links: list[tuple[int, int]] = []

    def root(self, n: int) -> int:
        while self.parent[n] != n:
            self.parent[n] = self.parent[self.parent[n]]
            n = self.parent[n]
        return n

    def shared(self, pivot: int) -> np.ndarray:
        """Shingles that every document has in common with one."""
        begin, end = self.begin[self.at[pivot]], self.end[self.at[pivot]]
        each = end - begin
        upto = np.cumsum(each)
        rows = np.arange(int(upto[-1])) + np.repeat(begin - (upto - each), each)
        return np.bincount(self.owner[rows], minlength=len(self.sets))

    def distances(self, pivot: int, members: np.ndarray) -> np.ndarray:
        """Distances of the members to a pivot; those within the radius are linked to it."""
        shared = self.shared(pivot)[members]
        union = self.sizes[members] + self.sizes[pivot] - shared
        for n in members[(100 * shared >= SHARED * union) & (members != pivot)].tolist():
            a, b = self.root(n), self.root(pivot)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                self.links.append((n, pivot))
        return 1 - shared / union

    def one_class(self, members: np.ndarray) -> bool:
        first = self.root(int(members[0]))
        return all(self.root(n) == first for n in members.tolist())

    def join(self, members: np.ndarray) -> None:
        if len(members) < 2 or self.one_class(members):
            return
        if len(members) <= DIRECT:
            self.compare(members)
            return
        # each pivot is the document farthest from those before it
        pivot = int(members[np.argmax(self.sizes[members])])
        pivots, to = [pivot], self.distances(pivot, members)[:, None]
        while len(pivots) < PIVOTS and to.min(1).max() > 0:
            pivots.append(int(members[np.argmax(to.min(1))]))
            to = np.c_[to, self.distances(pivots[-1], members)]
        nearest, least = to.argmin(1), to.min(1)
        regions = []
        for k in range(len(pivots)):
            reach = least[nearest == k].max(initial=0.0)
            window = np.minimum(least + 2 * RADIUS, reach + RADIUS) + 1e-9
            # the pivots have met all others
            inside = ((nearest == k) | (to[:, k] <= window)) & ~np.isin(members, pivots)
            if inside.any() and not self.one_class(members[inside]):
                regions.append(members[inside])
        # joining regions in turn must save at least half of all comparisons
        if 2 * sum(len(r) ** 2 for r in regions) <= len(members) ** 2:
            for region in regions:
                self.join(region)
        else:
            self.compare(members)

    def compare(self, members: np.ndarray) -> None:
        """Every member with those before it, until all are of one class."""
        for n in range(1, len(members)):
            self.distances(int(members[n]), members[:n])
            if n % DIRECT == 0 and self.one_class(members):
                return


def links(table: DataFrame) -> DataFrame:
    """``h, p``: links that span every class."""
    placed = written(cells(written(first_regions(table), "regions")), "cells")
    texts = texts_of(table).select("h", "text")
    large = placed.where(F.col("size") > 2 * BLOCK).select("cell", "h")
    found, divided, _ = divide(large, texts, BLOCK)
    groups = blocks(placed.where(F.col("size") <= 2 * BLOCK))
    for more in divided:
        groups = groups.unionByName(more)
    pairs = joined_groups(groups, texts)
    for more in found:
        pairs = pairs.unionByName(more)
    return pairs


def joined_groups(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """``h, p``: links among the documents of every group of rows."""
    rows = groups.join(texts, "h").select("cell", "a", "b", "h", "text")
    partitions = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(partitions, "cell", "a", "b").sortWithinPartitions("cell", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = ShingleSets()

        def joined(h: list[int], own: list[np.ndarray]) -> tuple[list[int], list[int]]:
            if len(h) < 2:
                return [], []
            group = MetricJoin(own)
            group.join(np.arange(len(h)))
            return [h[a] for a, _ in group.links], [h[b] for _, b in group.links]

        key, h, own = None, [], []
        for batch in batches:
            for part in slices(batch):
                left, right = [], []
                cell, a, b, ids = (part.column(n).to_pylist() for n in range(4))
                found = sets.of_column(part.column(4))
                for n, here in enumerate(zip(cell, a, b, strict=True)):
                    if here != key:
                        more = joined(h, own)
                        left, right = left + more[0], right + more[1]
                        key, h, own = here, [], []
                    h.append(ids[n])
                    own.append(found[n])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["h", "p"]
                )
        left, right = joined(h, own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["h", "p"]
        )

    return rows.mapInArrow(released(run), "h long, p long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, key, n_shingles, component_id, first`` for every row of ``docs``.

    ``key`` is the MD5 of the text. ``first`` marks the row or rows that stand
    for their class: those of its smallest id, and of one text where a class
    has null ids alone. Rows without words stand for themselves.
    """
    table = distinct_texts(docs, id_col, text_col)
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        found = written(links(table), "jaccard-links")
    classes = written(components(found, "h", "p"), "classes")
    own = texts_of(table).select("of", "n_shingles", F.col("id").alias("least"))
    label = classes.select(F.col("node").alias("of"), "label")
    labelled = written(own.join(label, "of", "left"), "labelled")
    # only classes of several texts have a label
    least = labelled.where(F.col("label").isNotNull()).groupBy("label").agg(
        F.min("least").alias("component")
    )
    least = broadcast_if_small(least, "class-ids", 32)
    by_text = labelled.join(least, "label", "left").select(
        "of",
        F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("component")).alias("c"),
        (F.col("label").isNull() | (F.col("of") == F.col("label"))).alias("leads"),
    )
    rows = table.select("of", "id", "key", "n_shingles").join(by_text, "of", "left")
    alone, leading = F.col("n_shingles") == 0, F.col("id").eqNullSafe(F.col("c"))
    return rows.select(
        "id",
        "key",
        "n_shingles",
        F.when(alone, F.col("id")).otherwise(F.col("c")).alias("component_id"),
        (alone | F.when(F.col("c").isNull(), F.col("leads")).otherwise(leading)).alias("first"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class, with all their columns.

    Repeated rows of one id and text stay once; rows without words all stay.
    """
    classes = written(near_classes(docs, id_col, text_col), "near-classes")
    rows = classes.where("n_shingles > 0").groupBy("id", "key").agg(
        F.count("*").alias("n"), F.max("first").alias("first")
    )
    gone = broadcast_if_small(
        rows.where("n > 1 or not first").select("id", "key", "first"), "near-gone", 128
    )
    key = F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    same = docs[id_col].cast("long").eqNullSafe(gone["id"]) & (key == gone["key"])
    repeats = docs.join(gone.where("first"), same, "left_semi")
    return docs.join(gone, same, "left_anti").unionByName(repeats.dropDuplicates([id_col, text_col]))
