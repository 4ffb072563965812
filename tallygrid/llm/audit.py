"""How filters of a corpus interact: what each removes in every order, and its fair share.

Every document gets the set of the filters it fails as five bits. Documents are
counted by (part, set), which leaves at most 32 rows a part, and from these the
removals of every coalition of filters are tabulated: the documents that fail at
least one of its members. All the rest follows from this table.

- A step of an order removes the difference between two coalitions: the filters
  up to and with it, and those before it.
- The Shapley value of the filters is the exact solution of constrained least
  squares: the additive model closest to the table in the Shapley kernel's
  weights, its values adding up to the removals of all filters. The normal
  equations with the multiplier of the constraint are solved in rationals.

``E`` compares texts table-wide: a text's smallest id is found by the digest of
the text (SHA-256), with partial minima before the shuffle. Rows meet it on
(digest, id), so copies of one text never gather in one task, and rows equal in
everything are one row with its number before anything is joined.

Cases: null texts are empty ones and equal to each other; null and empty parts
are one part. A null id is not known to be larger than another, so its row
never fails ``E``, and it has no label. Rows that share the smallest id of their
text all pass ``E``. An id with several label rows has a mark if one of them
has it. Each repeated row counts. A text of any length is one row of counts. An
empty table gives no parts. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ship_package, written
from .text import UPPER, WORD

# fixed values: the filters in the order of their bits, and their limits
FILTERS = "ABCDE"
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 2
SPECIAL = r"[#$%&*|]"

ALL = (1 << len(FILTERS)) - 1
MEASURES = ("failing", "good", "toxic")

REPORT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_failures(text: str) -> Column:
    """The bits of the filters that look at one text alone."""
    t = F.col(text)
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    n_words = F.size(words)
    chars = F.char_length(t)
    upper = chars - F.char_length(F.translate(t, UPPER, ""))
    fails = {
        "A": n_words < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n_words,
        "C": 100 * upper.cast("long") > UPPER_PERCENT * chars,
        "D": t.rlike(SPECIAL),
    }
    bits = F.lit(0)
    for letter, failed in fails.items():
        bits = bits + F.when(failed, bit(letter)).otherwise(0)
    return bits


def marks(labels: DataFrame, id_col: str) -> DataFrame:
    """One row for every id with a mark: ``good`` and ``toxic`` as 0 or 1."""
    marked = labels.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0)).alias("good"),
        F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0)).alias("toxic"),
    )
    marked = marked.where(F.col("id").isNotNull() & ((F.col("good") == 1) | (F.col("toxic") == 1)))
    return marked.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))


def failures(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """``id, part, fails`` (the bits of all filters) and the number ``n`` of such rows."""
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    ).select("id", "part", F.sha2("text", 256).alias("digest"), text_failures("text").alias("fails"))
    # read for two joins: texts are looked at once
    rows = written(rows.groupBy("digest", "id", "part", "fails").agg(F.count("*").alias("n")), "audit-rows")
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).where("id IS NOT NULL")
    first = first.withColumn("is_first", F.lit(True))
    found = rows.join(first, ["digest", "id"], "left")
    repeats = F.col("id").isNotNull() & F.col("is_first").isNull()
    bits = F.col("fails") + F.when(repeats, bit("E")).otherwise(0)
    return found.select("id", "part", bits.alias("fails"), "n")


def counted(fails: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents by (part, fails): all, good ones and toxic ones; at most 32 rows a part."""
    known = fails.join(marks(labels, id_col), "id", "left")
    sums = {
        "failing": F.sum("n"),
        "good": F.sum(F.col("n") * F.coalesce("good", F.lit(0))),
        "toxic": F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))),
    }
    return known.groupBy("part", "fails").agg(*[v.alias(k) for k, v in sums.items()])


def coalitions(counts: DataFrame) -> DataFrame:
    """A row a part: its ``total`` and the removals of all 32 coalitions, in ascending order."""
    members = F.explode(F.sequence(F.lit(0), F.lit(ALL)))
    each = counts.withColumn("members", members)
    # the empty coalition removes nothing but still counts the part's documents
    removed = F.col("fails").bitwiseAND(F.col("members")) != 0
    sums = [F.sum(F.when(removed, F.col(m)).otherwise(0)).alias(m) for m in MEASURES]
    table = each.groupBy("part", "members").agg(*sums, F.sum("failing").alias("total"))
    return table.groupBy("part").agg(
        F.first("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("members", *MEASURES))).alias("removals"),
    )


def solved(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """The exact solution of a regular system."""
    rows = [[*row, value] for row, value in zip(matrix, right, strict=True)]
    for n in range(len(rows)):
        at = next(r for r in range(n, len(rows)) if rows[r][n])
        rows[n], rows[at] = rows[at], rows[n]
        rows[n] = [x / rows[n][n] for x in rows[n]]
        for r, row in enumerate(rows):
            if r != n and row[n]:
                rows[r] = [x - row[n] * y for x, y in zip(row, rows[n], strict=True)]
    return [row[-1] for row in rows]


def kernel(size: int, among: int) -> Fraction:
    """Weight of a coalition of that size."""
    return Fraction(among - 1, comb(among, size) * size * (among - size))


def shapley(removed: list[int]) -> list[Fraction]:
    """Shapley values of the filters from the removals of every coalition.

    Minimises the weighted squares of ``removed[S] - sum of values in S`` over the
    coalitions between none and all, with the values adding up to ``removed[ALL]``.
    """
    among = len(removed).bit_length() - 1
    everyone = len(removed) - 1
    normal = [[Fraction(0)] * (among + 1) for _ in range(among + 1)]
    right = [Fraction(0)] * (among + 1)
    for members in range(1, everyone):
        inside = [n for n in range(among) if members >> n & 1]
        weight = kernel(len(inside), among)
        for a in inside:
            right[a] += weight * removed[members]
            for b in inside:
                normal[a][b] += weight
    # the constraint and its multiplier
    for n in range(among):
        normal[n][among] = normal[among][n] = Fraction(1)
    right[among] = Fraction(removed[everyone])
    return solved(normal, right)[:among]


def steps(part: str, total: int, removals: list[dict]) -> Iterator[tuple]:
    """The report's rows of one part: every order, every step."""
    failing, good, toxic = ([row[m] for row in removals] for m in MEASURES)
    shares = [value * factorial(len(FILTERS)) for value in shapley(failing)]
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            own, after = bit(letter), before | bit(letter)
            removed = failing[after] - failing[before]
            yield (
                part,
                "".join(order),
                step,
                total - failing[after],
                removed,
                failing[own] - removed,
                failing[ALL] - failing[ALL ^ own],
                good[after] - good[before],
                toxic[after] - toxic[before],
                int(shares[FILTERS.index(letter)]),
            )
            before = after


def report(tables: DataFrame) -> DataFrame:
    """All orders and steps of every part, from its table of coalitions."""
    ship_package(tables.sparkSession)
    names = [field.split()[0] for field in REPORT.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * (len(names) - 3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                columns = zip(*steps(row["part"], row["total"], row["removals"]), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names
                )

    return tables.select("part", "total", "removals").mapInArrow(run, REPORT)


def interactions(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """The report of a table of documents and their labels (same id column)."""
    fails = failures(docs, id_col, text_col, part_col)
    return report(coalitions(counted(fails, labels, id_col)))
