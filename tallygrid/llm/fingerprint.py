"""Document fingerprints by one-permutation MinHash, in DataFrame functions alone.

Every five-word shingle is hashed once. The hash's leading bits name one of
``BINS`` bins, and a bin keeps its smallest hash. Sorting the hashes together
with one marker for each bin gives the dense row of bins in one pass: the first
entry of every bin, which is its marker where the bin is empty. An empty bin
copies the first filled bin of a probing order of its own, the same for all
documents (optimal densification: each empty bin chooses at random and
independently). Of each bin the ``BITS`` low-order bits are kept and packed,
so a fingerprint is ``BINS * BITS / 4`` hexadecimal digits.

Likeness is the share of equal bins, corrected for the ``2**-BITS`` of unequal
bins that agree by chance, from 0 to 1.

Cases: equal texts have equal fingerprints and likeness 1. A text without
words has the empty fingerprint, which is like another empty one (1) and unlike
any other (0). Fewer than five words make one shingle. Null texts are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import broadcast_if_small
from .text import id_and_text, shingle_hashes, words_column

BINS = 256
BITS = 4
BIN_SHIFT = 64 - BINS.bit_length() + 1
EMPTY = (1 << BIN_SHIFT) - 1
# probes looked at one by one before the whole order is searched
EAGER = 12
PER_WORD = 64 // BITS
LOW_BITS = 0x1111111111111111

# ids to a bucket of the id order, and the most buckets
BUCKET_ROWS = 512
MOST_BUCKETS = 1 << 16


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def bin_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, BIN_SHIFT)


def is_filled(h: Column) -> Column:
    return h.bitwiseAND(F.lit(EMPTY)) != EMPTY


def probe(i: Column, attempt: Column | int) -> Column:
    """The bin that empty bin ``i`` tries at an attempt: a full cycle with its own step."""
    step = F.xxhash64(i, F.lit(1)).bitwiseOR(F.lit(1))
    start = F.xxhash64(i, F.lit(2))
    attempt = F.lit(attempt) if isinstance(attempt, int) else attempt
    # low bits alone: products never overflow
    low = BINS - 1
    return (
        start.bitwiseAND(F.lit(low)) + step.bitwiseAND(F.lit(low)) * attempt
    ).bitwiseAND(F.lit(low)).cast("int")


def binned(hashes: Column) -> Column:
    """Smallest hash of every bin, in the order of bins; markers for empty ones."""
    # sorting is signed, so bins with the top bit come first; ``bin_of`` is unsigned
    markers = F.array(*[F.lit(signed((b << BIN_SHIFT) | EMPTY)) for b in signed_order()])
    return F.sort_array(F.concat(hashes, markers))


def signed_order() -> list[int]:
    return [*range(BINS // 2, BINS), *range(BINS // 2)]


def first_of_bins(ordered: str) -> Column:
    o = F.col(ordered)
    return F.filter(
        o, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(o, F.greatest(i - 1, F.lit(0)))))
    )


def densified(bins: str) -> Column:
    """Low-order bits of every bin, empty ones filled."""
    b = F.col(bins)

    def filled_at(i: Column, attempt: Column | int) -> Column:
        h = F.get(b, probe(i, attempt))
        return F.when(is_filled(h), h)

    def fill(h: Column, i: Column) -> Column:
        eager = [filled_at(i, n) for n in range(EAGER)]
        attempts = F.sequence(F.lit(EAGER), F.lit(BINS - 1))
        found = F.filter(attempts, lambda n: is_filled(F.get(b, probe(i, n))))
        return F.when(is_filled(h), h).otherwise(
            F.coalesce(*eager, F.get(b, probe(i, F.get(found, 0))))
        )

    # mixed with the bin, so that copies of one hash agree by chance bin by bin, not all at once
    low = (1 << BITS) - 1
    return F.transform(F.transform(b, fill), lambda h, i: F.xxhash64(h, i).bitwiseAND(F.lit(low)))


def packed(values: str) -> Column:
    """Sixteen bins to a 64-bit integer."""
    v = F.col(values)
    words = F.transform(
        F.sequence(F.lit(0), F.lit(BINS // PER_WORD - 1)),
        lambda n: F.aggregate(
            F.slice(v, n * PER_WORD + 1, PER_WORD),
            F.lit(0).cast("long"),
            lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x),
        ),
    )
    # used twice, so that Spark does not compute ``values`` anew inside the lambda
    return F.when(v.isNotNull(), words)


def with_fingerprint(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """``df`` and the packed fingerprint of a text column; null without words."""
    steps = [
        ("__words", lambda: words_column(text_col)),
        ("__hashes", lambda: shingle_hashes("__words")),
        ("__ordered", lambda: F.when(F.size("__hashes") > 0, binned(F.col("__hashes")))),
        ("__bins", lambda: first_of_bins("__ordered")),
        ("__low", lambda: densified("__bins")),
    ]
    out = df
    for step, column in steps:
        out = out.withColumn(step, column())
    return out.withColumn(name, packed("__low")).drop(*[s for s, _ in steps])


def written_out(fingerprint: str) -> Column:
    """A packed fingerprint as hexadecimal digits; empty without words."""
    digits = F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0"))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two packed fingerprints."""

    def unequal(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for shift in (2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(z.bitwiseAND(F.lit(LOW_BITS)))

    apart = F.aggregate(
        F.zip_with(a, b, unequal), F.lit(0).cast("long"), lambda acc, x: acc + x
    )
    chance = 2.0**-BITS
    same = F.lit(1.0) - apart / BINS
    corrected = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    neither = F.col(a).isNull() & F.col(b).isNull()
    return F.when(both, corrected).when(neither, F.lit(1.0)).otherwise(F.lit(0.0))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``fingerprint`` (hexadecimal) for every row of ``docs``."""
    own = with_fingerprint(id_and_text(docs, id_col, text_col), "text", "packed")
    return own.select("id", written_out("packed").alias("fingerprint"))


def id_bucket(ids: DataFrame) -> Column:
    """Buckets of the descending id order with about as many rows each.

    The bounds are quantiles of all ids. A row finds its bucket in two levels,
    by counting the bounds above its id. Null ids get a bucket behind all others.
    """
    buckets = min(max(ids.count() // BUCKET_ROWS, 1), MOST_BUCKETS)
    shares = [n / buckets for n in range(1, buckets)]
    bounds: list[int] = []
    if shares:
        found = ids.agg(F.percentile_approx("id", shares, 10 * buckets).alias("q")).first().q
        bounds = sorted(set(found or []), reverse=True)
    behind = F.when(F.col("id").isNull(), len(bounds) + 1)
    if not bounds:
        return behind.otherwise(0)
    width = max(int(len(bounds) ** 0.5), 1)
    groups = [bounds[n : n + width] for n in range(0, len(bounds), width)]
    levels = F.expr(f"array({','.join('array(' + ','.join(f'{x}L' for x in g) + ')' for g in groups)})")
    # groups that begin above the id; the last of them is searched
    above = F.size(F.filter(levels, lambda g: F.get(g, 0) > F.col("id")))
    inner = F.filter(F.get(levels, F.greatest(above - 1, F.lit(0))), lambda x: x > F.col("id"))
    return behind.when(above == 0, 0).otherwise((above - 1) * width + F.size(inner))


def with_next(texts: DataFrame) -> DataFrame:
    """``id, text`` rows with their packed fingerprint and those of the next row.

    The next row is the one behind in descending id (equal ids by their text,
    null ids last), and after the last the first. Rows are ordered inside
    buckets of ids; a copy of each bucket's first row stands at the end of the
    bucket before it, so that nothing is ordered as a whole.
    """
    bucket = id_bucket(texts.select("id"))
    placed = texts.withColumn("bucket", bucket).withColumn("guest", F.lit(False))
    first = placed.groupBy("bucket").agg(F.max("id").alias("top"))
    # one row of three numbers for each bucket
    order = Window.orderBy("bucket")
    hosts = first.select(
        "bucket",
        "top",
        F.coalesce(F.lag("bucket").over(order), F.last("bucket").over(order.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))).alias("host"),
    )
    hosts = broadcast_if_small(hosts, "fingerprint-hosts", 64)
    guests = (
        placed.join(
            hosts, (placed["bucket"] == hosts["bucket"]) & placed["id"].eqNullSafe(hosts["top"])
        )
        .groupBy(hosts["host"].alias("bucket"))
        .agg(F.first("id").alias("id"), F.min("text").alias("text"))
        .select("id", "text", "bucket", F.lit(True).alias("guest"))
    )
    both = with_fingerprint(placed.unionByName(guests), "text", "packed")
    within = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("id"), "text")
    return (
        both.withColumn("next_text", F.lead("text").over(within))
        .withColumn("next_packed", F.lead("packed").over(within))
        .where(~F.col("guest"))
        .drop("bucket", "guest")
    )


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has the first half of the next document's code points, as
    many as its own second half has, in place of that half.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(
        F.col("text").substr(F.lit(1), (n - half).cast("int")),
        F.col("next_text").substr(F.lit(1), half),
    )
    rows = with_next(id_and_text(docs, id_col, text_col)).withColumn("edited", edited)
    rows = with_fingerprint(rows, "edited", "edited_packed")
    return rows.select(
        "id",
        n.cast("long").alias("n_chars"),
        "edited",
        "packed",
        "edited_packed",
        likeness("packed", "edited_packed").alias("near_edited"),
        likeness("packed", "next_packed").alias("near_next"),
    )
