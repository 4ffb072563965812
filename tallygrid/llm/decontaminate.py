"""Benchmark decontamination: short items that stand inside long documents.

An item is contained in a document when at least ``CONTAINED`` per cent of its
distinct five-word shingles occur there. Candidates come from MinHash: an item
of n shingles keeps its smallest ``n - ceil(0.75 n) + 1`` hashes. A document
that contains the item misses at most the rest, so it shares one of them: the
search loses nothing. Items are partitioned by size (powers of two); each
partition knows its largest sketch hash and the fewest shingles a document
must have to contain one of its items. A document therefore looks up only
hashes up to the largest bound of the partitions that it is long enough for,
about a quarter of its shingles. Candidates are verified on the shingles
themselves, not on hashes.

All of it is DataFrame functions. Equal texts are searched once. Both join
sides that come from the benchmark are broadcast only when their size allows.

Cases: an item or document of fewer than five words is one shingle, so it only
matches a text of the same words; one without words matches nothing. Repeated
items and documents each get their rows of the result; rows with equal ids and
different texts count as different documents. Null texts count as empty.
A text of any length is one row, searched whole. Without items, or without
documents, the result is empty. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written
from .shared import broadcast_if_small
from .text import id_and_text, shingle_hashes, shingle_strings, words_column

# per cent of an item's shingles that a document must hold
CONTAINED = 75
# hash, key and count columns of one row
ROW_BYTES = 128
SHINGLE_ROW_BYTES = 1024


def needed(n: Column) -> Column:
    """Fewest shared shingles for ``n`` shingles of an item."""
    return F.floor((n * CONTAINED + 99) / 100).cast("int")


def prepared(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item, key, n_item, shingles, sketch`` of the items that have words."""
    own = (
        id_and_text(items, item_col, text_col)
        .select(F.col("id").alias("item"), F.md5("text").alias("key"), words_column("text").alias("words"))
        .where(F.size("words") > 0)
    )
    own = own.select(
        "item",
        "key",
        F.array_distinct(shingle_strings("words")).alias("shingles"),
        F.sort_array(F.array_distinct(shingle_hashes("words"))).alias("hashes"),
    )
    n = F.size("shingles")
    return own.select(
        "item",
        "key",
        n.alias("n_item"),
        "shingles",
        F.slice("hashes", 1, n - needed(n) + 1).alias("sketch"),
    )


def size_bounds(items: DataFrame) -> list[tuple[int, int]]:
    """For each size partition: shingles a document needs, and its largest sketch hash."""
    rows = (
        items.groupBy(F.floor(F.log2("n_item")).alias("partition"))
        .agg(F.min(needed(F.col("n_item"))).alias("need"), F.max(F.array_max("sketch")).alias("most"))
        .collect()  # one row for each power of two
    )
    return [(r.need, r.most) for r in rows]


def lookup_bound(n: Column, bounds: list[tuple[int, int]]) -> Column:
    """Largest sketch hash among the partitions whose items a document of n shingles may hold."""
    return reduce(
        F.greatest,
        [F.when(n >= need, F.lit(most)).otherwise(F.lit(-(2**63))) for need, most in bounds],
        F.lit(-(2**63)),
    )


def find(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``text_key, item, n_item, n_shared``: texts (by MD5) and the item rows they contain."""
    own = written(prepared(items, item_col, item_text_col), "benchmark-items")
    bounds = size_bounds(own)
    texts = id_and_text(docs, id_col, text_col).select(F.md5("text").alias("text_key"), "text")
    if not bounds:
        return own.select(
            F.col("key").alias("text_key"), "item", "n_item", F.lit(0).alias("n_shared")
        ).where(F.lit(False))
    sketches = broadcast_if_small(
        own.select(F.explode("sketch").alias("hash")).distinct(), "benchmark-sketches", ROW_BYTES
    )
    hashed = texts.select("text_key", words_column("text").alias("words")).select(
        "text_key", shingle_hashes("words").alias("hashes")
    )
    size = F.size("hashes")
    bound = F.col("bound")
    # used twice, so that Spark computes it once for a text and not for every hash
    below = F.when(bound.isNotNull(), F.filter("hashes", lambda h: h <= bound))
    probes = hashed.select("text_key", "hashes", lookup_bound(size, bounds).alias("bound")).select(
        "text_key", F.explode(below).alias("hash")
    )
    candidates = broadcast_if_small(
        probes.join(sketches, "hash", "left_semi").select("text_key").distinct(),
        "benchmark-candidates",
        ROW_BYTES,
    )
    # several rows may have a candidate's text; one of them is verified
    kept = texts.join(candidates, "text_key", "left_semi").dropDuplicates(["text_key"])
    shingles = kept.select("text_key", words_column("text").alias("words")).select(
        "text_key", F.explode(F.array_distinct(shingle_strings("words"))).alias("shingle")
    )
    # equal items are verified once, whatever their ids and however often they are repeated
    wanted = broadcast_if_small(
        own.dropDuplicates(["key"]).select("key", "n_item", F.explode("shingles").alias("shingle")),
        "benchmark-shingles",
        SHINGLE_ROW_BYTES,
    )
    held = (
        shingles.join(wanted, "shingle")
        .groupBy("text_key", "key", "n_item")
        .agg(F.count("*").cast("int").alias("n_shared"))
        .where(F.col("n_shared") >= needed(F.col("n_item")))
    )
    rows = broadcast_if_small(own.select("item", "key"), "benchmark-rows", ROW_BYTES)
    return held.join(rows, "key").select("text_key", "item", "n_item", "n_shared")


def contaminated_pairs(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``id, item, n_item, n_shared`` for every document row and item row that match."""
    found = broadcast_if_small(
        find(docs, items, id_col, text_col, item_col, item_text_col), "benchmark-found", ROW_BYTES
    )
    keyed = id_and_text(docs, id_col, text_col).select("id", F.md5("text").alias("text_key"))
    return keyed.join(found, "text_key").select("id", "item", "n_item", "n_shared")


def without_contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` whose text contains no item, with all their columns."""
    found = broadcast_if_small(
        find(docs, items, id_col, text_col, item_col, item_text_col)
        .select("text_key")
        .distinct(),
        "benchmark-found",
        ROW_BYTES,
    )
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.join(found, F.md5(text) == found["text_key"], "left_anti")
