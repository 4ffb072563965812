"""The named queries of this folder: whole tables, production parameters, digests."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (
    audit,
    bpe,
    decontaminate,
    fingerprint,
    html,
    jaccard,
    lm,
    middle,
    pii,
    secrets,
    sharding,
    spans,
    substring,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def fold_of(id_col: str) -> Column:
    """The fold of a row: CRC-32 of its id as text, modulo five."""
    return F.crc32(F.col(id_col).cast("string")) % 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with each benchmark item that it contains."""
    docs, items = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    found = decontaminate.contaminated_pairs(docs, items)
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


@query
def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document; those of fold 1 are not learned from."""
    docs = table(spark, sf_dir, "documents")
    model = lm.fit(docs.where(fold_of("doc_id") != 1))
    return lm.score(docs, model).select(
        F.col("id").alias("doc_id"),
        F.coalesce(fold_of("id") == 1, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.words.total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, and its likeness to an edited text and the next one."""
    rows = fingerprint.edited_likeness(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.written_out("packed").alias("fingerprint"),
        fingerprint.written_out("edited_packed").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query
def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text, with a model fitted on all of them."""
    docs = table(spark, sf_dir, "documents")
    return spans.digest(pii.find(docs, pii.fit(docs)), pii.KINDS)


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document."""
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(bpe.decode(bpe.encode(docs, TOKENIZER), TOKENIZER))


@query
def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without word windows that stand earlier."""
    left = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicate documents of every row."""
    found = jaccard.near_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text; the labels of fold 0 are held out."""
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(fold_of("doc_id") != 0))
    scored = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select(
        "doc_id",
        F.coalesce(fold_of("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text, against the identifiers of all of them."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.identifier_dictionary(docs))
    return spans.digest(found, secrets.KINDS)


@query
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document among 16 shards, and its shard among 17."""
    placed = sharding.place(table(spark, sf_dir, "documents"), 16)
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


@query
def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed for fill-in-the-middle training, and restored."""
    rows = middle.round_trip(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every source in every order."""
    return audit.interactions(*(table(spark, sf_dir, name) for name in ("documents", "labels")))
