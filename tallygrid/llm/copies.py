"""Distinct texts and what their shingles say, in a table whose joins need no shuffle of texts."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..session import shared_dir
from .shared import arrow_rows
from .text import ShingleSets, id_and_text, map_batches, packed_texts, parted


# documents of one batch of rows from which a shingle counts as frequent
FREQUENT = 4
BATCH_ROWS = 2000


def _distinct_in_batch(docs: DataFrame) -> DataFrame:
    """One row for each of ``docs``; later copies inside a batch keep no text.

    ``key`` is the MD5 of the text, ``n_shingles`` the size of its set. Copies
    are dealt out by a hash ``h`` of their own, texts by the hash of the text;
    ``of`` is the hash of the text for both. Texts without words are no copies.
    One row of a batch carries its frequent shingles and their counts. Texts are
    compressed, so that the shuffles of whole texts are smaller.
    """

    def make():
        import xxhash

        sets = ShingleSets()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column(0)
            texts, own_ids = batch.column(1).to_pylist(), ids.to_pylist()
            order = pc.sort_indices(ids, null_placement="at_end").to_pylist()
            seen: set[str] = set()
            kept: list[str | None] = list(texts)
            for row in order:
                if texts[row] in seen:
                    kept[row] = None
                seen.add(texts[row])
            size: dict[str, int] = {}
            found = []
            for part in parted([t for t in kept if t is not None]):
                own = sets.of(part)
                size.update(zip(part, map(len, own), strict=True))
                found += own
            n = [size[t] for t in texts]
            h, of = [], []
            for row, text in enumerate(texts):
                if n[row]:
                    of.append(xxhash.xxh3_64_intdigest(text))
                    own = of[row] if kept[row] is not None else f"{row} {own_ids[row]} {of[row]}"
                    h.append(own if kept[row] is not None else xxhash.xxh3_64_intdigest(own))
                else:
                    kept[row] = None
                    of.append(xxhash.xxh3_64_intdigest(f"{row} {own_ids[row]} {text}"))
                    h.append(of[row])
            values, times = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
            often = times >= FREQUENT
            lists = [
                pa.array([x[often].view(np.int64)] + [None] * (len(texts) - 1), pa.list_(pa.int64()))
                for x in (values, times.astype(np.uint64))
            ]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(h, np.uint64).view(np.int64)),
                    pa.array(np.array(of, np.uint64).view(np.int64)),
                    ids,
                    batch.column(2),
                    packed_texts(kept),
                    pa.array(n, pa.int64()),
                    *lists,
                ],
                ["h", "of", "id", "key", "text", "n_shingles", "often", "often_n"],
            )

        return each

    schema = (
        "h long, of long, id long, key string, text binary, n_shingles long, "
        "often array<long>, often_n array<long>"
    )
    return map_batches(docs, make, schema, limit=12 << 20)


def distinct_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A written table of all rows, bucketed by ``h``; only first copies keep their text."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = id_and_text(docs, id_col, text_col).withColumn("key", F.md5("text"))
    rows = _distinct_in_batch(own).repartition(buckets, "h")
    same = Window.partitionBy("h", "key").orderBy(F.asc_nulls_last("id"))
    rows = rows.withColumn("place", F.row_number().over(same))
    rows = rows.withColumn("text", F.when(F.col("place") == 1, F.col("text"))).drop("place")
    name = f"distinct_texts_{uuid.uuid4().hex}"
    writer = rows.write.bucketBy(buckets, "h").sortBy("h").option("compression", "zstd")
    # whole texts go to Python and back, so few rows at a time keep buffers small
    with arrow_rows(spark, BATCH_ROWS):
        writer.option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
