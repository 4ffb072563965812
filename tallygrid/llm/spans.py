"""Spans of a text: kinds, order and digests, shared by the two span finders."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SPAN = "struct<kind:string,start:int,end:int,base:boolean,score:double>"
SPANS = f"id long, spans array<{SPAN}>"
ARROW_SPANS = pa.list_(
    pa.struct(
        [
            ("kind", pa.string()),
            ("start", pa.int32()),
            ("end", pa.int32()),
            ("base", pa.bool_()),
            ("score", pa.float64()),
        ]
    )
)


def outside(
    spans: list[tuple[int, int]], taken: list[tuple[int, int]]
) -> list[tuple[int, int]]:
    """The spans that touch none of the taken ones."""
    merged: list[list[int]] = []
    for start, end in sorted(taken):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    starts = [start for start, _ in merged]
    out = []
    for start, end in spans:
        n = bisect_right(starts, end - 1)
        if not n or merged[n - 1][1] <= start:
            out.append((start, end))
    return out


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, in the order of the array."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def base_of(kind: str):
    return lambda s: s["base"] & (s["kind"] == F.lit(kind))


def digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts of the base spans by kind, their hash, and all spans written out."""
    base = F.filter("spans", lambda s: s["base"])
    counts = [
        F.size(F.filter("spans", base_of(kind))).cast("long").alias(f"n_{kind}") for kind in kinds
    ]
    return found.select(
        F.col("id").alias("doc_id"),
        *counts,
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
