"""Exact substring removal by level-wise doubling of repeated word windows.

A word goes when a window of ``WIDTH`` words covers it whose sequence of words
also starts earlier: in a document of smaller id, or earlier in the same one.

Windows are compared by 64-bit hashes, at a quarter of the width, then half,
then the whole; only what repeats at one length is extended to twice that
length, and the search ends when the width is reached or nothing survives. At
the first length not every window is looked at: of the windows inside any full
window, the one with the smallest hash stands for it. Equal full windows choose
the same one, so none is lost, and only about one position in nine is shuffled.
At half the width each survivor is extended both ways, as one of the two lies
inside the full window whatever its place; at the full width every window that
holds a survivor is taken.

Equal windows of one batch of rows meet before the shuffle: all but the first
are known to repeat and travel, as runs, under keys of their own, so a passage
that stands in a third of all documents reaches no task more than once a batch.
Copies of a text inside a batch lose all their windows at once. Texts are
written once, bucketed by their place in the order of documents, and joined
with their surviving positions without being shuffled again.

Cases: null and empty texts have no words; fewer words than a window lose none.
Rows of one id are ordered by a hash of their text, null ids come last; every
row of the input has its row in the result. Very long texts are one row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import shared_dir, ship_package
from .text import WordHashes, id_and_text, map_batches, mixed, slices, window_hashes

WIDTH = 20


def sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every run of ``size`` values, by doubling."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def chosen(hashes: np.ndarray, run: int) -> np.ndarray:
    """Positions whose hash is the smallest of some ``run`` neighbouring ones."""
    if len(hashes) < run:
        return np.empty(0, np.int64)
    least = sliding(hashes, run, np.minimum)
    padding = np.zeros(run - 1, hashes.dtype)
    most = sliding(np.r_[padding, least, padding], run, np.maximum)
    return np.flatnonzero(most == hashes)


def halves(starts: np.ndarray, quarter: int, n: int) -> np.ndarray:
    """Starts of the half-width windows that a surviving quarter begins or ends."""
    out = np.unique(np.r_[starts, starts - quarter])
    return out[(out >= 0) & (out <= n - 2 * quarter)]


def holders(starts: np.ndarray, half: int, n: int) -> np.ndarray:
    """Starts of the full windows that hold a surviving half."""
    edge = np.zeros(n + 2, np.int32)
    np.add.at(edge, np.maximum(starts - half, 0), 1)
    np.add.at(edge, starts + 1, -1)
    out = np.flatnonzero(np.cumsum(edge) > 0)
    return out[out <= n - 2 * half]


def _placed_in_batch(docs: DataFrame, width: int) -> DataFrame:
    """``o, h, id, text, n_words``; later copies of a text inside a batch keep no text.

    ``o`` orders the documents: their id, and for null ids numbers behind all
    others. Texts without a window are no copies: they lose nothing.
    """

    def make():
        import xxhash

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column(0)
            texts, own = batch.column(1).to_pylist(), ids.to_pylist()
            h = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in texts), np.uint64, len(texts))
            behind = ((1 << 63) - 1 - (h >> np.uint64(20)).astype(np.int64)).tolist()
            o = [behind[n] if i is None else i for n, i in enumerate(own)]
            words = np.fromiter(
                (len(t.encode("utf-8", "replace").split()) for t in texts), np.int64, len(texts)
            )
            seen: set[str] = set()
            kept: list[str | None] = list(texts)
            for row in np.argsort(np.array(o, np.int64), kind="stable").tolist():
                if words[row] >= width and texts[row] in seen:
                    kept[row] = None
                seen.add(texts[row])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(o, pa.int64()),
                    pa.array(h.view(np.int64)),
                    ids,
                    pa.array(kept, pa.string()),
                    pa.array(words),
                ],
                ["o", "h", "id", "text", "n_words"],
            )

        return each

    schema = "o long, h long, id long, text string, n_words long"
    return map_batches(docs, make, schema, limit=32 << 20)


def documents_table(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """All rows, written once and bucketed by ``o``; ``tie`` tells rows of one ``o`` apart."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _placed_in_batch(id_and_text(docs, id_col, text_col), width).repartition(buckets, "o")
    tie = F.row_number().over(Window.partitionBy("o").orderBy("h")) - 1
    rows = rows.withColumn("tie", tie.cast("long")).drop("h")
    name = f"substring_texts_{uuid.uuid4().hex}"
    writer = rows.write.bucketBy(buckets, "o").sortBy("o").option("compression", "zstd")
    writer.option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def _settled(
    hashes: list[np.ndarray], docs: list[tuple[int, int]], starts: list[np.ndarray]
) -> pa.RecordBatch:
    """Rows ``key, mark, o, at`` for the windows of a batch; ``docs`` come in their order.

    ``at`` is the tie in the upper and the start in the lower half. The first of
    equal windows keeps their hash as ``key``; ``mark`` is 1 if there were
    others and 0 if not. The others are known to repeat: runs of them one word
    apart are one row with a key of its own and 1 plus the run's length as mark.
    """
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    key = np.concatenate([np.empty(0, np.uint64), *hashes])
    o = np.repeat(np.array([d[0] for d in docs], np.int64), sizes)
    tie = np.repeat(np.array([d[1] for d in docs], np.int64), sizes)
    at = (tie << 32) + np.concatenate([np.empty(0, np.int64), *starts])
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    head = np.r_[True, ordered[1:] != ordered[:-1]] if len(key) else np.empty(0, bool)
    known = np.zeros(len(key), bool)
    known[order] = ~head
    counts = np.diff(np.r_[np.flatnonzero(head), len(key)])
    mark = np.zeros(len(key), np.int32)
    mark[order] = np.repeat(counts > 1, counts)
    goes_on = np.zeros(len(key), bool)
    goes_on[1:] = known[1:] & known[:-1] & (o[1:] == o[:-1]) & (at[1:] == at[:-1] + 1)
    begins = np.flatnonzero(~goes_on)
    runs = np.diff(np.r_[begins, len(key)])
    key, known, mark, o, at = (x[begins] for x in (key, known, mark, o, at))
    mark = np.where(known, 1 + runs, mark).astype(np.int32)
    own = mixed(key ^ mixed(o.view(np.uint64) + at.astype(np.uint64) + np.uint64(1)))
    key = np.where(known, own, key)
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(mark), pa.array(o), pa.array(at)],
        ["key", "mark", "o", "at"],
    )


def own_starts(found: pa.ListScalar, tie: int) -> np.ndarray:
    """Sorted starts of one text from the ``at`` and ``run`` of its document."""
    items = found.values
    at, run = (items.field(k).to_numpy().astype(np.int64) for k in range(2))
    mine = at >> 32 == tie
    at, run = at[mine] & 0xFFFFFFFF, run[mine]
    ends = np.cumsum(run)
    total = int(ends[-1]) if len(ends) else 0
    return np.unique(np.repeat(at - (ends - run), run) + np.arange(total))


def windows(
    texts: DataFrame,
    pick: Callable[[np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray]],
) -> DataFrame:
    """Rows of ``_settled`` for the windows that ``pick`` takes of each text.

    ``pick`` gets the hashes of a text's words and its surviving starts, and
    returns window hashes and their starts, in order.
    """
    has_found = "found" in texts.columns
    ship_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = WordHashes().of
        for batch in batches:
            rows = []
            for part in slices(batch):
                found = part.column("found") if has_found else None
                for n, (o, tie, text) in enumerate(
                    zip(*(part.column(c).to_pylist() for c in ("o", "tie", "text")), strict=True)
                ):
                    survivors = None if found is None else own_starts(found[n], tie)
                    words = of(text.encode("utf-8", "replace").split())
                    rows.append(((o, tie), *pick(words, survivors)))
            rows.sort(key=lambda r: r[0])
            yield _settled([r[1] for r in rows], [r[0] for r in rows], [r[2] for r in rows])

    own = texts.select("o", "tie", "text", *(["found"] if has_found else []))
    return own.mapInArrow(run, "key long, mark int, o long, at long")


def by_document(rows: DataFrame) -> DataFrame:
    """``o, found``: the windows of each document."""
    run = F.greatest(F.col("mark") - 1, F.lit(1)).alias("run")
    return rows.groupBy("o").agg(F.collect_list(F.struct("at", run)).alias("found"))


def repeated(rows: DataFrame) -> DataFrame:
    """``o, found``: the windows that stand more than once."""
    same = Window.partitionBy("key")
    counted = rows.withColumn("times", F.count("*").over(same)).withColumn(
        "any", F.max("mark").over(same)
    )
    return by_document(counted.where((F.col("any") > 0) | (F.col("times") > 1)))


def not_first(rows: DataFrame) -> DataFrame:
    """``o, found``: the windows that also start earlier."""
    same = Window.partitionBy("key").orderBy("o", "at")
    later = rows.withColumn("place", F.row_number().over(same))
    return by_document(later.where((F.col("mark") > 1) | (F.col("place") > 1)))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that begins at one of the starts."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH
) -> DataFrame:
    """``id, n_words, n_removed, kept`` for every row; ``kept`` joins the words left by a blank."""
    if width % 4:
        raise ValueError("the width must be a multiple of four")
    quarter, half = width // 4, width // 2
    table = documents_table(docs, id_col, text_col, width)
    texts = table.where(F.col("text").isNotNull() & (F.col("n_words") >= width))

    def first_level(words, _):
        g = window_hashes(words, quarter)
        at = chosen(g, width - quarter + 1)
        return g[at], at

    def half_level(words, starts):
        at = halves(starts[starts <= len(words) - quarter], quarter, len(words))
        return window_hashes(words, half)[at], at

    def full_level(words, starts):
        at = holders(starts[starts <= len(words) - half], half, len(words))
        return window_hashes(words, width)[at], at

    found = repeated(windows(texts, first_level))
    found = repeated(windows(texts.join(found, "o"), half_level))
    last = not_first(windows(texts.join(found, "o"), full_level))
    marked = table.join(last, "o", "left").select("id", "text", "n_words", "tie", "found")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            removed, kept = [], []
            texts, sizes = (batch.column(c).to_pylist() for c in (1, 2))
            ties, found = batch.column(3).to_pylist(), batch.column(4)
            for text, n, tie, own in zip(texts, sizes, ties, found, strict=True):
                if text is None:
                    # a copy of an earlier text: each of its windows starts there already
                    removed.append(n)
                    kept.append("")
                    continue
                words = text.encode("utf-8", "replace").split()
                if own.is_valid and n >= width:
                    gone = covered(own_starts(own, tie), width, n)
                    removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    removed.append(0)
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["id", "n_words", "n_removed", "kept"],
            )

        return each

    return map_batches(marked, make, "id long, n_words long, n_removed long, kept string")
