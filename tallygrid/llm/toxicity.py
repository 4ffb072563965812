"""Toxicity by compression distance between two zstandard dictionaries.

A toxic and an ordinary dictionary share the same ordinary prose; the toxic one
ends with byte segments that toxic texts hold far more often than ordinary
ones, the other with as many bytes of the reverse. Every text is cut into short
windows at blanks. What a window loses in compressed length under the toxic
dictionary against the ordinary one is its margin; a calibrated logistic curve
over a text's margins (largest, top three, mean, shares above steps) is its score.

``fit`` learns from a bounded sample of labelled texts, ``per_class`` of each
class in the order of a hash of their ids; smaller classes are taken whole.
Segments are chosen like a covering dictionary, best contrast first, skipping
what a chosen segment already holds; contrasts as weak as the best reverse one
are noise and stay out. Each half of the sample trains a pair of dictionaries,
whose curve is calibrated on the other half, weighted to the true class shares;
a text's score is the mean of both. So the curve always belongs to margins of
unseen texts under the very dictionaries that it is used with.

Cases: a null or empty text has no windows and gets the score of zero margins;
labels that are null are ignored, repeated labels of an id count once (toxic if
any says so); without both classes to learn from, every score is the share of
toxic labels, 0 without labels. Repeated rows and null ids keep their rows. A
text of any length is read whole, window by window. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ship_package, written
from .text import id_and_text, map_batches, released, slices

# labelled texts of each class that the dictionaries and the curve learn from
PER_CLASS = 4000
WINDOW = 64
LEVEL = 6
SEGMENT_SIZES = (5, 6, 8)
SEGMENT_BYTES = 4096
PROSE_BYTES = 8192
# times the best reverse contrast that a segment must have
ABOVE_NOISE = 1.5
STEPS = (2, 3, 4)
FEATURES = 4 + len(STEPS) + 1

# ASCII letters in lower case and everything beyond ASCII
TOKEN = re.compile(rb"[a-z\x80-\xff]+")


def segments_of(text: str) -> set[bytes]:
    """Byte runs of the words of a text, each word with the blank before it."""
    out = set()
    for word in set(TOKEN.findall(text.encode("utf-8", "replace").lower())):
        word = b" " + word
        for size in SEGMENT_SIZES:
            if len(word) < size:
                out.add(word + b" ")
                break
            out.update(word[i : i + size] for i in range(len(word) - size + 1))
        if len(word) <= max(SEGMENT_SIZES):
            out.add(word + b" ")
    return out


def windows_of(data: bytes) -> list[tuple[int, int]]:
    """Start and length of windows that end at the first blank after ``WINDOW`` bytes."""
    out, at, size = [], 0, len(data)
    while at < size:
        end = at + WINDOW
        if end < size:
            blank = data.find(b" ", end, end + WINDOW)
            end = end + WINDOW if blank < 0 else blank
        end = min(end, size)
        out.append((at, end - at))
        at = end
    return out


@dataclass(frozen=True)
class Dictionaries:
    toxic: bytes
    ordinary: bytes


class Margins:
    """Features of texts from the compressed lengths of their windows."""

    def __init__(self, pair: Dictionaries):
        self.compressors = []
        for content in (pair.ordinary, pair.toxic):
            primed = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            self.compressors.append(
                zstd.ZstdCompressor(
                    level=LEVEL,
                    dict_data=primed,
                    write_content_size=False,
                    write_checksum=False,
                    write_dict_id=False,
                )
            )

    def of(self, texts: list[str]) -> np.ndarray:
        data = [t.encode("utf-8", "replace").lower() for t in texts]
        windows = [windows_of(d) for d in data]
        counts = np.fromiter(map(len, windows), np.int64, len(windows))
        out = np.zeros((len(texts), FEATURES))
        if not counts.sum():
            return out
        begins = np.repeat(np.r_[0, np.cumsum([len(d) for d in data])[:-1]], counts)
        places = np.array([w for own in windows for w in own], np.int64)
        places[:, 0] += begins
        held = zstd.BufferWithSegments(b"".join(data), places.astype(np.uint64).tobytes())
        ordinary, toxic = (
            np.fromiter(map(len, c.multi_compress_to_buffer(held)), np.int64, len(places))
            for c in self.compressors
        )
        margins, upto = (ordinary - toxic).astype(float), 0
        for row, n in enumerate(counts):
            own = np.sort(margins[upto : upto + n])[::-1]
            upto += n
            if n:
                out[row] = [
                    own[0],
                    own[:3].mean(),
                    own.sum() / np.sqrt(n),
                    own.mean(),
                    *[(own >= s).mean() for s in STEPS],
                    np.log1p(n),
                ]
        return out


@dataclass(frozen=True)
class Calibrated:
    """A pair of dictionaries and the curve that was fitted to their margins."""

    dictionaries: Dictionaries
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = np.c_[np.ones(len(features)), (features - self.centre) / self.scale] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class ToxicityModel:
    parts: tuple[Calibrated, ...]


class Scorer:
    """Mean score of a model's parts; built in the task, as compressors do not travel."""

    def __init__(self, model: ToxicityModel):
        self.parts = [(Margins(p.dictionaries), p) for p in model.parts]

    def of(self, texts: list[str]) -> np.ndarray:
        return np.mean([p.scores(margins.of(texts)) for margins, p in self.parts], axis=0)


def curve(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.01):
    """Centre, scale and weights of a logistic curve by Newton's method; ``n`` are weights."""
    n = n / n.sum()
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - centre) / scale]
    w, free = np.zeros(z.shape[1]), np.r_[0.0, np.ones(x.shape[1])]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (n * (p - y)) + ridge * free * w
        bend = (z.T * (n * p * (1 - p))) @ z + ridge * np.diag(free) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


def labelled_sample(
    docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str
) -> tuple[DataFrame, dict[int, int]]:
    """``text, toxic, fold`` of the sampled texts, and how many labels each class has."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col(f"`{id_col}`").isNotNull())
        .groupBy(F.col(f"`{id_col}`").cast("long").alias("id"))
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64("id")
    chosen = [known.where(F.col("toxic") == c).orderBy(order, "id").limit(per_class) for c in (0, 1)]
    # at most two times per_class rows
    few = F.broadcast(chosen[0].unionByName(chosen[1]))
    sample = id_and_text(docs, id_col, text_col).join(few, "id")
    fold = F.pmod(F.shiftright(order, 20), F.lit(2)).cast("int")
    return written(sample.select("text", "toxic", fold.alias("fold")), "toxicity-sample"), totals


def segment_counts(sample: DataFrame) -> DataFrame:
    """``segment`` and the number of texts with it by class and fold: ``t0, t1, o0, o1``."""
    ship_package(sample.sparkSession)

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for text, toxic, fold in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    group = f"{'ot'[toxic]}{fold}"
                    held.update((s, group) for s in segments_of(text))
            if len(held) > 500_000:
                yield packed(held)
                held = Counter()
        yield packed(held)

    def packed(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([s for s, _ in held], pa.binary()),
                pa.array([g for _, g in held], pa.string()),
                pa.array(held.values(), pa.int64()),
            ],
            ["segment", "part", "n"],
        )

    own = sample.mapInArrow(released(count), "segment binary, part string, n long")
    return own.groupBy("segment").agg(
        *[
            F.sum(F.when(F.col("part") == p, F.col("n")).otherwise(0)).alias(p)
            for p in ("t0", "t1", "o0", "o1")
        ]
    )


def contrast(a: Column, size_a: int, b: Column, size_b: int) -> Column:
    """Share of the first class with a segment, times how much oftener it has it (log).

    Shares, not counts, so that classes of unequal size compare both ways.
    """
    return a / max(size_a, 1) * F.log((a + 0.5) / (size_a + 1) / ((b + 0.5) / (size_b + 1)))


def covering(rows: list[tuple[float, bytes]], size: int, floor: float) -> list[bytes]:
    """The best segments that no better one holds, up to ``size`` bytes."""
    out: list[bytes] = []
    for score, segment in sorted(rows, key=lambda r: (-round(r[0], 3), -len(r[1]), r[1])):
        if score < floor or sum(map(len, out)) > size:
            break
        if not any(segment.strip() in held for held in out):
            out.append(segment)
    return out


def dictionaries(counts: DataFrame, sizes: dict[str, int], fold: int, prose: bytes) -> Dictionaries:
    """Both dictionaries from the counts of one fold."""
    best = {}
    for a, b in ("to", "ot"):
        own, other = f"{a}{fold}", f"{b}{fold}"
        score = contrast(F.col(own), sizes[own], F.col(other), sizes[other])
        rows = counts.select(score.alias("score"), "segment").where(F.col("score") > 0)
        top = rows.orderBy(F.desc("score"), "segment").limit(SEGMENT_BYTES).collect()
        best[a] = [(r.score, bytes(r.segment)) for r in top]
    noise = best["o"][0][0] if best["o"] else 0.0
    toxic = covering(best["t"], SEGMENT_BYTES, ABOVE_NOISE * noise)
    ordinary = covering(best["o"], sum(map(len, toxic)), 0.0)
    return Dictionaries(*(prose + b" ".join(reversed(x)) + b" " for x in (toxic, ordinary)))


def features(texts: DataFrame, pair: Dictionaries) -> DataFrame:
    """``features array<double>`` for every row, beside the other columns; the text goes."""
    others = [c for c in texts.columns if c != "text"]
    schema = ", ".join(f"{c} {t}" for c, t in texts.select(*others).dtypes)

    def make():
        margins = Margins(pair)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = margins.of(batch.column("text").to_pylist())
            kept = [batch.column(c) for c in others]
            return pa.RecordBatch.from_arrays(
                [*kept, pa.array(found.tolist(), pa.list_(pa.float64()))], [*others, "features"]
            )

        return each

    return map_batches(texts, make, f"{schema}, features array<double>")


def prose_pieces(sample: DataFrame) -> DataFrame:
    """Beginnings of 64 texts that are not toxic; no more of them than is used leaves the tasks."""
    text = F.lower(F.regexp_replace("text", r"\s+", " "))
    return (
        sample.where("toxic = 0")
        .select(F.xxhash64(text).alias("h"), F.substring(text, 1, PROSE_BYTES).alias("text"))
        .orderBy("h")
        .limit(64)
        .select("text")
    )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_class: int = PER_CLASS,
) -> ToxicityModel:
    """Dictionaries and curve from a bounded sample of the labelled texts."""
    sample, totals = labelled_sample(docs, labels, per_class, id_col, text_col)
    groups = sample.groupBy("toxic", "fold").count().collect()
    sizes = {f"{'ot'[r.toxic]}{r.fold}": r["count"] for r in groups}
    share = totals.get(1, 0) / max(sum(totals.values()), 1)
    odds = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
    if not all(f"{g}{f}" in sizes for f in (0, 1) for g in "to"):
        level = (np.zeros(FEATURES), np.ones(FEATURES), np.r_[odds, np.zeros(FEATURES)])
        return ToxicityModel((Calibrated(Dictionaries(b" " * 8, b" " * 8), *level),))
    counts = written(segment_counts(sample), "toxicity-segments")
    pieces = prose_pieces(sample).collect()
    each = PROSE_BYTES // max(len(pieces), 1)
    prose = b" ".join(p.text.encode()[:each] for p in pieces)
    parts = []
    for fold in (0, 1):
        pair = dictionaries(counts, sizes, 1 - fold, prose)
        rows = features(sample.where(F.col("fold") == fold).select("text", "toxic"), pair).collect()
        x, y = np.array([r.features for r in rows]), np.array([r.toxic for r in rows], float)
        weight = np.where(y == 1, totals[1] / y.sum(), totals[0] / (1 - y).sum())
        parts.append(Calibrated(pair, *curve(x, y, weight)))
    return ToxicityModel(tuple(parts))


def score(
    docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id`` and ``score`` (0 to 1) for every row of ``docs``."""

    def make():
        scorer = Scorer(model)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = scorer.of(batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "score"])

        return each

    return map_batches(id_and_text(docs, id_col, text_col), make, "id long, score double")


def without_toxic(
    docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    ship_package(docs.sparkSession)

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch):
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                keep = scorer.of([t or "" for t in texts]) < threshold
                yield part.filter(pa.array(keep))

    kept = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    return kept.mapInArrow(released(run), kept.schema)
