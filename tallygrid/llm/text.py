"""Words, shingles and small helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ship_package

# fixed values: ASCII letters, and a word as a run without ASCII white space
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

SHINGLE = 5


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, as ``id`` and ``text`` (null: empty)."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z alone) words as UTF-8; bytes split on ASCII white space only."""
    return text.encode("utf-8", "replace").lower().split()


def words_column(text: Column | str) -> Column:
    """The same words as an array of strings, as a column expression."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _five(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i + n) for n in range(SHINGLE)]


def _shingles(words: Column, whole: Column, each) -> Column:
    size = F.size(words)
    return (
        F.when(size >= SHINGLE, F.transform(F.sequence(F.lit(0), size - SHINGLE), each))
        .when(size > 0, F.array(whole))
        .otherwise(F.slice(F.array(whole), 1, 0))
    )


def shingle_strings(words: str) -> Column:
    """Runs of five words as text; fewer words make one run, none make none."""
    w = F.col(words)
    return _shingles(w, F.array_join(w, " "), lambda i: F.concat_ws(" ", *_five(w, i)))


def shingle_hashes(words: str) -> Column:
    """64-bit hashes of the same runs, in order and with repetitions."""
    w = F.col(words)
    return _shingles(w, F.xxhash64(F.array_join(w, " ")), lambda i: F.xxhash64(*_five(w, i)))


# text that a task holds as Python objects at once
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes; a longer row comes alone."""
    ends = np.cumsum(
        sum(
            pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for c in batch.columns
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type)
        )
        + np.full(batch.num_rows, 64)
    )
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def release_memory() -> None:
    """Give memory that freed objects left with the allocators back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc alone has it
        trim(0)


def released(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, with its memory given back at the end of a task.

    Python workers wait for further tasks, and what they keep is missing in the stages that follow.
    """

    def run_and_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return run_and_release


def map_batches(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    schema: str,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Arrow batches through a function that each task builds once.

    Python holds one slice of a batch at a time. ``make`` runs in the task, so what it
    builds (compressors, caches) never travels.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            yield from map(each, slices(batch, limit))

    return df.mapInArrow(released(run), schema)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound and then begun anew."""

    LIMIT = 120_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


ODD = np.uint64(0x9E3779B97F4A7C15)


# one odd multiplier for each place of a short window
PLACES = mixed(np.arange(1, 9, dtype=np.uint64) * ODD) | np.uint64(1)


def short_windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for every run of up to eight words: a weighted sum, then mixed."""
    size = len(hashes) - width + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:size] * PLACES[0]
    for n in range(1, width):
        out += hashes[n : n + size] * PLACES[n]
    return mixed(out + np.uint64(width))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for every run of ``width`` words, order of the words included.

    Long runs are built by doubling: a run of 2k words from two runs of k words.
    """
    if width <= len(PLACES):
        return short_windows(hashes, width)
    if len(hashes) < width:
        return np.empty(0, np.uint64)
    half = window_hashes(hashes, width // 2)
    step = width // 2
    size = len(hashes) - width + 1
    out = mixed(half[:size] * ODD + half[step : step + size])
    # the last word of an odd width
    return mixed(out * ODD + hashes[width - 1 :]) if width % 2 else out


def parted(texts: Iterable[str], limit: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in runs of about ``limit`` characters."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def packed_texts(texts: list[str | None]) -> pa.Array:
    """The texts compressed one by one, for tables whose texts are shuffled."""
    import zstandard

    compressor = zstandard.ZstdCompressor()
    return pa.array([t if t is None else compressor.compress(t.encode()) for t in texts], pa.binary())


class ShingleSets:
    """Sorted distinct shingle hashes of texts; fewer words make one shingle, none make none."""

    def __init__(self) -> None:
        self.hashes = WordHashes()

    def of_column(self, column: pa.Array) -> list[np.ndarray]:
        """The sets of a column of texts, plain or compressed by ``packed_texts``."""
        texts = column.to_pylist()
        if pa.types.is_binary(column.type):
            import zstandard

            decompressor = zstandard.ZstdDecompressor()
            texts = (decompressor.decompress(t).decode() for t in texts)
        return [own for part in parted(texts) for own in self.of(part)]

    def of(self, texts: list[str]) -> list[np.ndarray]:
        words: list[bytes] = []
        ends = []
        for text in texts:
            words += words_of(text)
            ends.append(len(words))
        flat = self.hashes.of(words)
        runs = short_windows(flat, SHINGLE)
        out, begin = [], 0
        for end in ends:
            if end - begin >= SHINGLE:
                own = np.sort(runs[begin : end - SHINGLE + 1])
                out.append(own[np.r_[True, own[1:] != own[:-1]]])
            else:
                out.append(short_windows(flat[begin:end], end - begin) if end > begin else flat[:0])
            begin = end
        return out
