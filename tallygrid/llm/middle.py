"""Fill-in-the-middle transformation of documents, by one repeated-capture match a text.

A text is a sequence of units: a run of ASCII letters or one other code point.
One ``fullmatch`` of ``(unit)*`` with the ``regex`` library keeps every
repetition of its group, so ``ends(1)`` gives the number of units and both cut
offsets at once; nothing steps through the text. The unit is possessive, as a
run of letters is never divided.

Two hash values of the id choose how many units come before the middle part and
before the suffix, a third whether the text stays as it is, a fourth the order:
``psm`` writes ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` writes
``<S>`` suffix ``<P>`` prefix ``<M>`` middle. The marks share no beginning and
end, so that in a text without marks each stands exactly once in the output and
``restored`` finds the text again.

Cases: a null or empty text and one that holds a mark stay plain. Nothing but id
and text decides: repeated rows give equal rows, rows with a repeated id share
their hash values. A null id has the hash of no digits. A text of any length is
cut whole; a task holds one slice of texts (about a mebibyte) or one longer text
with the ends of its units, some 50 bytes for each. An empty table gives no
rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .text import id_and_text, map_batches

# fixed values: units, marks, and the shares of plain texts and of suffix-first ones
UNITS = r"([A-Za-z]++|[^A-Za-z])*+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM = 90
SUFFIX_FIRST_BELOW = 20

SCHEMA = (
    "id long, n long, form string, prefix_chars long, middle_chars long, output string"
)


def hash_values(id_: int | None) -> list[int]:
    """Four 32-bit values of an id."""
    digest = hashlib.sha256(f"1:{'' if id_ is None else id_}".encode()).digest()
    return [int.from_bytes(digest[n : n + 4], "big") for n in (0, 4, 8, 12)]


def cut(pattern, text: str, first: int, second: int) -> tuple[int, int, int]:
    """Number of units, and the offsets at which the middle part begins and ends."""
    ends = pattern.fullmatch(text).ends(1)
    n = len(ends)
    begin, end = sorted((first % (n + 1), second % (n + 1)))
    return n, ends[begin - 1] if begin else 0, ends[end - 1] if end else 0


def form_of(text: str, third: int, fourth: int) -> str:
    marked = any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE))
    if not text or marked or third % 100 >= PLAIN_FROM:
        return "plain"
    return "spm" if fourth % 100 < SUFFIX_FIRST_BELOW else "psm"


def arranged(form: str, text: str, begin: int, end: int) -> str:
    prefix, middle, suffix = text[:begin], text[begin:end], text[end:]
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    if form == "spm":
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return text


def restored(form: str, output: str) -> str:
    """The text behind an output."""
    if form == "plain":
        return output
    opening, between = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    front, middle = output.removeprefix(opening).split(MIDDLE)
    first, second = front.split(between)
    prefix, suffix = (first, second) if form == "psm" else (second, first)
    return prefix + middle + suffix


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` of every row; no offsets if plain."""

    def make():
        import regex

        pattern = regex.compile(UNITS)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = hash_values(id_)
                n, begin, end = cut(pattern, text, *values[:2])
                form = form_of(text, *values[2:])
                chars = (None, None) if form == "plain" else (begin, end - begin)
                rows.append((id_, n, form, *chars, arranged(form, text, begin, end)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

        return each

    return map_batches(id_and_text(docs, id_col, text_col), make, SCHEMA)


def restore(rows: DataFrame) -> DataFrame:
    """``rows`` (id, form, output) back to ``id, text``."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            forms, outputs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            texts = [restored(f, o) for f, o in zip(forms, outputs, strict=True)]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], ["id", "text"]
            )

        return each

    return map_batches(rows.select("id", "form", "output"), make, "id long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The transformed rows with the text ``restored`` from each output, in one pass."""
    rows = transform(docs, id_col, text_col)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            forms, outputs = (batch.column(name).to_pylist() for name in ("form", "output"))
            texts = [restored(f, o) for f, o in zip(forms, outputs, strict=True)]
            return pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "restored"]
            )

        return each

    return map_batches(rows, make, f"{SCHEMA}, restored string")
