"""Secret scan by dictionary-primed compression novelty.

Three fixed patterns give the base spans. Beside them, every long token near a
word such as "key" or "password" is a candidate. It is reported when it is
incompressible: its text before it and a dictionary of code words and of the
corpus's most frequent identifiers prime zstandard, and the bytes that the
candidate adds to the compressed length are compared with its own length.
Identifiers, repeated values and prose add few bytes; random keys add about
three quarters of a byte a character or more.

The identifier dictionary counts identifiers over all texts: tasks count their
own, a shuffle sums, and the most frequent ones (``DICTIONARY_WORDS``) go to
the driver and back as a dictionary of bounded size.

Cases: a null or empty text has no spans. Equal texts get equal spans; repeated
rows and null ids keep their rows. A text of any length is scanned whole, one at
a time. An empty table gives an empty result, with a dictionary of the code words
alone. Other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, functions as F

from ..session import ship_package
from .spans import ARROW_SPANS, SPANS, outside
from .text import id_and_text, map_batches

KINDS = ("assign", "access", "hex")
NOVEL = "novel"

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# runs shorter than 32 are no spans, so they need not be matched at all
HEX = re.compile(r"[0-9a-f]{32,}")
# the longest words of the sensitive contexts; matched without regard to case
SENSITIVE = re.compile(
    r"password|passwd|passphrase|pwd|secret|token|api[ _-]?key|private[ _-]?key|access[ _-]?key|"
    r"credential|bearer|authorization|signature|client[ _-]?id|connection[ _-]?string",
    re.ASCII | re.IGNORECASE,
)
SHORTEST = 16
TOKEN = re.compile(rf"[A-Za-z0-9+/_=.~-]{{{SHORTEST},}}")
# how far behind the sensitive word a candidate may begin
REACH = 48
# text before a candidate that primes the compressor
CONTEXT = 256
NOVELTY = 0.55
DICTIONARY_WORDS = 4096
# letters alone, as random keys are mixed with digits; and fewest occurrences
IDENTIFIER = re.compile(rb"[A-Za-z_]{3,}")
LEAST_OCCURRENCES = 5
# distinct identifiers a task holds before it hands its counts on
HELD = 300_000

CODE_WORDS = (
    "abstract async await boolean break case catch class const continue default def delete double "
    "else enum except export extends final finally float for from function global if implements "
    "import in include instanceof int interface lambda let long new none null package pass print "
    "private protected public raise return self static string struct super switch this throw throws "
    "true false try type typedef union unsigned using var virtual void while with yield config "
    "environment localhost example username password secret token api_key access_key client_id "
    "Authorization Bearer https://www. .com .org .example index value object array length count "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)


def identifier_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, n``: how often each identifier of the texts occurs, over all rows."""
    ship_package(docs.sparkSession)

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    held.update(IDENTIFIER.findall(text.as_buffer()))
            if len(held) > HELD:
                yield packed(held)
                held = Counter()
        yield packed(held)

    def packed(held: Counter) -> pa.RecordBatch:
        words = pa.array(list(held), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], ["word", "n"])

    own = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    return own.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def identifier_dictionary(docs: DataFrame, text_col: str = "text") -> bytes:
    """Raw dictionary content: code words, then identifiers, the most frequent last."""
    top = (
        identifier_counts(docs, text_col)
        .where(F.col("n") >= LEAST_OCCURRENCES)
        .orderBy(F.desc("n"), "word")
        .limit(DICTIONARY_WORDS)
        .collect()
    )
    return f"{CODE_WORDS} {' '.join(r.word for r in reversed(top))}".encode()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the pattern spans, by start and then kind."""
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Long tokens that begin within reach of a sensitive word's end, read to their own ends."""
    found: dict[int, int] = {}
    runs = begins = None
    for word in SENSITIVE.finditer(text):
        if runs is None:
            # once for the text: searching on from every word would take square time
            runs = [m.span() for m in TOKEN.finditer(text)]
            begins = [start for start, _ in runs]
        at = bisect_left(begins, word.end())
        # a token may be what is left of the run in which the word stands
        if at and runs[at - 1][1] - word.end() >= SHORTEST:
            found[word.end()] = runs[at - 1][1]
        while at < len(runs) and begins[at] <= word.end() + REACH:
            found[begins[at]] = runs[at][1]
            at += 1
    return sorted(found.items())


class Novelty:
    """Bytes that a string adds to what a primed compressor makes of its context."""

    def __init__(self, dictionary: bytes, level: int = 3):
        primed = zstd.ZstdCompressionDict(dictionary, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=level)
        self.compress = zstd.ZstdCompressor(
            dict_data=primed, write_content_size=False, write_checksum=False
        ).compress

    def of(self, text: str, start: int, end: int) -> float:
        before = text[max(0, start - CONTEXT) : start].encode("utf-8", "replace")
        own = text[start:end].encode("utf-8", "replace")
        return (len(self.compress(before + own)) - len(self.compress(before))) / max(len(own), 1)


def scan(
    docs: DataFrame,
    dictionary: bytes,
    id_col: str = "doc_id",
    text_col: str = "text",
    novelty: float = NOVELTY,
) -> DataFrame:
    """``id`` and ``spans`` by start and kind; ``score`` is the novelty of the span's value."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)

    def make():
        novel = Novelty(shared.value)

        def spans(text: str) -> list[dict]:
            base = base_spans(text)
            out = [(s, e, kind, True, novel.of(text, s, e)) for s, e, kind in base]
            free = outside(candidates(text), [(s, e) for s, e, _ in base])
            for s, e in free:
                if (x := novel.of(text, s, e)) >= novelty:
                    out.append((s, e, NOVEL, False, x))
            order = (*KINDS, NOVEL)
            out.sort(key=lambda x: (x[0], order.index(x[2])))
            return [
                {"kind": k, "start": s, "end": e, "base": b, "score": x} for s, e, k, b, x in out
            ]

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = pa.array([spans(x) for x in batch.column(1).to_pylist()], ARROW_SPANS)
            return pa.RecordBatch.from_arrays([batch.column(0), found], ["id", "spans"])

        return each

    return map_batches(id_and_text(docs, id_col, text_col), make, SPANS)
