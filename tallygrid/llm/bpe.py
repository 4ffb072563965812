"""Byte-pair encoding and decoding with the tables of a public tokenizer file.

The file is read on the driver and its tables (a few MB, fixed by the
vocabulary) are broadcast. A task splits its texts into pieces, looks up pieces
it has met, and merges the new ones of a batch together: their symbols stand in
one flat array, every round finds each piece's lowest-ranked pair by binary
search over the sorted pair keys and merges it wherever the piece has it.

Cases: a null or empty text, or one of white space only, has no ids and decodes
to the empty string. Special tokens written in a text become their id. Repeated
rows and null ids keep their rows; an empty table gives an empty result. A text
of any length is encoded whole; a run of tens of thousands of letters without a
break is one piece, and its rounds take longer than its length tells.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .text import id_and_text, map_batches

NO_PAIR = np.int64(2**62)
# pieces a task remembers before it begins anew
REMEMBERED = 150_000
# fixed values: letters of the regex module (Unicode 17) that public tokenizers take for
# symbols, found by comparing both over all code points
NEWER = (
    "\U00000558\U0000058b-\U0000058c\U0000088f\U00000c5c\U00000cdc\U0000208f"
    "\U0000209d-\U0000209f\U0000a7ce-\U0000a7cf\U0000a7d2\U0000a7d4\U0000a7e2\U0000a7f1"
    "\U0000ab6c-\U0000ab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010d50-\U00010d65"
    "\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011df1"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff"
    "\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    "\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24"
    "\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    "\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
# white space of the file's `\s`
SPACE = "\t\n\v\f\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


@dataclass(frozen=True)
class Tables:
    """What encoding and decoding need of a tokenizer file."""

    tokens: list[str]
    specials: dict[str, int]
    pieces: tuple[str, str]
    first: np.ndarray  # id of each byte inside a piece
    last: np.ndarray  # id of each byte at the end of a piece
    keys: np.ndarray  # sorted pair keys: left id * size + right id
    ranks: np.ndarray
    merged: np.ndarray  # id of the merged symbol, by rank

    @property
    def size(self) -> int:
        return len(self.tokens)


def read_tables(path: str | Path) -> Tables:
    """Tables of a BPE file with NFC, lower case and word ends; others are refused."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    model, before = spec["model"], spec["normalizer"] or {}
    steps = [s["type"] for s in before.get("normalizers", [])]
    splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    kinds = [s["type"] for s in splits]
    if (model["type"], steps, kinds, spec["decoder"]) != (
        "BPE",
        ["NFC", "Replace", "Lowercase"],
        ["Split", "ByteLevel"],
        None,
    ):
        raise ValueError(f"{path}: another kind of tokenizer")
    vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    names = {i: t for t, i in (vocab | specials).items()}
    tokens = [names.get(i, "") for i in range(max(names) + 1)]
    symbols = byte_symbols()
    pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]], np.int64)
    keys = pairs[:, 0] * len(tokens) + pairs[:, 1]
    order = np.argsort(keys, kind="stable")
    return Tables(
        tokens=tokens,
        specials=specials,
        pieces=piece_patterns(splits[0]["pattern"]["Regex"]),
        first=np.array([vocab[s] for s in symbols], np.int64),
        last=np.array([vocab[s + end] for s in symbols], np.int64),
        keys=keys[order],
        ranks=order.astype(np.int64),
        merged=pairs[:, 2],
    )


def piece_patterns(pattern: str) -> tuple[str, str]:
    """The file's pattern: as it stands, and without the letters it does not know."""
    pattern = pattern.replace(r"^\s", f"^{SPACE}")
    plain = pattern.replace(r"[\p{L}]", f"[\\p{{L}}--[{NEWER}]]")
    return pattern, plain.replace(r"\p{L}\p{N}]", f"[\\p{{L}}\\p{{N}}--[{NEWER}]]]")


def normalized(text: str) -> str:
    """NFC and lower case, one code point at a time (no rule for a final sigma)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


def merge_pieces(pieces: list[bytes], t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Ids of non-empty pieces as one flat array and its offsets."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    ids, ends = t.first[raw], np.cumsum(lengths)
    ids[ends - 1] = t.last[raw[ends - 1]]
    piece = np.repeat(np.arange(len(pieces)), lengths)
    done_ids, done_piece = [], []
    while len(ids):
        rank = np.full(len(ids), NO_PAIR)
        key = ids[:-1] * t.size + ids[1:]
        at = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
        known = (t.keys[at] == key) & (piece[:-1] == piece[1:])
        rank[:-1][known] = t.ranks[at[known]]
        starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
        sizes = np.diff(np.r_[starts, len(ids)])
        best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
        final = best == NO_PAIR
        if final.any():
            done_ids.append(ids[final])
            done_piece.append(piece[final])
        hit = np.flatnonzero((rank == best) & ~final)
        # in a run of equal symbols every second pair is free
        run = np.r_[True, np.diff(hit) != 1] if len(hit) else np.empty(0, bool)
        begun = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - begun) % 2 == 0]
        ids[hit] = t.merged[rank[hit]]
        keep = ~final
        keep[hit + 1] = False
        ids, piece = ids[keep], piece[keep]
    if not done_ids:
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    flat, owner = np.concatenate(done_ids), np.concatenate(done_piece)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(pieces))
    return flat[order], np.r_[0, np.cumsum(counts)]


def gathered(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen rows of a flat array with offsets, one after the other, and their sizes."""
    sizes = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(offsets[rows] - (ends - sizes), sizes)], sizes


class Encoder:
    """Encodes batches of texts; remembers pieces between batches."""

    def __init__(self, tables: Tables):
        self.t = tables
        usual, older = (regex.compile(p, regex.V1).findall for p in tables.pieces)
        newer = re.compile(f"[{NEWER}]").search
        self.find = lambda text: (usual if text.isascii() or not newer(text) else older)(text)
        self.special = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(tables.specials, key=len, reverse=True))) + ")"
        )
        self._forget()

    def _forget(self) -> None:
        # the specials come first and are never merged
        self.known = {s: n for n, s in enumerate(self.t.specials)}
        self.flat = np.array(list(self.t.specials.values()), np.int64)
        self.offsets = np.arange(len(self.known) + 1)

    def _pieces(self, text: str) -> list[str]:
        if not any(s in text for s in self.t.specials):
            return self.find(normalized(text))
        out: list[str] = []
        for n, part in enumerate(self.special.split(text)):
            out += [part] if n % 2 else self.find(normalized(part))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and its offsets by text."""
        if len(self.known) > REMEMBERED:
            self._forget()
        pieces = [self._pieces(x) for x in texts]
        fresh = [p for p in dict.fromkeys(p for own in pieces for p in own) if p not in self.known]
        if fresh:
            flat, offsets = merge_pieces([p.encode("utf-8", "replace") for p in fresh], self.t)
            base = len(self.known)
            self.known.update((p, base + n) for n, p in enumerate(fresh))
            self.offsets = np.r_[self.offsets, offsets[1:] + len(self.flat)]
            self.flat = np.r_[self.flat, flat]
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        look = self.known.__getitem__
        rows = np.fromiter((look(p) for own in pieces for p in own), np.int64, int(counts.sum()))
        ids, sizes = gathered(self.flat, self.offsets, rows)
        upto = np.r_[0, np.cumsum(sizes)]
        return ids, upto[np.r_[0, np.cumsum(counts)]]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``ids array<int>`` for every row of ``docs``."""
    tables = docs.sparkSession.sparkContext.broadcast(read_tables(path))

    def make():
        encoder = Encoder(tables.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, offsets = encoder.encode(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(
                pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))
            )
            return pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "ids"])

        return each

    return map_batches(id_and_text(docs, id_col, text_col), make, "id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``id``, ``ids`` and ``text``: the tokens of the ids joined by a blank.

    The file names no decoder, and then tokens are joined as they stand, with
    their word ends and byte characters. Ids without a token raise.
    """
    tables = encoded.sparkSession.sparkContext.broadcast(read_tables(path))

    def make():
        names = pa.array(tables.value.tokens)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(1)
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            joined = pc.binary_join(
                pa.ListArray.from_arrays(offsets, names.take(lists.flatten())), " "
            )
            return pa.RecordBatch.from_arrays([batch.column(0), lists, joined], ["id", "ids", "text"])

        return each

    return map_batches(encoded.select("id", "ids"), make, "id long, ids array<int>, text string")


def digests(decoded: DataFrame, *others: str) -> DataFrame:
    """Counts and hashes of ids and decoded texts, and the other columns named."""
    return decoded.select(
        F.col("id").alias("doc_id"),
        *others,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
