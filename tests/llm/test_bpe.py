import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallygrid.llm import bpe
from tallygrid.llm.queries import QUERIES, TOKENIZER


@pytest.fixture(scope="module")
def public():
    own = Tokenizer.from_file(TOKENIZER)
    own.no_truncation()
    own.no_padding()
    return own


TEXTS = [
    "",
    None,
    " \n\t ",
    "Hello, WORLD! it's 2024 and they'll've",
    "naïve café Straße ÇÁ ΑΣ ΣΊΣΥΦΟΣ İstanbul ﬁn",
    "<|endoftext|>a<|startoftext|> b<|endoftext",
    "aaaa" * 300,
    "word " * 3000,
    "漢字かな交じり文 😀😀 ​\x1c\x85 ½ ١٢٣",
    "x" * 20_000,
]


def test_ids_and_decoded_text_are_those_of_the_library(docs_of, public):
    decoded = bpe.decode(bpe.encode(docs_of(TEXTS), TOKENIZER), TOKENIZER)
    found = {r.id: r for r in decoded.collect()}
    for n, text in enumerate(TEXTS):
        ids = public.encode(text or "", add_special_tokens=False).ids
        assert found[n].ids == ids
        assert found[n].text == public.decode(ids, skip_special_tokens=False)


def test_whole_table_against_the_library(spark, tables, public):
    found = {r.doc_id: r for r in QUERIES["op6_bpe"](spark, tables).collect()}
    rows = spark.read.parquet(f"{tables}/documents.parquet").collect()
    assert len(found) == len(rows)
    for row in rows:
        ids = public.encode(row.text or "", add_special_tokens=False).ids
        own = found[row.doc_id]
        assert own.n_tokens == len(ids)
        assert own.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        text = public.decode(ids, skip_special_tokens=False)
        assert own.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_no_rows_and_repeated_rows(docs_of):
    assert bpe.encode(docs_of([]), TOKENIZER).count() == 0
    rows = bpe.encode(docs_of(["one two", "one two", "x"], [5, 5, None]), TOKENIZER).collect()
    assert sorted((r.id is None, len(r.ids)) for r in rows) == [(False, 2), (False, 2), (True, 1)]


def test_merges_do_not_depend_on_the_batch():
    tables = bpe.read_tables(TOKENIZER)
    pieces = [b"internationalisation", b"aaaaaaa", b"a", b"thethethe"]
    flat, offsets = bpe.merge_pieces(pieces, tables)
    for n, piece in enumerate(pieces):
        alone, _ = bpe.merge_pieces([piece], tables)
        assert np.array_equal(flat[offsets[n] : offsets[n + 1]], alone)


def test_pieces_are_forgotten_at_the_bound(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    encoder = bpe.Encoder(bpe.read_tables(TOKENIZER))
    first = [encoder.encode([f"w{n} same"])[0].tolist() for n in range(30)]
    again = [encoder.encode([f"w{n} same"])[0].tolist() for n in range(30)]
    assert first == again


def test_another_kind_of_file_is_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="another kind"):
        bpe.read_tables(public_tokenizers.path("byte_bpe_50k.json"))
