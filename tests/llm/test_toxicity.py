import zlib

import numpy as np
import pytest

from tallygrid.llm import toxicity
from tallygrid.llm.queries import QUERIES

WORDS = "stone river light garden under walking table after silver morning paper window".split()


def prose(rng, n, bad=()):
    words = rng.choice(WORDS, n).tolist()
    for word in bad:
        words.insert(int(rng.integers(len(words))), word)
    return " ".join(words)


@pytest.fixture(scope="module")
def trained(spark):
    rng = np.random.default_rng(3)
    rows = []
    for n in range(400):
        bad = rng.choice(["grumpfish", "scallywag", "blatherer"], 3).tolist() if n % 4 == 0 else []
        rows.append((n, prose(rng, 60, bad), int(n % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic").where("doc_id < 300")
    return docs, rows, toxicity.fit(docs.drop("toxic"), labels)


def test_unseen_documents_are_told_apart(trained):
    docs, rows, model = trained
    found = {r.id: r.score for r in toxicity.score(docs, model).collect()}
    unseen = [(found[n], toxic) for n, _, toxic in rows if n >= 300]
    assert np.mean([(s >= 0.5) == toxic for s, toxic in unseen]) >= 0.95
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {n for n in found if found[n] < 0.5}


def test_empty_null_long_and_repeated_texts(trained, docs_of):
    _, rows, model = trained
    texts = ["", None, rows[1][1] * 400, rows[0][1], rows[0][1], "é" * 1000]
    found = {r.id: r.score for r in toxicity.score(docs_of(texts), model).collect()}
    assert found[0] == found[1] and found[3] == found[4]
    assert all(0 <= s <= 1 for s in found.values())
    assert toxicity.score(docs_of([]), model).count() == 0
    assert toxicity.without_toxic(docs_of(texts), model).columns == docs_of(texts).columns


def test_without_labels_or_classes(spark, docs_of):
    docs = docs_of(["some text", None])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scores = {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()}
    assert len(scores) == 1 and scores.pop() < 0.5
    null = spark.createDataFrame([(0, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, null)).count() == 2


def test_columns_named_like_the_result(trained, spark):
    docs = spark.createDataFrame([(1, "a b", 9, "s")], "doc_id long, text string, score int, id string")
    row = toxicity.score(docs, trained[2]).first()
    assert row.id == 1 and 0 <= row.score <= 1


def test_windows_cover_the_text():
    data = b"word " * 100 + b"x" * 500
    windows = toxicity.windows_of(data)
    assert b"".join(data[a : a + n] for a, n in windows) == data
    assert max(n for _, n in windows) <= 2 * toxicity.WINDOW
    assert toxicity.windows_of(b"") == []


def test_covering_skips_what_it_holds_and_what_is_noise():
    rows = [(3.0, b" idiot "), (3.0, b"idio"), (2.0, b"other"), (0.1, b"noise")]
    assert toxicity.covering(rows, 100, 0.5) == [b" idiot ", b"other"]


def test_held_out_accuracy_of_the_query(spark, tables):
    found = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, tables).collect()}
    assert len(found) == spark.read.parquet(f"{tables}/documents.parquet").count()
    for row in found.values():
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)
        assert row.predicted == int(row.score >= 0.5)


def test_labels_of_the_held_out_fold_are_never_read(spark, tables):
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    assert labels.where("crc32(cast(doc_id as string)) % 5 = 0").count() > 0
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    learned = labels.where("crc32(cast(doc_id as string)) % 5 != 0")
    own = toxicity.score(docs, toxicity.fit(docs, learned)).collect()
    found = QUERIES["op9_toxicity"](spark, tables).collect()
    assert {r.id: r.score for r in own} == {r.doc_id: r.score for r in found}


def test_only_beginnings_of_prose_reach_the_driver(spark):
    texts = [f"Text {n}  " + "word " * (20_000 if n % 2 else 3) for n in range(70)]
    sample = spark.createDataFrame([(t, 0) for t in texts], "text string, toxic int")
    found = [r.text for r in toxicity.prose_pieces(sample).collect()]
    assert len(found) == 64 and max(map(len, found)) == toxicity.PROSE_BYTES
    whole = {" ".join(t.lower().split()) + " " for t in texts}
    assert all(any(w.startswith(f) for w in whole) for f in found)
