import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tallygrid.llm import decontaminate, fingerprint, shared
from tallygrid.llm.queries import QUERIES


def shingles(text):
    w = (text or "").encode().lower().split()
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def contained(docs, items):
    out = []
    for i, text in docs:
        own = shingles(text)
        for item, wanted in items:
            w = shingles(wanted)
            if w and 100 * len(w & own) >= 75 * len(w):
                out.append((i, item, len(w), len(w & own)))
    return out


def tables(spark, docs_of, seed=1):
    rng = random.Random(seed)
    items = [" ".join(f"i{rng.randrange(60)}" for _ in range(rng.randrange(1, 40))) for _ in range(30)]
    items += ["", None, "one two", items[3]]
    texts = ["", None, "ONE two", "one two three"]
    for _ in range(60):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(200))]
        if rng.random() < 0.6:
            inside = (rng.choice(items) or "").split()
            # parts of items and items with a changed word, too
            inside = inside[: max(1, int(len(inside) * rng.choice([0.6, 0.8, 1])))]
            if inside and rng.random() < 0.5:
                inside[rng.randrange(len(inside))] = "changed"
            words[len(words) // 2 : len(words) // 2] = inside
        texts.append(" ".join(words))
    texts += texts[10:13]
    bench = spark.createDataFrame(
        [(n, t, None) for n, t in enumerate(items)], "item_id long, text string, hash string"
    )
    return docs_of(texts), list(enumerate(texts)), bench, list(enumerate(items))


def test_pairs_and_filter_against_brute_force(spark, docs_of):
    docs, texts, bench, items = tables(spark, docs_of)
    found = decontaminate.contaminated_pairs(docs, bench).collect()
    wanted = contained(texts, items)
    assert sorted((r.id, r.item, r.n_item, r.n_shared) for r in found) == sorted(wanted)
    assert wanted
    left = decontaminate.without_contaminated(docs, bench)
    assert left.columns == docs.columns
    bad = {i for i, *_ in wanted}
    assert sorted(r.doc_id for r in left.collect()) == [i for i, _ in texts if i not in bad]


def test_repeated_items_keep_their_rows_and_do_not_add_up(spark, docs_of):
    words = [f"i{n}" for n in range(24)]
    item = " ".join(words)
    texts = ["a b c " + item, "a b c " + " ".join(words[:14]) + " d e f", "none of it at all"]
    bench = spark.createDataFrame([(1, item), (1, item), (2, item)], "item_id long, text string")
    found = decontaminate.contaminated_pairs(docs_of(texts), bench).collect()
    assert sorted((r.id, r.item, r.n_item, r.n_shared) for r in found) == [
        (0, 1, 20, 20), (0, 1, 20, 20), (0, 2, 20, 20)
    ]
    left = decontaminate.without_contaminated(docs_of(texts), bench)
    assert sorted(r.doc_id for r in left.collect()) == [1, 2]


def test_the_same_without_broadcasts(spark, docs_of, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    docs, texts, bench, items = tables(spark, docs_of, 2)
    found = decontaminate.contaminated_pairs(docs, bench).collect()
    assert sorted((r.id, r.item, r.n_item, r.n_shared) for r in found) == sorted(contained(texts, items))


def test_no_items_or_documents(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated_pairs(docs_of(["a b c"]), none).count() == 0
    assert decontaminate.contaminated_pairs(docs_of([]), some).count() == 0
    assert decontaminate.without_contaminated(docs_of(["a", None]), none).count() == 2


def test_plans_stay_on_the_jvm(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    for df in (decontaminate.contaminated_pairs(docs, bench), fingerprint.fingerprints(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


# --- fingerprints -----------------------------------------------------------------


def likeness(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_likeness_of_edited_and_next_texts(spark, docs_of):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(300))) for _ in range(120)]
    texts += ["", None, "one", "One", "é ü", "a b c d e", texts[0], texts[1] + " end"]
    ids = list(range(50, 50 + len(texts)))
    rng.shuffle(ids)
    found = {r.id: r for r in fingerprint.edited_likeness(docs_of(texts, ids)).collect()}
    rows = sorted(zip(ids, texts, strict=True), reverse=True)
    errors = []
    for n, (i, text) in enumerate(rows):
        text, after = text or "", rows[(n + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own = found[i]
        assert (own.n_chars, own.edited) == (len(text), edited)
        errors.append(abs(own.near_edited - likeness(shingles(text), shingles(edited))))
        errors.append(abs(own.near_next - likeness(shingles(text), shingles(after))))
    assert max(errors) < 0.25 and np.mean(errors) < 0.03


def test_many_buckets_null_and_repeated_ids(spark, docs_of, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 3)
    texts = [f"text {n} with some more words in it" for n in range(40)]
    ids = [None, None, *[9] * 5, *range(100, 133)]
    found = fingerprint.edited_likeness(docs_of(texts, ids)).collect()
    rows = sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    wanted = []
    for n, (i, text) in enumerate(rows):
        half = len(text) // 2
        wanted.append((i or 0, text[: len(text) - half] + rows[(n + 1) % len(rows)][1][:half]))
    assert sorted((r.id or 0, r.edited) for r in found) == sorted(wanted)


def test_equal_texts_and_texts_without_words(docs_of):
    found = [r.fingerprint for r in fingerprint.fingerprints(docs_of(["a b", "a  b", "A b", "", None, " "])).collect()]
    assert found[0] == found[1] == found[2] and len(found[0]) == fingerprint.BINS * fingerprint.BITS // 4
    assert found[3] == found[4] == found[5] == ""
    assert fingerprint.fingerprints(docs_of([])).count() == 0
    assert fingerprint.edited_likeness(docs_of([])).count() == 0
    alone = fingerprint.edited_likeness(docs_of(["one text alone"])).first()
    assert alone.near_next == 1.0 and alone.edited == "one texone tex"


def test_probes_of_a_bin_reach_all_bins(spark):
    attempts = spark.range(fingerprint.BINS).select(F.col("id").cast("int").alias("n"))
    for empty in (0, 1, 100, 255):
        reached = attempts.select(fingerprint.probe(F.lit(empty), F.col("n")).alias("p"))
        assert reached.distinct().count() == fingerprint.BINS


def test_query_on_the_given_table(spark, tables):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    found = {r.doc_id: r for r in QUERIES["op3_fingerprints"](spark, tables).collect()}
    order = sorted(rows, reverse=True)
    errors = []
    for n, i in enumerate(order):
        text, after = rows[i], rows[order[(n + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors.append(abs(found[i].near_edited - likeness(shingles(text), shingles(edited))))
    assert np.mean(errors) < 0.04
