import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tallygrid.llm import decontaminate, jaccard, pii, toxicity
from tallygrid.session import written


def test_stages_follow_each_other(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    bench = spark.read.parquet(f"{tables}/benchmark.parquet")
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "pii", "bpe"]
    kept = {}
    before = docs
    for name, stage in pipeline.STAGES:
        after = written(stage(spark, before, tables), "stage")
        if name != "bpe":
            assert after.columns == columns
        kept[name] = (before, after)
        before = after

    scores = {r.id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(kept["toxicity"][1]) == sorted(i for i, s in scores.items() if s < 0.5)
    first, left = kept["ngram_jaccard"]
    assert ids(left) == sorted({r.component_id for r in jaccard.near_classes(first).collect()})
    first, left = kept["decontamination"]
    bad = {r.id for r in decontaminate.contaminated_pairs(first, bench).collect()}
    assert ids(left) == [i for i in ids(first) if i not in bad]
    first, left = kept["pii"]
    assert ids(first) == ids(left)
    for row in left.collect():
        assert not pii.base_spans(row.text) and row.n_chars == len(row.text)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    texts = {r.doc_id: r.text for r in left.collect()}
    for row in before.collect():
        assert row.ids == library.encode(texts[row.doc_id], add_special_tokens=False).ids
    assert sorted(r.doc_id for r in pipeline.run(spark, tables).collect()) == ids(before)


def test_odd_rows(spark, tables, docs_of):
    texts = [None, "", "plain words", "mail a.b@c.de", "mail a.b@c.de", "é" * 5000]
    docs = docs_of(texts, [1, 2, 3, 4, 4, None])
    for _, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, tables), "stage")
    assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 1, 2, 3, 4]
    empty = docs_of([])
    for _, stage in pipeline.STAGES:
        empty = written(stage(spark, empty, tables), "stage")
    assert empty.count() == 0


def test_a_task_gives_its_memory_back_when_it_ends(monkeypatch):
    """Idle Python workers would keep it from the stages that follow."""
    import pyarrow as pa
    from tallygrid.llm import text

    seen = []
    monkeypatch.setattr(text, "release_memory", lambda: seen.append("released"))

    def run(batches):
        yield from batches
        seen.append("done")

    batch = pa.RecordBatch.from_pydict({"id": [1]})
    assert [b.num_rows for b in text.released(run)(iter([batch]))] == [1]
    assert seen == ["done", "released"]

    def broken(batches):
        raise ValueError

    try:
        list(text.released(broken)(iter([batch])))
    except ValueError:
        seen.append("raised")
    assert seen[2:] == ["released", "raised"]


def test_released_memory_leaves_what_is_in_use():
    from tallygrid.llm.text import release_memory

    held = [str(n) for n in range(1000)]
    release_memory()
    assert held[-1] == "999"
