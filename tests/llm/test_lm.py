import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tallygrid.llm import gru, lm
from tallygrid.llm.queries import QUERIES

SMALL = gru.Shape(classes=3, members=4, state=5)


def network(seed=1):
    rng = np.random.default_rng(seed)
    return gru.Network(SMALL, gru.initial(SMALL, rng.random(SMALL.symbols), seed))


def packed(texts):
    lengths = np.array([len(t) for t in texts])
    return np.concatenate([np.array(t, np.int64) for t in texts]), lm.begins_of(lengths), lengths


def plain_score(net, symbols):
    """Symbol by symbol, with the whole distribution written out."""
    return plain_steps(net, symbols)


def plain_steps(net, symbols):
    shape = net.shape
    w, n = {k: v.astype(np.float64) for k, v in net.w.items()}, shape.state
    h, before, total = np.zeros(n), shape.symbols, 0.0
    for s in symbols:
        x, u = w["inputs"][before], h @ w["recurrent"]
        z, r = (1 / (1 + np.exp(-(x[k] + u[k]))) for k in (slice(0, n), slice(n, 2 * n)))
        c = np.tanh(x[2 * n :] + r * u[2 * n :])
        h = z * h + (1 - z) * c
        outer = h @ w["class_out"] + w["class_bias"]
        outer = np.exp(outer) / np.exp(outer).sum()
        inner = np.exp([h @ w["member_out"][k] + w["member_bias"][k] for k in range(shape.classes)])
        inner /= inner.sum(1, keepdims=True)
        together = outer[:, None] * inner
        assert abs(together.sum() - 1) < 1e-5
        total += np.log(together.reshape(-1)[s])
        before = s
    return total


def test_scores_carry_the_state_through_windows_and_lanes():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, SMALL.symbols, n) for n in (1, 70, 3, 33, 32, 5, 100)]
    net = network()
    found = net.score(*packed(texts), most=3, cells=8)
    assert np.allclose(found, [plain_score(net, t) for t in texts], rtol=1e-4)


def test_gradient_is_the_slope():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, SMALL.symbols, n) for n in (9, 6, 6, 2)]
    flat, begins, lengths = packed(texts)
    net = network()
    symbols, active = gru.grid(flat, begins, lengths, 0, 9)
    state = np.zeros((4, SMALL.state), np.float32)
    before = np.full(4, SMALL.symbols)
    grad, values, *_ = net.gradient(symbols, active, before, state)
    assert abs(values.sum() - sum(plain_score(net, t) for t in texts)) < 1e-3
    for k in rng.choice(SMALL.size, 60, replace=False):
        ends = []
        for step in (1e-2, -1e-2):
            other = net.flat.copy()
            other[k] += step
            ends.append(gru.Network(SMALL, other).score(flat, begins, lengths).sum())
        assert abs((ends[0] - ends[1]) / 2e-2 - grad[k]) < 2e-2 * max(1, abs(grad[k]))


def test_pieces_cover_every_symbol_once():
    begins, lengths, opening = gru.pieces(np.array([0, 5, 20]), np.array([5, 15, 1]), 6)
    covered = sorted(n for b, k in zip(begins, lengths, strict=True) for n in range(b, b + k))
    assert covered == list(range(21))
    assert begins[opening].tolist() == [0, 5, 20]


def test_it_learns_what_follows(spark):
    rng = random.Random(1)
    rows = []
    for n in range(300):
        k = rng.randrange(3)
        rows.append((n, " ".join(f"{'abc'[k]}{rng.randrange(4)}" for _ in range(40))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.fit(docs.where("doc_id < 250"))
    found = [r for r in lm.score(docs, model).collect() if r.id >= 250]
    # three languages of four words: one in four once it is known which
    assert all(r.score > r.base_score for r in found)
    assert np.mean([r.score / r.n_tokens for r in found]) > -0.75
    assert np.mean([r.base_score / r.n_tokens for r in found]) < -0.95


def test_the_network_is_whole_and_grows_with_the_words():
    assert lm.SHAPE.state == gru.Shape().state == 24 and lm.LEAST_UPDATES == 150
    assert [lm.shape_for(n).symbols for n in (0, 1 << 16, 1 << 20, 1 << 24)] == [1024, 1024, 4096, 16384]


def test_symbols_follow_the_shape(docs_of, monkeypatch):
    docs = docs_of([f"one two three w{n} w{n % 7}" for n in range(60)])
    monkeypatch.setattr(lm, "SHAPE", gru.Shape(classes=2, members=2, state=5))
    model = lm.fit(docs)
    assert model.words.shape.classes == model.words.shape.members == 6
    assert len(model.words.head) == 18 and len(model.words.group_total) == 18
    assert all(np.isfinite(r.score) for r in lm.score(docs, model).collect())


def test_training_carries_the_state_through_a_whole_text(monkeypatch):
    net, seen = network(), []
    gradient = net.gradient

    def watched(symbols, active, before, state):
        seen.append((len(state), bool(state.any())))
        return gradient(symbols, active, before, state)

    monkeypatch.setattr(net, "gradient", watched)
    gru.Trainer(net).learn(*packed([np.arange(1300) % SMALL.symbols]))
    assert seen == [(1, n > 0) for n in range(-(-1300 // gru.Trainer.STEPS))]


@pytest.fixture
def small_groups(monkeypatch):
    """Several groups a round, and several batches in each, from few texts."""
    monkeypatch.setattr(lm, "SHAPE", gru.Shape(classes=4, members=4, state=6))
    monkeypatch.setattr(lm, "GROUP_TOKENS", 700)
    monkeypatch.setattr(lm, "LEAST_UPDATES", 12)
    monkeypatch.setattr(lm, "BATCH_BYTES", 1500)


def test_scores_do_not_depend_on_partitions(docs_of, small_groups):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(60))) for _ in range(200)]
    docs = docs_of([*texts, *["one copy of many"] * 60, None, ""], [*range(260), None, None])
    scores = []
    for parts in (1, 4, 7):
        dealt = docs.repartition(parts)
        model = lm.fit(dealt)
        found = lm.score(dealt, model).collect()
        scores.append(sorted((r.id is None, r.id or 0, r.n_tokens, r.score) for r in found))
    assert lm.group_count(model.words.total, lm.ROUNDS) > 2
    for other in scores[1:]:
        assert [x[:3] for x in other] == [x[:3] for x in scores[0]]
        assert np.allclose([x[3] for x in other], [x[3] for x in scores[0]], rtol=1e-6, atol=1e-6)


def test_whole_scores_against_a_plain_step(docs_of, small_groups):
    """Scores of a small table from the trained weights, symbol by symbol in float64."""
    texts = ["a b c d e f", "a a a", "", "z unseen words here", "b a " * 40]
    docs = docs_of(texts)
    model = lm.fit(docs)
    reader, m = lm.Reader(model.words), model.words
    found = {r.id: r.score for r in lm.score(docs, model).collect()}
    for n, text in enumerate(texts):
        rows, _ = reader.read([text])
        logs = plain_steps(gru.Network(m.shape, model.weights), reader.place[rows]) / np.log(10)
        own = np.log10(np.maximum(reader.count[rows], 0) + 0.5)
        inside = np.where(reader.in_head[rows], 0.0, own - m.group_total[reader.group[rows]])
        assert math.isclose(found[n], logs + inside.sum(), rel_tol=1e-5)


def test_groups_follow_the_tokens_and_stay_bounded():
    assert [lm.group_count(n, 3) for n in (0, lm.GROUP_TOKENS * 3, lm.GROUP_TOKENS * 31)] == [1, 1, 10]
    assert lm.group_count(10**15, 3) == lm.MOST_GROUPS


def test_weights_travel_in_blocks_and_weigh_by_symbols(docs_of, small_groups):
    import pyarrow as pa

    rows = pa.table({"block": pa.array([2, 2], pa.int32()), "grp": pa.array([1, 0], pa.int32()), "n": [3.0, 1.0],
                     "v": pa.array([[1.0, 2.0], [5.0, 6.0]], pa.list_(pa.float32()))})
    assert lm.mean_block(rows).to_pylist() == [{"block": 2, "v": [2.0, 3.0]}]


def base_of(rows, learned):
    counts = Counter()
    for i, text in rows:
        if learned(i):
            counts.update([*(text or "").encode().lower().split(), b" "])
    total, kinds = sum(counts.values()), len(counts)
    out = {}
    for i, text in rows:
        w = [*(text or "").encode().lower().split(), b" "]
        logs = [math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w]
        out[i] = (len(w), sum(x in counts for x in w), total, sum(logs))
    return out


@pytest.mark.parametrize("known", [1 << 21, 40])
def test_query_against_plain_counts(spark, tables, monkeypatch, known):
    # with few known words most tokens go through the join
    monkeypatch.setattr(lm, "KNOWN", known)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    wanted = base_of(rows, lambda i: fold(i) != 1)
    found = QUERIES["op2_lm"](spark, tables).collect()
    assert len(found) == len(rows)
    for r in found:
        n_tokens, n_known, total, base = wanted[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id) == 1, n_tokens, n_known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_known_words_do_not_change_a_score(spark, docs_of, monkeypatch):
    docs = docs_of([f"one two three w{n} w{n % 7}" for n in range(60)])
    model = lm.fit(docs)
    first = {r.id: r.score for r in lm.score(docs, model).collect()}
    monkeypatch.setattr(lm, "KNOWN", 5)
    words = lm.word_model(model.counts)
    again = lm.score(docs, lm.LanguageModel(words, model.weights, model.counts)).collect()
    assert all(math.isclose(r.score, first[r.id], rel_tol=1e-6) for r in again)


def test_nulls_empty_and_long_texts_and_nothing_to_learn_from(docs_of):
    docs = docs_of(["", None, "word " * 30_000, "x", "x"], [1, 2, 3, 4, 4])
    nothing = lm.fit(docs.limit(0))
    found = sorted((r.id, r.n_tokens, r.n_known) for r in lm.score(docs, nothing).collect())
    assert found == [(1, 1, 0), (2, 1, 0), (3, 30_001, 0), (4, 2, 0), (4, 2, 0)]
    assert all(np.isfinite(r.score) for r in lm.score(docs, nothing).collect())
    assert lm.score(docs.limit(0), nothing).count() == 0
    trained = lm.fit(docs)
    assert all(np.isfinite(r.score) for r in lm.score(docs, trained).collect())


def test_rows_in_a_core_s_cache_change_nothing(monkeypatch):
    """Output layer and optimizer in small steps give what they give in one."""
    rng = np.random.default_rng(4)
    held = packed([rng.integers(0, SMALL.symbols, n) for n in (40, 7, 1, 23, 15)])
    found = []
    for rows, weights in ((1 << 20, 1 << 20), (4, 16)):
        monkeypatch.setattr(gru, "CACHED_ROWS", rows)
        monkeypatch.setattr(gru, "CACHED_WEIGHTS", weights)
        trainer = gru.Trainer(network())
        for _ in range(3):
            trainer.learn(*held)
        found.append((trainer.network.flat.copy(), trainer.network.score(*held)))
    assert found[0][0] == pytest.approx(found[1][0], abs=1e-5)
    assert found[0][1] == pytest.approx(found[1][1], rel=1e-5)
