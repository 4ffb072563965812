import random
from collections import defaultdict

import pyarrow as pa
import pytest

from tallygrid.llm import components, copies, jaccard, regions, substring, text
from tallygrid.llm.queries import QUERIES


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_classes(rows):
    """Smallest id of every row's class, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    ids = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        ids[root(n)].append(i)
    return [(i, len(sets[n]), min((x for x in ids[root(n)] if x is not None), default=None)) for n, (i, _) in enumerate(rows)]


def edited(rng, base, rate):
    return " ".join(f"n{rng.randrange(10**6)}" if rng.random() < rate else w for w in base.split())


def near_copies(seed, groups, each, size=60, rates=(0.0, 0.01, 0.03, 0.05)):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, size)))
        texts += [edited(rng, base, rng.choice(rates)) for _ in range(rng.randrange(1, each))]
    passage = " ".join(f"p{n}" for n in range(30))
    texts += [f"{passage} " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(30)) for _ in range(40)]
    rng.shuffle(texts)
    return texts


def check(docs, rows):
    found = jaccard.near_classes(docs).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    ours = sorted(((r.id, r.n_shingles, r.component_id) for r in found), key=key)
    assert ours == sorted(brute_classes(rows), key=key)


def test_against_all_pairs(docs_of):
    texts = near_copies(1, 25, 12)
    texts += ["", None, "one", "ONE", "a b c d", "a b c d e", " a  b c\td ", "one two"]
    check(docs_of(texts), list(enumerate(texts)))


@pytest.mark.parametrize(("chain", "block", "direct"), [(1 << 14, 8, 3), (4, 8, 3), (1 << 14, 256, 5)])
def test_small_blocks_regions_and_pivots(docs_of, monkeypatch, chain, block, direct):
    # the bounds come with the job's functions only through the module, so the join is tested below
    monkeypatch.setattr(jaccard, "CHAIN", chain)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = near_copies(2, 3, 30, rates=(0.01, 0.04, 0.06))
    check(docs_of(texts), list(enumerate(texts)))


@pytest.mark.parametrize("seed", range(6))
def test_recursive_regions_find_every_class(monkeypatch, seed):
    import numpy as np

    from tallygrid.llm.text import ShingleSets

    monkeypatch.setattr(jaccard, "DIRECT", 4)
    monkeypatch.setattr(jaccard, "PIVOTS", 2 + seed % 3)
    texts = [t for t in near_copies(seed, 6, 40, rates=(0.0, 0.02, 0.04, 0.08)) if words(t)]
    group = jaccard.MetricJoin(ShingleSets().of(texts))
    group.join(np.arange(len(texts)))
    found = {}
    for n in range(len(texts)):
        found.setdefault(group.root(n), []).append(n)
    ours = sorted((n, min(own)) for own in found.values() for n in own)
    assert ours == sorted((i, c) for i, _, c in brute_classes(list(enumerate(texts))))


def matrix_classes(texts):
    """The least member of every text's class, from the counts of all pairs."""
    import numpy as np

    sets = [shingles(t) for t in texts]
    place = {x: n for n, x in enumerate({x for own in sets for x in own})}
    held = np.zeros((len(sets), len(place)), np.float32)
    for n, own in enumerate(sets):
        held[n, [place[x] for x in own]] = 1
    both, size = held @ held.T, held.sum(1)
    near = 100 * both >= 75 * (size[:, None] + size - both)
    label = np.arange(len(sets))
    while True:
        least = np.array([label[row].min() for row in near])
        if (least == label).all():
            return label.tolist()
        label = least


def families(seed, count, each, common=0, rates=(0.0, 0.01, 0.02, 0.03)):
    """Near copies around some base texts, which share their first words."""
    rng = random.Random(seed)
    first = [f"c{n}" for n in range(common)]
    out = []
    for f in range(count):
        base = " ".join(first + [f"f{f}w{n}" for n in range(60 - common)])
        out += [edited(rng, base, rng.choice(rates)) for _ in range(each)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(
    ("count", "each", "common", "rates"),
    [(20, 150, 0, (0.0, 0.01, 0.02, 0.03)), (12, 250, 20, (0.0, 0.02)), (1, 3000, 0, (0.01, 0.03, 0.06, 0.1))],
)
def test_rounds_over_three_thousand_near_copies(spark, count, each, common, rates):
    """One cell of all documents comes apart in rounds, with few copies and no link lost."""
    texts = families(count, count, each, common, rates)
    table = spark.createDataFrame(list(enumerate(texts)), "h long, text string")
    members = table.selectExpr("7L as cell", "h")
    found, groups, rounds = regions.divide(members, table, 128)
    pairs, copied = found[0], groups[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    for more in groups[1:]:
        copied = copied.unionByName(more)
    largest = copied.groupBy("cell", "a", "b").count().agg({"count": "max"}).first()[0] or 0
    assert largest <= 3 * 128
    if count == 20:
        assert rounds > 1 and copied.count() <= 3 * len(texts)
    links = pairs.unionByName(jaccard.joined_groups(copied, table))
    label = {r.node: r.label for r in components.components(links, "h", "p").collect()}
    assert [label.get(n, n) for n in range(len(texts))] == matrix_classes(texts)


def test_large_cells_on_the_way_through_the_query(docs_of, monkeypatch):
    """The prefix filter leaves cells of many blocks; their rounds lead to the same classes."""
    monkeypatch.setattr(jaccard, "BLOCK", 32)
    seen = []
    own = jaccard.divide
    monkeypatch.setattr(jaccard, "divide", lambda *a: seen.append(own(*a)) or seen[-1])
    texts = families(11, 4, 200)
    found = jaccard.near_classes(docs_of(texts)).collect()
    assert seen[0][2] > 0
    assert [r.component_id for r in sorted(found, key=lambda r: r.id)] == matrix_classes(texts)


def test_classes_of_masks(spark):
    rows = spark.createDataFrame([([1, 3, 4, 0, 24],), ([],), ([0],)], "masks array<int>")
    found = [r.c for r in rows.select(regions.joined_masks(rows["masks"]).alias("c")).collect()]
    assert [sorted(c) for c in found] == [[3, 4, 24], [], []]


def test_repeated_rows_null_ids_and_one_of_each(docs_of):
    base = " ".join(f"w{n}" for n in range(40))
    other = " ".join(f"v{n}" for n in range(40))
    texts = [base, base, base + " tail", other, other, "", "", None, other + " x"]
    ids = [7, 7, 3, None, None, 5, 6, 8, None]
    docs = docs_of(texts, ids)
    found = {(r.id, r.component_id) for r in jaccard.near_classes(docs).collect()}
    assert found == {(7, 3), (3, 3), (None, None), (5, 5), (6, 6), (8, 8)}
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(x for x in left if x[0] is not None) == [(3, base + " tail"), (5, ""), (6, ""), (8, None)]
    assert sum(i is None for i, _ in left) == 1


def test_one_of_each_keeps_repeated_rows_once(docs_of):
    text = " ".join(f"w{n}" for n in range(20))
    docs = docs_of([text, text, "alone here"], [4, 4, 9])
    assert sorted(r.doc_id for r in jaccard.one_of_each(docs).collect()) == [4, 9]


def test_empty_table(docs_of):
    assert jaccard.near_classes(docs_of([])).count() == 0
    assert jaccard.one_of_each(docs_of([])).count() == 0
    assert substring.remove_repeats(docs_of([])).count() == 0


def test_copies_of_several_batches_are_one_text(spark, docs_of):
    docs = docs_of(["same text of six words here"] * 50).repartition(5)
    table = copies.distinct_texts(docs, "doc_id", "text")
    assert table.count() == 50 and table.where("text is not null").count() == 1
    assert {r.component_id for r in jaccard.near_classes(docs).collect()} == {0}


def test_components_of_a_chain_and_a_star(spark):
    chain = [(n, n + 1) for n in range(100, 160)]
    star = [(1, n) for n in range(2, 60)]
    rows = spark.createDataFrame(chain + star + [(5, 5)], "a long, b long")
    found = {r.node: r.label for r in components.components(rows, "a", "b").collect()}
    assert found == {**{n: 100 for n in range(100, 161)}, **{n: 1 for n in range(1, 60)}}
    assert components.components(rows.limit(0), "a", "b").count() == 0


def test_query_on_the_given_table(spark, tables):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    found = QUERIES["op8_jaccard"](spark, tables).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(brute_classes(rows))


# --- repeated substrings ----------------------------------------------------------


def brute_removed(rows, width):
    """Words of each row and those left, windows compared as they stand."""
    seen, out = set(), []
    for i, text in rows:
        w = (text or "").split()
        gone = set()
        for s in range(len(w) - width + 1):
            window = tuple(w[s : s + width])
            if window in seen:
                gone.update(range(s, s + width))
            seen.add(window)
        out.append((i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return out


@pytest.mark.parametrize("width", [4, 8, 20])
def test_removed_words_against_brute_force(docs_of, width):
    rng = random.Random(width)
    passages = [" ".join(f"p{rng.randrange(50)}" for _ in range(rng.randrange(5, 60))) for _ in range(6)]
    texts = ["", None, "a", "x " * 300, "A a " * 40, passages[0]]
    for _ in range(60):
        parts = [rng.choice(passages) for _ in range(rng.randrange(3))]
        parts += [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40)))]
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    texts += texts[10:15]
    docs = docs_of(texts).repartition(3)
    found = substring.remove_repeats(docs, width=width).collect()
    ours = sorted((r.id, r.n_words, r.n_removed, r.kept) for r in found)
    assert ours == sorted(brute_removed(list(enumerate(texts)), width))


def test_rows_of_one_id_and_null_ids(docs_of):
    passage = " ".join(f"p{n}" for n in range(25))
    docs = docs_of([passage, passage, f"{passage} end", passage], [2, 2, None, None])
    found = sorted((r.id or 99, r.n_words, r.n_removed) for r in substring.remove_repeats(docs).collect())
    assert found == [(2, 25, 0), (2, 25, 25), (99, 25, 25), (99, 26, 25)]


def test_a_very_long_text_and_one_word_throughout(docs_of):
    """Every window but the first of a text of one word stands earlier."""
    docs = docs_of(["la " * 30_000, "la " * 25, " ".join(f"w{n}" for n in range(30_000)), "la"])
    found = {r.id: (r.n_words, r.n_removed) for r in substring.remove_repeats(docs).collect()}
    assert found == {0: (30_000, 29_999), 1: (25, 25), 2: (30_000, 0), 3: (1, 0)}


def test_classes_of_a_very_long_text(docs_of):
    long = " ".join(f"w{n}" for n in range(40_000))
    docs = docs_of([long, long + " and a little more", "la " * 40_000, "short"], [7, 3, 5, None])
    found = {r.id: (r.n_shingles, r.component_id) for r in jaccard.near_classes(docs).collect()}
    assert found == {7: (39_996, 3), 3: (40_000, 3), 5: (1, 5), None: (1, None)}


def test_width_must_divide(docs_of):
    with pytest.raises(ValueError, match="four"):
        substring.remove_repeats(docs_of(["a"]), width=6)


def test_chosen_positions_are_a_minimum_of_every_run():
    import numpy as np

    values = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    at = set(substring.chosen(values, 16).tolist())
    for n in range(len(values) - 15):
        run = values[n : n + 16]
        assert any(n + k in at for k in np.flatnonzero(run == run.min()))


def test_shuffled_texts_are_compressed_and_read_again(spark, docs_of):
    texts = ["a b c d e f g", "", "ä " * 4000, "one two", "x" * 3_000_000]
    plain, packed = pa.array(texts), text.packed_texts(texts)
    got, want = (text.ShingleSets().of_column(c) for c in (packed, plain))
    assert [x.tolist() for x in got] == [x.tolist() for x in want] == [x.tolist() for x in text.ShingleSets().of(texts)]
    assert packed[2].as_buffer().size < 200
    rows = copies.distinct_texts(docs_of(texts[:1] * 2), "doc_id", "text")
    assert dict(rows.dtypes)["text"] == "binary" and rows.where("text is not null").count() == 1


def test_shingles_that_share_a_group_lose_no_link(spark, docs_of, monkeypatch):
    """Few bits make most shingles meet; classes stay those of all pairs."""
    rng = random.Random(3)
    texts = families(3, 6, 8, 10, (0.0, 0.02, 0.05)) + [" ".join(rng.choices("abcdefgh", k=40)) for _ in range(20)]
    monkeypatch.setattr(jaccard, "PIVOT_BITS", 3)
    found = {r.id: r.component_id for r in jaccard.near_classes(docs_of(texts)).collect()}
    assert [found[n] for n in range(len(texts))] == matrix_classes(texts)


def test_a_round_of_the_prefix_filter_shuffles_rows_twice(spark):
    """Once by document and once by region: no grouping and no join beside them."""
    rows = spark.createDataFrame([(5, 1, 40), (5, 2, 41), (6, 1, 40)], "region long, h long, mark long")
    plan = jaccard.with_hosts(jaccard.met_enough(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2
    assert jaccard.banded(rows.selectExpr("3L as pivot", "h", "40 as n")).columns == ["region", "h", "mark"]


def test_bands_are_where_the_rows_of_their_shingle_are(spark):
    """The prefix filter's rows are shuffled by shingle once, and not again for its bands."""
    rows = spark.createDataFrame([(3, 1, 40), (3, 2, 40), (3, 3, 400), (4, 1, 40)], "pivot long, h long, n int")
    bands = jaccard.in_bands(jaccard.not_alone(rows, "pivot"))
    found = jaccard.with_hosts(bands, "pivot")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    plain = jaccard.with_hosts(jaccard.banded(jaccard.not_alone(rows, "pivot")))
    assert sorted(found.collect()) == sorted(plain.collect())
    # a guest's region and its own, each with both documents
    assert sorted(r.h for r in found.collect()) == [1, 2] and len({r.rid for r in found.collect()}) == 1
