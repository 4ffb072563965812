import random
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import pytest

from tallygrid.llm import audit

SPECIALS = set("#$%&*|")


def words(text):
    return [w.decode() for w in text.encode().split()]


def fails(rows):
    """The letters of the filters that each row fails, one row after another."""
    out = []
    for id_, text, _ in rows:
        text = text or ""
        w = words(text)
        letters = "A" if len(w) < 200 else ""
        letters += "B" if 100 * len(set(w)) < 50 * len(w) else ""
        letters += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text) else ""
        letters += "D" if SPECIALS & set(text) else ""
        smaller = any(o is not None and id_ is not None and o < id_ and (t or "") == text for o, t, _ in rows)
        out.append(letters + ("E" if smaller else ""))
    return out


def brute(rows, labels):
    """The report by applying the filters to every document in every order."""
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, bad in labels if bad == 1 and i is not None}
    own = fails(rows)
    report, shares = {}, Counter()
    for part in {p or "" for _, _, p in rows}:
        docs = [(i, f) for (i, _, p), f in zip(rows, own, strict=True) if (p or "") == part]
        for order in permutations("ABCDE"):
            left = docs
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                failing = sum(letter in f for _, f in docs)
                shares[part, letter] += len(gone)
                report[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    failing - len(gone),
                    sum(f == letter for _, f in docs),
                    sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone),
                ]
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in report.items()}


@pytest.fixture
def corpus(spark):
    def make(rows, labels):
        # further columns that clash with names inside
        docs = spark.createDataFrame(
            [(*r, None, "x", 9) for r in rows],
            "doc_id long, text string, source string, id long, part string, n int",
        )
        marked = spark.createDataFrame(
            [(*r, 5) for r in labels], "doc_id long, quality int, toxic int, good int"
        )
        return docs, marked

    return make


def check(corpus, rows, labels):
    found = audit.interactions(*corpus(rows, labels)).collect()
    got = {
        (r.part, r.filter_order, r.step): (
            r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley
        )
        for r in found
    }
    assert len(got) == len(found)
    assert got == brute(rows, labels)


def made_up(seed, n):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        size = rng.choice([3, 150, 199, 200, 201, 260])
        pool = rng.choice([20, size // 2 or 1, 5000])
        text = " ".join(f"w{rng.randrange(pool)}" for _ in range(size))
        text += rng.choice(["", "", "#", " A" * 20, "|", "É" * 40])
        texts.append(text)
    texts += rng.choices(texts, k=n // 2)
    rng.shuffle(texts)
    rows = [(i, t, rng.choice(["hot", "hot", "b", "", None])) for i, t in enumerate(texts)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 0, 1, None])) for i in rng.sample(range(len(rows)), len(rows) // 2)]
    return rows, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_report_equals_applying_the_filters(corpus, seed):
    check(corpus, *made_up(seed, 60))


def test_limits_are_exact(corpus):
    distinct = [f"v{n}" for n in range(100)]
    rows = [
        (1, " ".join(distinct * 2), "a"),  # 100 of 200 distinct: passes A and B
        (2, " ".join(distinct[:99] + distinct[:1] + distinct), "a"),
        (3, "B" + "x" * 49, "a"),  # two in a hundred: passes C
        (4, "BB" + "x" * 97, "a"),
        (5, "É" * 99 + "B", "a"),
        (6, "a b c d\x1ce", "a"),  # only ASCII white space ends a word
    ]
    check(corpus, rows, [])


def test_odd_rows(corpus):
    rows = [
        (7, "same text", "a"), (3, "same text", "b"), (3, "same text", "b"), (3, "same text", "a"), (None, "same text", "a"),
        (8, None, None), (9, "", ""), (None, None, "a"), (None, "|", "a"), (10, "y " * 100_000, "long"),
    ]
    labels = [(3, 1, 0), (3, 0, 1), (7, None, 1), (None, 1, 1), (99, 1, 1), (8, 1, None)]
    check(corpus, rows, labels)


def test_no_labels_and_no_documents(corpus):
    check(corpus, [(1, "a", "s"), (2, "a", "s")], [])
    assert audit.interactions(*corpus([], [(1, 1, 1)])).collect() == []


def test_a_third_of_all_rows_are_copies(corpus):
    rows = [(i, "copy", "hot") for i in range(400)] + [(400 + i, f"#{i}", f"p{i % 5}") for i in range(60)]
    check(corpus, rows, [(i, 1, 0) for i in range(0, 460, 3)])


def test_shapley_of_any_game():
    """Against the average over all orders, for games that are not unions."""
    rng = random.Random(3)
    for players in (2, 3, 4, 5):
        value = [0] + [rng.randrange(-50, 50) for _ in range((1 << players) - 1)]
        shares = defaultdict(Fraction)
        orders = list(permutations(range(players)))
        for order in orders:
            before = 0
            for p in order:
                shares[p] += Fraction(value[before | 1 << p] - value[before], len(orders))
                before |= 1 << p
        assert audit.shapley(value) == [shares[p] for p in range(players)]
