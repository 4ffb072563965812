import hashlib
import string

import pytest
import regex
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallygrid.llm import middle
from tallygrid.llm.queries import QUERIES

LETTERS = set(string.ascii_letters)


def units(text):
    """Runs of letters and single others, letter by letter."""
    out = []
    for c in text:
        if c in LETTERS and out and out[-1][-1] in LETTERS:
            out[-1] += c
        else:
            out.append(c)
    return out


def brute(id_, text):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if id_ is None else id_}".encode()).hexdigest()
    h = [int(d[n : n + 8], 16) for n in range(0, 32, 8)]
    u = units(text)
    n = len(u)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(docs):
    rows = middle.round_trip(docs).collect()
    got = sorted((str(r.id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in rows)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted((str(i), *(x if n not in (2, 3) else str(x) for n, x in enumerate(brute(i, t)))) for i, t in texts)
    assert got == want
    assert sorted((str(r.id), r.restored) for r in rows) == sorted((str(i), t or "") for i, t in texts)
    return rows


ODD = ["", None, "a", "word word", "\n\n\t", "é☃😀 Straße", "x<P>y", "a<S", "<M>", "<P", "S>a", "<" * 50, ">M<", "aZ9[z`{@A"]


def test_odd_texts(docs_of):
    check(docs_of(ODD * 40, [None, *range(len(ODD) * 40 - 1)]))


def test_every_form_occurs(docs_of):
    rows = check(docs_of([f"some words, number {n}." for n in range(300)]))
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_repeated_rows_and_ids(docs_of):
    rows = check(docs_of(["one text", "one text", "another", "third"], [5, 5, 5, None]))
    assert len(rows) == 4


def test_an_empty_table_has_no_rows(docs_of):
    assert middle.round_trip(docs_of([])).collect() == []


def test_a_very_long_text(docs_of):
    check(docs_of(["ab, " * 300_000, "x" * 1_000_000, "é" * 500_000]))


def test_restore_reads_the_output_alone(spark, docs_of):
    docs = docs_of([f"a<b S>c{n} M>" for n in range(60)])
    back = middle.restore(middle.transform(docs)).withColumnRenamed("id", "doc_id")
    assert sorted(back.collect()) == sorted(docs.select("doc_id", "text").collect())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB<>PSM \n☃", max_size=40), st.integers(0, 10**6))
def test_any_text_is_restored(text, id_):
    first, second, third, fourth = middle.hash_values(id_)
    n, begin, end = middle.cut(regex.compile(middle.UNITS), text, first, second)
    form = middle.form_of(text, third, fourth)
    output = middle.arranged(form, text, begin, end)
    assert (n, form, output) == tuple(brute(id_, text)[i] for i in (0, 1, 4))
    assert middle.restored(form, output) == text


@pytest.mark.parametrize("text", ["", "a", "ab cd", "a1b2"])
def test_cuts_stay_inside(text):
    pattern = regex.compile(middle.UNITS)
    n = len(units(text))
    assert middle.cut(pattern, text, 0, 0) == (n, 0, 0)
    assert middle.cut(pattern, text, n, 0) == (n, 0, len(text))


def test_the_query_restores_every_text(spark, tables):
    rows = QUERIES["op12_middle"](spark, tables)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    own = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("own"))
    assert rows.join(own, "doc_id").where("restored_sha256 <> own").count() == 0
    assert rows.count() == docs.count()
