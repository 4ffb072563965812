import hashlib
import random
import re

import pytest

from tallygrid.llm import pii, secrets, spans
from tallygrid.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def checksum(digits):
    total = 0
    for n, d in enumerate(reversed(digits)):
        d = int(d) * (1 + n % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [
        ("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))
    ]
    out += [
        ("card", *m.span())
        for m in CARD.finditer(text)
        if 16 <= len(digits(m)) <= 19 and checksum(digits(m))
    ]
    return out + [
        ("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15
    ]


def plain_secrets(text):
    assign = re.compile(
        r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"
        r"[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    )
    out = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[1]) >= 8]
    out += [
        (m.start(), 1, m.end(), "access")
        for m in re.finditer("AKIA[A-Z0-9]+", text)
        if len(m[0]) >= 16
    ]
    out += [
        (m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32
    ]
    return [(s, e, kind) for s, _, e, kind in sorted(out)]


def test_pii_base_spans_on_random_texts():
    pick = random.Random(5)
    for letters in ("ab19..@@-+ ( )05", "0123456789 .-", "x@y.z@-_%+."):
        for _ in range(4000):
            text = "".join(pick.choice(letters) for _ in range(pick.randrange(50)))
            assert pii.base_spans(text) == plain_pii(text), text


def test_secret_base_spans_on_random_texts():
    pick = random.Random(6)
    parts = ["token", "API_KEY", "apikey", "Secret", "paſſwd", "AKIA", "ABCD1234EFGH5678", "=", ":", '"',
             " ", "'", "deadbeef" * 4, "abc", "Zz9/+", "_", "é"]
    for _ in range(4000):
        text = "".join(pick.choice(parts) for _ in range(pick.randrange(14)))
        assert secrets.base_spans(text) == plain_secrets(text), text


@pytest.mark.parametrize("name", ["op5_pii", "op10_secrets"])
def test_whole_table(spark, tables, name):
    found = {r.doc_id: r for r in QUERIES[name](spark, tables).collect()}
    rows = spark.read.parquet(f"{tables}/documents.parquet").collect()
    assert len(found) == len(rows)
    for row in rows:
        text, own = row.text or "", found[row.doc_id]
        if name == "op5_pii":
            base = [f"{k}:{s}:{e}" for k, s, e in plain_pii(text)]
            counts = [own.n_email, own.n_ip, own.n_card, own.n_phone]
        else:
            base = [f"{k}:{s}:{e}" for s, e, k in plain_secrets(text)]
            counts = [own.n_assign, own.n_access, own.n_hex]
        assert sum(counts) == len(base)
        assert own.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(own.spans.split(","))


def test_looser_personal_data_is_found_and_masked(docs_of):
    sure = [f"mail me: a{n}.b@c{n}.com or call +1 (212) 555-01{n:02d} now" for n in range(40)]
    loose = "please call 212-555-0188 or write jane.doe [at] mail [dot] com today"
    docs = docs_of([*sure, loose, None, ""])
    model = pii.fit(docs)
    found = {r.id: [(s.kind, s.base) for s in r.spans] for r in pii.find(docs, model).collect()}
    assert ("email", True) in found[0] and ("phone", True) in found[0]
    assert {k for k, base in found[40] if not base} == {"email", "phone"}
    assert found[41] == found[42] == []
    masked = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    assert masked[0] == "mail me: [EMAIL] or call [PHONE] now"
    assert masked[41] is None and masked[42] == ""
    assert pii.redact(docs, model).columns == docs.columns


def test_reliabilities_and_classes(docs_of):
    # cards that pass the checksum stand behind fitting words, others behind order numbers
    good = [n for n in range(3000) if checksum(f"4{n:04d}11111111111")][:100]
    bad = [n for n in range(3000) if not checksum(f"4{n:04d}11111111111")][:100]
    texts = [f"my card 4{n:04d}11111111111 now" for n in good]
    texts += [f"order 4{n:04d}11111111111x" for n in bad]
    model = pii.fit(docs_of(texts))
    assert all(0 < v < 1 for kind in model.reliability.values() for v in kind.values())
    assert model.reliability["card"]["validity"] > 0.9
    assert model.reliability["card"]["context"] > 0.9
    assert pii.spans_of(texts[0], model)[0]["score"] > 0.9
    assert pii.spans_of(texts[-1], model) == []


def test_labelers_never_count_as_worse_than_chance():
    import numpy as np

    opinions = np.array([[1, 1, 1, 1, 1, 1], [0, -1, 1, 1, 1, 1]])
    post, says = pii.expectation_maximisation(opinions, np.array([20.0, 180.0]))
    assert (says[2, 1] >= says[2, 0]).all() and (says[0, 1] <= says[0, 0]).all()
    assert post[0] >= post[1] - 1e-3


def test_nothing_to_learn_from(docs_of):
    model = pii.fit(docs_of([]))
    assert model.weights == {}
    assert pii.find(docs_of([]), model).count() == 0
    assert [s["kind"] for s in pii.spans_of("a@b.co 212-555-0188", model)] == ["email"]


def test_long_texts_take_linear_time():
    text = "a" * 300_000 + "1" * 300_000 + "." * 1000 + "+" * 1000
    assert pii.base_spans(text) == []
    assert secrets.base_spans("token" * 50_000) == []


def test_novel_tokens_near_sensitive_words(docs_of):
    key = "q7Zp1VxK93mTb8LdRw2Yc6HsNf40JgUe"
    texts = [
        f"authorization bearer {key} end",
        f"nothing sensitive {key} end",
        "the client secret_configuration_configuration_value_name end",
        None,
    ]
    docs = docs_of(texts)
    found = {r.id: r.spans for r in secrets.scan(docs, secrets.identifier_dictionary(docs)).collect()}
    assert [(s.kind, texts[0][s.start : s.end]) for s in found[0]] == [("novel", key)]
    assert found[1] == [] and found[2] == [] and found[3] == []


@pytest.mark.parametrize("gap", [1, 32, 33, 40, 48])
def test_tokens_are_seen_as_far_as_the_reach(gap):
    key = "q7Zp1VxK93mTb8LdRw2Yc6Hs"
    text = "password" + " " * gap + key + " end"
    assert secrets.candidates(text) == [(8 + gap, 8 + gap + len(key))]
    assert secrets.candidates("password" + " " * 49 + key) == []


def test_candidates_against_a_search_from_every_word():
    rng = random.Random(5)
    parts = ["password", "token", "api_key", "Secret", " ", "  ", " : ", "x" * 9, "K7" * 8, "a-b_c/d=e.f~" * 2, "é"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        wanted = {}
        for word in secrets.SENSITIVE.finditer(text):
            for token in secrets.TOKEN.finditer(text, word.end()):
                if token.start() > word.end() + secrets.REACH:
                    break
                wanted[token.start()] = token.end()
        assert secrets.candidates(text) == sorted(wanted.items()), text


def test_a_novel_token_at_a_gap_of_40(docs_of):
    key = "q7Zp1VxK93mTb8LdRw2Yc6HsNf40JgUe"
    docs = docs_of([f"the password of the machine in room number seven is {key} end"])
    assert docs.first().text.index(key) - len("the password") == 40
    spans_found = secrets.scan(docs, secrets.identifier_dictionary(docs)).first().spans
    assert [(s.kind, s.end - s.start) for s in spans_found] == [("novel", len(key))]


def test_identifiers_are_counted_over_all_rows(docs_of, monkeypatch):
    monkeypatch.setattr(secrets, "HELD", 3)
    docs = docs_of(["alpha beta alpha", "beta x1 gamma_q", None] * 20)
    counts = {r.word: r.n for r in secrets.identifier_counts(docs).collect()}
    assert counts == {"alpha": 40, "beta": 40, "gamma_q": 20}


def test_secrets_of_odd_tables(docs_of):
    key = "q8Zr2LxV0bTn5YwKc7MdHs3J"
    texts = [f"api token {key} end", f"api token {key} end", None, "", "word " * 100_000 + f"secret is {key}"]
    docs = docs_of(texts, [1, 1, None, None, 5])
    found = secrets.scan(docs, secrets.identifier_dictionary(docs)).collect()
    assert len(found) == 5
    by_id = {}
    for r in found:
        by_id.setdefault(r.id, []).append([(s.kind, s.start, s.end) for s in r.spans])
    assert by_id[1][0] == by_id[1][1] and by_id[None] == [[], []]
    assert any(start == 500_010 for _, start, _ in by_id[5][0])
    none = docs_of([])
    assert secrets.scan(none, secrets.identifier_dictionary(none)).count() == 0


def test_outside():
    assert spans.outside([(0, 2), (2, 4), (5, 9)], [(3, 6), (4, 5)]) == [(0, 2)]
    assert spans.outside([(1, 2)], []) == [(1, 2)]


@pytest.mark.parametrize(
    "address", ["2001:db8::1", "fe80::1", "::1", "2001:db8::", "1:2:3:4:5:6:7::", "2001:db8:0:0:1:0:0:1"]
)
def test_written_out_and_compressed_addresses_are_candidates(address):
    text = f"the server at {address}, port 80"
    assert ("ip", 14, 14 + len(address), False) in pii.all_candidates(text)
    assert pii.is_ipv6(address)
    assert not pii.base_spans(text)


def test_what_is_no_compressed_address():
    assert pii.loose_spans("std::vector or a :: b and 12:30:45 end::") == []
    assert not pii.is_ipv6("1:2:3:4:5:6:7::8:9")
