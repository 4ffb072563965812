"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Candidates are the matches of four fixed patterns (base spans, always kept) and
of looser ones: obfuscated e-mail addresses, national phone numbers, IPv6
addresses, card-like digits that miss the length or checksum. Six labelers
vote yes, no or abstain on each: pattern strength, validity (checksums, octets),
gazetteers (domain endings, issuer digits, calling codes), context words before
it, its borders, its grouping.

``fit`` counts vote patterns over all texts (at most ``3**6`` patterns, four
kinds and eight shapes, so the counts that reach the driver are bounded),
estimates by expectation-maximisation how reliable each labeler is for each
kind, and trains a logistic classifier of spans on the posterior labels.
``find`` applies it: looser candidates stay at a probability of 0.5 or more.
Without any candidate to learn from only base spans are found.

Cases: a null or empty text has no spans; repeated rows and null ids keep their
rows; very long texts are searched whole, in time linear in their length; an
empty table gives an empty result.
"""

from __future__ import annotations

import ipaddress
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship_package
from .spans import ARROW_SPANS, SPANS, outside
from .text import id_and_text, map_batches, released

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "validity", "gazetteer", "context", "border", "grouping")
SHAPES = 8
KEEP = 0.5
# text before a candidate in which context words count
CONTEXT = 40

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
HIDDEN_AT = re.compile(r"\x20?[\[(]\x20?at\x20?[\])]\x20?", re.IGNORECASE)
HIDDEN_DOMAIN = re.compile(
    r"[A-Za-z0-9-]+(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\.)[A-Za-z0-9-]+)+", re.IGNORECASE
)
# a number can only begin where its run of digits begins
IPV4 = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
IPV6 = re.compile(
    r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
    # with a run of zeros left out, and at least one group written
    r"|(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){1,7}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?(?![\w:])"
    r"|(?<![\w:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,6})?::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}(?![\w:])"
)
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NATIONAL = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")

CONTEXT_WORDS = {
    "email": r"e-?mail|mail|contact|write|correo|courriel|reach",
    "ip": r"\bip\b|server|host|addr|login|client|remote",
    "card": r"card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": r"phone|tel\b|tel\.|call|mobile|fax|cell|whatsapp|telefon|ruf",
}
AGAINST = re.compile(r"version|release|isbn|issn|order|invoice|serial|hash|sha|md5|build|doi", re.I)
FOR = {k: re.compile(words, re.I) for k, words in CONTEXT_WORDS.items()}
ENDINGS = frozenset(
    "com org net edu gov mil int info biz io co de fr es it uk us eu ch at nl be pl se no fi dk cz "
    "pt ru cn jp kr in au ca br mx ar me tv dev app ai xyz online".split()
)
CALLING_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 "
    "65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 234 254 351 352 353 358 380 385 420 852 886 "
    "962 965 966 971 972".split()
)


def is_ipv6(own: str) -> bool:
    try:
        ipaddress.IPv6Address(own)
    except ValueError:
        return False
    return True


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def addresses(text: str, sign: re.Pattern, domain: re.Pattern) -> list[tuple[int, int]]:
    """Local part, sign, domain: found from the signs, each letter looked at once.

    The same matches as scanning for ``local + sign + domain`` from the left: a
    local part is the whole run before the sign, up to the previous match.
    """
    found, floor = [], 0
    for at in sign.finditer(text):
        start = at.start()
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < at.start() and at.start() >= floor and (m := domain.match(text, at.end())):
            found.append((start, m.end()))
            floor = m.end()
        elif at.end() > floor:
            # nothing before this sign can belong to a later local part
            floor = at.end()
    return found


AT = re.compile("@")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of the fixed patterns, by kind and start."""
    out = [("email", *s) for s in addresses(text, AT, DOMAIN)]
    out += [
        ("ip", *m.span())
        for m in IPV4.finditer(text)
        if all(len(x := part.lstrip("0")) < 4 and int(x or 0) <= 255 for part in m[0].split("."))
    ]
    out += [
        ("card", *m.span())
        for m in DIGITS.finditer(text)
        if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)
    ]
    out += [
        ("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15
    ]
    return out


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of what only resembles the fixed patterns."""
    out = [("email", *s) for s in addresses(text, HIDDEN_AT, HIDDEN_DOMAIN)]
    out += [("ip", *m.span()) for m in IPV6.finditer(text)]
    out += [
        ("card", *m.span()) for m in DIGITS.finditer(text) if 13 <= len(digits_of(m[0])) <= 19
    ]
    out += [("phone", *m.span()) for m in NATIONAL.finditer(text)]
    return out


def all_candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """Base spans and, where none of them is, the looser ones."""
    base, loose = base_spans(text), loose_spans(text)
    free = set(outside([(s, e) for _, s, e in loose], [(s, e) for _, s, e in base]))
    out = [(k, s, e, True) for k, s, e in base]
    return out + [(k, s, e, False) for k, s, e in loose if (s, e) in free]


def vote(yes: bool, no: bool = False) -> int:
    return 1 if yes else -1 if no else 0


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """The labelers' opinions on one candidate: 1, 0 (abstains) or -1."""
    own, before = text[start:end], text[max(0, start - CONTEXT) : start]
    digits = digits_of(own)
    if kind == "email":
        local, ending = own.partition("@")[0], re.split(r"[.\s\])]+", own)[-1].lower()
        valid, grouped = len(own) <= 254 and ".." not in own, any(c.isalpha() for c in local)
        listed, unlisted = ending in ENDINGS, not 2 <= len(ending) <= 12
    elif kind == "ip":
        parts = own.split(".")
        valid = is_ipv6(own) if ":" in own else not any(len(p) > 1 and p[0] == "0" for p in parts)
        grouped = ":" in own or any(len(p) > 1 for p in parts)
        listed, unlisted = False, own.startswith(("0.", "127.", "255."))
    elif kind == "card":
        groups = [len(g) for g in re.split(r"[ -]", own)]
        valid, grouped = luhn(digits), len(groups) == 1 or max(groups) <= 6 and min(groups) >= 3
        listed, unlisted = digits[0] in "3456", digits[0] in "01789"
    else:
        groups = [len(g) for g in re.split(r"[^0-9]+", own) if g]
        valid, grouped = 8 <= len(digits) <= 15, len(groups) > 1 and max(groups) <= 8
        code = own[0] == "+" and any(digits[:n] in CALLING_CODES for n in (1, 2, 3))
        listed, unlisted = code, own[0] == "+" and not code
    left, right = text[start - 1 : start], text[end : end + 1]
    attached = any(c.isalnum() or c in "_/#" for c in left + right)
    against = bool(AGAINST.search(before))
    return (
        vote(base),
        vote(valid, not valid),
        vote(listed, unlisted),
        vote(bool(FOR[kind].search(before)) and not against, against),
        vote(not attached, attached),
        vote(grouped, not grouped),
    )


def shape(text: str, start: int, end: int) -> int:
    """Three bits the classifier sees besides the votes: length, separators, line start."""
    own = text[start:end]
    return (
        (end - start > 18)
        + 2 * any(c in " -().:" for c in own)
        + 4 * (start == 0 or text[start - 1] == "\n")
    )


def code_of(v: tuple[int, ...]) -> int:
    return sum((x + 1) * 3**n for n, x in enumerate(v))


def votes_of(code: int) -> list[int]:
    return [code // 3**n % 3 - 1 for n in range(len(LABELERS))]


def features(code: int, shape_bits: int) -> np.ndarray:
    v = np.array(votes_of(code))
    bits = np.array([shape_bits >> n & 1 for n in range(3)])
    return np.r_[1.0, v == 1, v == -1, bits].astype(float)


@dataclass
class PiiModel:
    """Weights of the span classifier and the estimated reliabilities, by kind."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    reliability: dict[str, dict[str, float]] = field(default_factory=dict)

    def probability(self, kind: str, code: int, shape_bits: int) -> float:
        if kind not in self.weights:
            return 0.0
        return float(1 / (1 + np.exp(-features(code, shape_bits) @ self.weights[kind])))


def expectation_maximisation(
    opinions: np.ndarray, n: np.ndarray, rounds: int = 50
) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of "personal" by pattern, and each labeler's P(vote | class).

    Starts from the majority of the votes. No labeler counts as worse than
    chance: where a "yes" came out likelier for what is not personal (or a "no"
    for what is), both classes get the pooled probability. So the classes cannot
    change places. Add-one smoothing keeps labelers that always agree from certainty.
    """
    post = np.clip(0.5 + opinions.sum(1) / (2 * opinions.shape[1]), 0.05, 0.95)
    for _ in range(rounds):
        by_class = np.stack([1 - post, post]) * n
        prior = (by_class.sum(1) + 1) / (n.sum() + 2)
        says = np.stack([(by_class @ (opinions == v)) + 1 for v in (-1, 0, 1)])
        pooled = says.sum(1) / says.sum((0, 1))
        says /= says.sum(0)
        for v, wrong in ((2, says[2, 1] < says[2, 0]), (0, says[0, 1] > says[0, 0])):
            says[v][:, wrong] = pooled[v, wrong]
        logs = np.log(prior)[:, None] + sum(
            np.log(says[v + 1]) @ (opinions == v).T for v in (-1, 0, 1)
        )
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post, says


def logistic(x: np.ndarray, target: np.ndarray, n: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights by Newton's method; ``target`` holds soft labels, ``n`` how often they occur."""
    w, n = np.zeros(x.shape[1]), n / n.mean()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - target)) + ridge * w
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def pattern_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``kind, code, shape, n`` over the candidates of all texts."""
    ship_package(docs.sparkSession)

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for kind, s, e, base in all_candidates(text or ""):
                    held[kind, code_of(votes(text, kind, s, e, base)), shape(text, s, e)] += 1
        rows = [(*key, n) for key, n in held.items()]
        columns = zip(*rows, strict=True) if rows else ((), (), (), ())
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["kind", "code", "shape", "n"],
        )

    own = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    return (
        own.mapInArrow(released(count), "kind string, code int, shape int, n long")
        .groupBy("kind", "code", "shape")
        .agg(F.sum("n").alias("n"))
    )


def fit(docs: DataFrame, text_col: str = "text") -> PiiModel:
    """Reliabilities and span classifier from the candidates of all texts."""
    by_kind = defaultdict(list)
    for row in pattern_counts(docs, text_col).collect():  # bounded: kinds x patterns x shapes
        by_kind[row.kind].append((row.code, row.shape, row.n))
    model = PiiModel()
    for kind, rows in by_kind.items():
        rows.sort()
        opinions = np.array([votes_of(code) for code, _, _ in rows])
        n = np.array([n for _, _, n in rows], float)
        post, says = expectation_maximisation(opinions, n)
        model.weights[kind] = logistic(np.stack([features(c, s) for c, s, _ in rows]), post, n)
        model.reliability[kind] = {
            name: float(says[2, 1, i] / (says[2, 1, i] + says[2, 0, i]))
            for i, name in enumerate(LABELERS)
        }
    return model


def spans_of(text: str, model: PiiModel) -> list[dict]:
    out = []
    for kind, s, e, base in all_candidates(text):
        p = model.probability(kind, code_of(votes(text, kind, s, e, base)), shape(text, s, e))
        if base or p >= KEEP:
            out.append({"kind": kind, "start": s, "end": e, "base": base, "score": p})
    return sorted(out, key=lambda s: (KINDS.index(s["kind"]), s["start"]))


def find(docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``spans`` by kind and start; ``score`` is the classifier's probability."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [spans_of(x, model) for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, ARROW_SPANS)], ["id", "spans"]
            )

        return each

    return map_batches(id_and_text(docs, id_col, text_col), make, SPANS)


def redact(docs: DataFrame, model: PiiModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``; every span of the text becomes ``[KIND]``.

    Overlapping spans are replaced together, under the kind of the first.
    A null text stays null.
    """
    ship_package(docs.sparkSession)

    def masked(text: str | None) -> str | None:
        if not text:
            return text
        out, end = [], 0
        for s in sorted(spans_of(text, model), key=lambda s: (s["start"], -s["end"])):
            if s["start"] >= end:
                out += [text[end : s["start"]], f"[{s['kind'].upper()}]"]
            end = max(end, s["end"])
        return "".join(out) + text[end:]

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = pa.array([masked(x) for x in batch.column(at).to_pylist()], pa.string())
            yield batch.set_column(at, batch.schema.field(at).with_type(pa.string()), texts)

    kept = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    return kept.mapInArrow(released(run), kept.schema)
