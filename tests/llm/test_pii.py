"""Personal data: base patterns against re, positions, the contexts' rounds, and what they find."""

import hashlib
import random
import re
from collections import defaultdict

import parity
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import pii
from scriptorium.llm import queries as llm

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, x in enumerate(map(int, reversed(digits))):
        x *= 1 + i % 2
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def good(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 if kind == "phone" else True


def base(text):
    found = [(m.start(), k, name, m.end(), m.group()) for k, (name, p) in enumerate(BASE.items()) for m in p.finditer(text or "") if good(name, m.group())]
    return sorted(found)


def contexts_of(text, start, end, left_at, right_to):
    """The contexts of a span; the text before counts from left_at, that after up to right_to."""
    words = lambda t: re.findall(r"[^\W_]+|_|[^\w\x20\x09-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), t))
    before, after = words(text[max(left_at, start - pii.BEFORE) : start]), words(text[end : min(right_to, end + pii.AFTER)])
    has = lambda t: any(c.isalpha() for c in t)
    out = [" ".join(before[-k:]) + " _" for k in (2, 3) if len(before) >= k and has(" ".join(before[-k:]))]
    return out + ([f"{before[-1]} _ {after[0]}"] if before and after and has(before[-1]) else [])


def brute(texts):
    """The spans of each text, by re and dictionaries."""
    seeds, tokens = [], []
    for d, text in enumerate(texts):
        text = text or ""
        known = base(text)
        for k, (name, p) in enumerate(BASE.items()):
            hits = list(p.finditer(text)) if name != "card" else [m for m in p.finditer(text) if 14 <= len(re.sub("[^0-9]", "", m.group())) <= 19]
            for i, m in enumerate(hits):
                if good(name, m.group()):
                    left, right = hits[i - 1].end() if i else 0, hits[i + 1].start() if i + 1 < len(hits) else len(text)
                    seeds.append((d, m.group().lower(), contexts_of(text, m.start(), m.end(), left, right)))
        joined = re.sub("(?<=[0-9])[ -](?=[0-9])", "\ue000", text.replace("\ue000", "\ue001"))
        runs = [m for m in re.finditer(f"[{pii.TOKENS}]+", joined) if len(m.group()) >= 5 and ("@" in m.group() or sum(c in "0123456789" for c in m.group()) >= 2)]
        for i, m in enumerate(runs):
            plain = m.group().replace("\ue000", " ")
            bare = plain.lstrip(pii.MARKS)
            inner = bare.rstrip(pii.MARKS)
            start = m.end() - len(bare)
            end = start + len(inner)
            if len(inner) < 4 or any(a < end and start < b for a, _, _, b, _ in known):
                continue
            left, right = runs[i - 1].end() if i else 0, runs[i + 1].start() if i + 1 < len(runs) else len(text)
            text_left = text[max(left, m.start() - pii.BEFORE) : m.start()] + plain[: len(plain) - len(bare)]
            text_right = plain[len(plain) - (len(bare) - len(inner)) :] * (len(bare) > len(inner)) + text[m.end() : min(right, m.end() + pii.AFTER)]
            made = text_left + "\0" + text_right
            tokens.append((d, start, end, inner.lower(), contexts_of(made, len(text_left), len(text_left) + 1, 0, len(made))))
    held, is_seed = defaultdict(set), {}
    for _, value, found in seeds:
        for c in found:
            held[c].add(value)
            is_seed[c, value] = True
    for _, _, _, value, found in tokens:
        for c in found:
            held[c].add(value)
            is_seed.setdefault((c, value), False)
    held = {c: v for c, v in held.items() if len(v) >= pii.SUPPORT}
    worth = {}
    for number in range(pii.ROUNDS):
        own = defaultdict(list)
        for c, values in held.items():
            for v in values:
                if not is_seed[c, v]:
                    own[v].append(worth.get(c, 0))
        own = {v: sum(x) // (2 * len(x)) for v, x in own.items()} if number else {}
        totals = {c: sum(pii.ONE if is_seed[c, v] else own.get(v, 0) for v in values) for c, values in held.items()}
        worth = {c: t // (len(held[c]) + 1) for c, t in totals.items() if t >= pii.SUPPORT * pii.ONE}
    out = [[(s, k, e) for s, k, _, e, _ in base(text)] for text in texts]
    for d, start, end, _, found in tokens:
        if any(worth.get(c, 0) >= pii.ENOUGH for c in found):
            out[d].append((start, pii.TOKEN, end))
    return [sorted(x) for x in out]


CASES = [
    "a@b.c_d@e.f x@y z@w.q.", "a@b@c.d a@b..c", "1.2.3.4.5.6.7.8 1.2.3.256 0001.002.3.0255 9.9.9", "4111 1111 1111 1111 and 4111-1111-1111-1111, 4111  1111 1111 1111", "41111111111111111111111 4111111111111112",
    "call +1 (017) 555-7713%%% or +49 30 1234567 890, +12 3", "é\U0001f600 x.y@z.de \U0001f600 1.1.1.1\ue0004111111111111111", "", None, "   ", "+1 555 010 9999+1 555 010 9999", "1-2-3 4-5 6", "a.b@c.d.e-f.g@h.i",
]


def test_base_patterns(spark):
    rng = random.Random(6)
    texts = CASES + ["".join(rng.choices(["a", "@", ".", "b-c", "1", "25", "4111", " ", "-", "+", "(", ")", "_", "\n", "é", "300", "0"], k=rng.randrange(1, 40))) for _ in range(3000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans if s.kind < pii.TOKEN] for r in pii.find_personal_data(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [(s, k, e) for s, k, _, e, _ in base(t)], t


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "stone", "river", "and", "walked", "over", "blue", "hill", "to"]) for _ in range(n))


def planted(rng):
    """Texts with seeds and unseen identifiers after "reachable under", and numbers elsewhere."""
    texts = []
    for i in range(30):
        texts.append(f"{prose(rng, 20)} reachable under user.{i}@mail.example.com today {prose(rng, 9)}")
    for i in range(12):
        texts.append(f"{prose(rng, 15)} reachable under ZX-{rng.randrange(10**6, 10**7)} today {prose(rng, 9)}. In room {100 + i}-{i}{i} {prose(rng, 5)}")
    for i in range(60):
        texts.append(f"{prose(rng, 15)} invoice number {rng.randrange(10**6, 10**7)} was {prose(rng, 9)}")
    return texts


def test_unseen_identifiers_of_known_contexts(spark):
    texts = planted(random.Random(12)) + CASES
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[31], None, None, None), (2**60 + 1, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for c in ("row", "of", "kind", "hit", "value", "context", "contexts", "spans", "start", "end"):
        docs = docs.withColumn(c, F.lit("x"))
    got = sorted(((r.doc_id, [(s.start, s.kind, s.end) for s in r.spans]) for r in pii.find_personal_data(docs).collect()), key=repr)
    expected = brute([r[1] for r in rows])
    assert got == sorted(((r[0], e) for r, e in zip(rows, expected)), key=repr)
    by = dict(zip(range(len(texts)), expected))
    for i in range(30, 42):
        assert [texts[i][s:e] for s, k, e in by[i] if k == pii.TOKEN] == [re.search(r"ZX-\d+", texts[i]).group()]
    assert not any(k == pii.TOKEN for i in range(42, 102) for _, k, _ in by[i])


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "a@" + "b." * 100_000 + "c", "1 " * 150_000, "+1" * 100_000, "1." * 100_000, "x@" * 100_000, "é1" * 100_000, "-1" * 100_000])
def test_very_long_texts(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (r,) = pii.find_personal_data(docs).collect()
    if not text.startswith(("+1", "1.", "x@")):  # those have matches for re to be slow on
        assert [(s.start, s.kind, s.end) for s in r.spans if s.kind < pii.TOKEN] == [(s, k, e) for s, k, _, e, _ in (base(text) if text[1] == "@" else [])]


def test_nothing(spark):
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sql_means_the_same(spark):
    assert parity.same(spark, llm.queries()["op12_contextual_pii"], llm.oracle_sql()["op12_contextual_pii"]) > 0


def test_digest_of_no_span(spark, tmp_path):
    spark.createDataFrame([(1, None, None, None, None)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    (r,) = llm.queries()["op12_contextual_pii"](spark, str(tmp_path)).collect()
    assert tuple(r) == (1, 0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")
