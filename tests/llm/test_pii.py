import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from graphloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(t):
    only = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(only(m)) <= 19 and luhn(only(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(only(m)) <= 15])


def test_patterns_match_brute_force(spark, make_docs, tables):
    rng = random.Random(1)
    texts = ["".join(rng.choice("a@.1-+ 2(é%9") for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["a@b.c@d.e", "1.2.3.4.5.6.7.8", "4111 1111-1111 1111", "+1 (555) 010-9999", "4" * 5000, None, "", "1.02.003.0004 x@y", "+1+2+3 4567890123"]
    for t in texts:
        assert pii.base_spans(t or "") == brute(t or "")
    got = {r.doc_id: r for r in pii.op7_pii_disclosure(spark, tables(documents=make_docs(texts))).collect()}
    for k, t in enumerate(texts):
        found = brute(t or "")
        names = ",".join(f"{pii.KINDS[i]}:{a}:{b}" for a, i, b in found)
        assert got[k].base_sha256 == hashlib.sha256(names.encode()).hexdigest()
        assert [got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone] == [sum(x[1] == i for x in found) for i in range(4)]


def _corpus():
    rng = random.Random(3)
    common = [f"common{k}" for k in range(40)]
    fill = lambda n: " ".join(rng.choice(common) for _ in range(n))
    told = [f"{fill(12)} Zanzibarov wrote jane@mail.org from code 77123 {fill(12)} zanzibarov {fill(4)}" for _ in range(6)]
    return told + [f"{fill(30)} bob{k}@mail.org {fill(10)}" for k in range(60)] + [fill(40) for _ in range(100)] + [f"{fill(9)} zanzibarova {fill(9)}"]


def test_disclosing_terms(spark, make_docs):
    texts = _corpus()
    docs = make_docs(texts)
    got = {r.doc_id: {texts[r.doc_id][t.start : t.end]: t.disclosure for t in r.terms} for r in pii.find(docs).collect()}
    for k in range(6):
        assert {"Zanzibarov", "zanzibarov", "77123"} <= got[k].keys() and not any(w.startswith("common") for w in got[k])
    assert all(not got[k] for k in range(6, len(texts)))
    # the estimate itself, from documents
    n, n_e = len(texts), 6
    n_t = sum("wrote" in t for t in texts)
    assert math.isclose(got[0]["wrote"], math.log2(n * 6 / (n_t * n_e)) / math.log2(n / n_e))


def test_copies_prove_nothing_and_masking(spark, make_docs):
    copies = make_docs(["Quix met ann@mail.org in Lisbon today"] * 20 + ["plain words"] * 20)
    assert all(not r.terms for r in pii.find(copies).collect())
    out = pii.sanitise(copies)
    assert out.columns == copies.columns
    r = out.filter("doc_id = 0").first()
    assert r.text == "Quix met [EMAIL] in Lisbon today" and r.n_chars == len(r.text) and r.extra == "y"
    texts = _corpus()
    clean = {r.doc_id: r.text for r in pii.sanitise(make_docs(texts)).collect()}
    assert "anzibarov" not in clean[0] and "jane@" not in clean[0] and "77123" not in clean[0]
    assert clean[100] == texts[100] and clean[len(texts) - 1] == texts[-1]
    assert pii.masked("7 x 8", [(0, 1, 0.85), (2, 3, 0.85), (4, 5, 1.0)]) == "[NUMBER] [TERM] "


def plain_contexts(text, spans):
    """(entity, term, context) by comparing every word with every span."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[^ \t-\r]+", text)]
    out = set()
    for s, kind, e in spans:
        first = max(k for k, w in enumerate(words) if w[0] <= s)
        last = min([k for k, w in enumerate(words) if w[0] >= e], default=len(words))
        near = words[max(0, first - pii.REACH) : first] + words[last : last + pii.REACH]
        terms = [t for a, b in near if not any(x < b and a < y for x, _, y in spans) and (t := pii.term_of(text[a:b]))]
        out |= {(pii._entity(text, (s, kind, e)), t, pii._hash(*terms) >> 1) for t in terms}
    return out


def test_contexts_of_many_spans():
    rng = random.Random(5)
    pieces = ["word", "Name,", "a@b.c", "1.2.3.4", "x@y.z,1.2.3.4", "+1 555 010 9999", "4111 1111 1111 1111", "(long)", "é"]
    for _ in range(200):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randint(1, 60)))
        spans = pii.base_spans(text)
        got = list(pii._contexts(text, spans))
        assert len(got) == len(set(got)) and set(got) == plain_contexts(text, spans)


def test_a_long_text_with_many_spans(spark, make_docs):
    text = " ".join(f"user{k}@mail{k % 7}.org wrote name{k % 50}" for k in range(40_000))  # over a million characters
    began = time.perf_counter()
    spans = pii.base_spans(text)
    assert len(spans) == 40_000 and sum(1 for _ in pii._contexts(text, spans)) > 40_000
    assert time.perf_counter() - began < 15
    docs = make_docs([text, "ann@mail.org wrote", text], ids=[1, 2, 1])
    assert sorted((r.doc_id, len(r.spans)) for r in pii.find(docs).collect()) == [(1, 40_000), (1, 40_000), (2, 1)]
    assert all("@" not in r.text for r in pii.sanitise(docs).collect())


def test_clashing_columns_and_bit_tables(spark, make_docs):
    docs = make_docs(["ann@mail.org wrote to Bob"]).withColumns({"spans": F.lit(1), "doc": F.lit(2), "mark": F.lit("m"), "term": F.lit("t"), "_terms": F.lit(0)})
    assert pii.sanitise(docs).columns == docs.columns
    assert pii.sanitise(docs).first()["mark"] == "m" and len(pii.find(docs).first().spans) == 1
    assert [pii._table_bits(n) for n in (0, 1 << 16, 1 << 40)] == [1 << 20, 1 << 21, 1 << 27]


def test_edges(spark, make_docs):
    docs = make_docs([None, "", "a@b.c", "a@b.c"], ids=[1, None, 2, 2])
    assert sorted((r.doc_id or 0, len(r.spans)) for r in pii.find(docs).collect()) == [(0, 0), (1, 0), (2, 1), (2, 1)]
    assert sorted(str(r.text) for r in pii.sanitise(docs).collect()) == ["", "None", "[EMAIL]", "[EMAIL]"]
    assert pii.sanitise(docs.limit(0)).count() == 0 and pii.find(docs.limit(0)).count() == 0
