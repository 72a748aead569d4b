import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import langid


def test_automaton_holds_exactly_the_substrings():
    rng = random.Random(1)
    s = [rng.randrange(3) for _ in range(200)]
    go = langid.suffix_automaton(s, 3)
    subs = {tuple(s[a:b]) for a in range(len(s)) for b in range(a + 1, min(len(s), a + 9) + 1)}
    for _ in range(2000):
        w = tuple(rng.randrange(3) for _ in range(rng.randint(1, 8)))
        state = 0
        for c in w:
            state = go[state, c] if state >= 0 else -1
        assert (state >= 0) == (w in subs)


def plain_parse(text, train):
    """Longest matches, one after the other; a symbol that the training text lacks stands alone."""
    count = at = 0
    while at < len(text):
        step = 1
        while at + step < len(text) and text[at : at + step + 1] in train:
            step += 1
        count += 1
        at += step
    return count


def test_phrases_match_a_plain_parse(monkeypatch):
    rng = random.Random(2)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(2, 7)))
    samples = {"x": [" ".join(word("abcd") for _ in range(60)), "ab" * 40], "y": [" ".join(word("cdef") for _ in range(60)), "c" * 90]}
    texts = [" ".join(word("abcdefz") for _ in range(n)) for n in (1, 5, 400)] + ["ab" * 900, "c" * 2000, "z" * 700, "a", "cz" * 300, samples["x"][0] * 5]
    strings = {n: "".join(chr(c) for c in np.concatenate([np.append(langid.Model(samples).encode(t), 0) for t in samples[n]])) for n in samples}
    for wide, block, noted in ((128, 512, 8_000_000), (128, 7, 1), (0, 512, 8_000_000), (0, 5, 1)):  # dense, sparse, matches over many blocks and runs
        monkeypatch.setattr(langid, "WIDE", wide)
        monkeypatch.setattr(langid, "BLOCK", block)
        monkeypatch.setattr(langid, "NOTED", noted)
        m = langid.Model(samples)
        codes = [m.encode(t) for t in texts]
        want = [[plain_parse("".join(map(chr, c)), strings[n]) for n in m.names] for c in codes]
        assert m.phrases(codes).tolist() == want
        alone = [m.phrases([c])[0].tolist() for c in codes]  # a text's phrases do not depend on its neighbours
        assert alone == want


def _docs(make_docs):
    rng = random.Random(4)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))
    en, de = ["the", "ing", "and", "tion", "wh", "th"], ["sch", "ein", "ung", "und", "ich", "keit"]
    a, b = make_docs([make(en) for _ in range(120)]), make_docs([make(de) for _ in range(120)], lang="de", ids=range(1000, 1120))
    return a.unionByName(b).unionByName(make_docs([None, "", "123 !?", "ein"], lang=None, ids=[5000, 5001, 5002, None]))


def test_query(spark, make_docs, tables):
    sf = tables(documents=_docs(make_docs))
    got = {r.doc_id: r for r in langid.op10_cross_parsing(spark, sf).collect()}
    assert len(got) == 244
    for k, r in got.items():
        if k is not None:
            assert r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [(k, r) for k, r in got.items() if k is not None and k < 5000 and r.held_out]
    assert len(held) > 30 and all(r.lang_pred == ("en" if k < 1000 else "de") for k, r in held)
    assert [got[k].lang_pred for k in (5000, 5001, 5002)] == ["und"] * 3


def test_edges(spark, make_docs):
    docs = make_docs(["abc", None])
    assert [r.lang_pred for r in langid.identify(docs, {}).collect()] == ["und", "und"]
    assert langid.sample(docs.limit(0)) == {}
    one = langid.identify(docs, langid.sample(docs)).collect()
    assert (one[0].lang_pred, one[0].score) == ("en", 1.0) and one[0].extra == "y"
    long = langid.sample(make_docs(["abc def " * 50_000]), chars=1000)
    assert sum(map(len, long["en"])) == 1000
    copies = langid.sample(make_docs(["abc def ghi"] * 500))
    assert copies == {"en": ["abc def ghi"]}


def test_clashing_columns_and_very_long_texts(spark, make_docs):
    docs = make_docs(["the thing " * 100_000, "die dinge", "the thing"], ids=[1, 2, 3]).withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(9))
    out = langid.identify(docs, {"en": ["the thing and that"], "de": ["die dinge und das"]})
    assert sorted(out.columns) == sorted(c for c in docs.columns if c != "text")
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert [got[k][0] for k in (1, 2, 3)] == ["en", "de", "en"] and all(0.5 < x <= 1 for _, x in got.values())


def test_all_scripts_are_told_apart(monkeypatch):
    rng = random.Random(8)
    starts = {"aa": (0x61, 26), "el": (0x3B1, 24), "ru": (0x430, 32), "uk": (0x430, 32), "he": (0x5D0, 26), "ka": (0x10D0, 33), "th": (0xE01, 46), "zh": (0x4E00, 400), "yi": (0x4E80, 400)}
    words = {n: ["".join(chr(a + rng.randrange(size)) for _ in range(rng.randint(2, 5))) for _ in range(150)] for n, (a, size) in starts.items()}
    text = lambda n, k: " ".join(rng.choice(words[n]) for _ in range(k))
    samples = {n: [text(n, 1500 if n == "aa" else 500)] for n in starts}
    held = [(n, text(n, 30)) for n in starts for _ in range(10)]
    m = langid.Model(samples)
    assert [x for x, _ in m.predict([t for _, t in held])] == [n for n, _ in held]
    assert sum(isinstance(a, langid.Sparse) for a in m.automata) == 2
    counts = m.phrases([m.encode(t) for _, t in held])
    for name in ("el", "zh"):  # what a language makes of a text does not depend on the others
        alone = langid.Model({name: samples[name]})
        assert (alone.phrases([alone.encode(t) for _, t in held])[:, 0] == counts[:, m.names.index(name)]).all()
    monkeypatch.setattr(langid, "WIDE", 0)  # sparse and dense transitions agree
    assert (langid.Model(samples).phrases([m.encode(t) for _, t in held]) == counts).all()
