import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import mixing


def _docs(make_docs, n=600):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    texts, kinds = [], []
    for k in range(n):
        kind = ["high", "high", "high", "low", "toxic"][k % 5]
        w = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        if kind == "low":
            w = [x + "###" for x in w]
        if kind == "toxic":
            w += ["idiot", "moron"]
        texts.append(" ".join(w))
        kinds.append(kind)
    return make_docs(texts), kinds


def _labels(spark, kinds, every=2):
    return spark.createDataFrame([(k, int(x != "low"), int(x == "toxic")) for k, x in enumerate(kinds) if k % every == 0], "doc_id long, quality int, toxic int")


def test_classifier_and_targets(spark, make_docs):
    docs, kinds = _docs(make_docs)
    rows, names, shares = mixing.mix(docs, _labels(spark, kinds), {"high": 0.8, "low": 0.15, "toxic": 0.05})
    got = rows.collect()
    assert set(names) == {"high", "low", "toxic"} and len(got) == 600
    hit = sum(names[max(range(3), key=lambda j: r[f"p{j}"])] == kinds[r.id] for r in got)
    assert hit >= 570
    total = sum(r.tokens * r.rate for r in got)
    for j, n in enumerate(names):
        assert sum(r.tokens * r.rate * r[f"p{j}"] for r in got) / total == pytest.approx({"high": 0.8, "low": 0.15, "toxic": 0.05}[n], abs=1e-4)
        assert shares[n] == (pytest.approx({"high": 0.8, "low": 0.15, "toxic": 0.05}[n]), pytest.approx(sum(r.tokens * r.rate * r[f"p{j}"] for r in got) / total, abs=1e-9))
    assert all(0 <= r.rate <= 1 and abs(sum(r[f"p{j}"] for j in range(3)) - 1) < 1e-9 for r in got)
    taken = [r for r in got if r.taken]
    assert sum(kinds[r.id] == "high" for r in taken) >= 355


def _plain(tokens, p, weights, steps=200_000):
    """Plain projected gradient on all rates with one small step: the least squares problem itself."""
    t = np.array(tokens, dtype=float)
    p = np.array(p)
    total = t.sum()
    share = (t[:, None] * p).sum(axis=0) / total
    target = min(s / w for s, w in zip(share, weights) if w) * np.array(weights)
    a = t[:, None] * p / total
    r, step = np.ones(len(t)), 1 / np.linalg.norm(p.T @ a, 2)
    for _ in range(steps):
        g = a.T @ r - target
        new = np.maximum(0, r - step * (p @ g))
        if abs(new - r).max() < 1e-13:
            break
        r = new
    return r, a.T @ r, target


def test_rates_solve_the_least_squares_problem(spark):
    rng = random.Random(2)
    data = []
    for k in range(80):
        p = [rng.random() ** 3 for _ in range(3)]
        data.append((k, rng.randint(1, 50), *[x / sum(p) for x in p]))
    data += [(80, 0, 1.0, 0.0, 0.0), (81, 0, 0.2, 0.4, 0.4)]
    rows = spark.createDataFrame(data, "id int, tokens long, p0 double, p1 double, p2 double")
    for w in ([0.7, 0.2, 0.1], [0.1, 0.1, 0.8], [0.34, 0.33, 0.33]):
        rate, shares = mixing.rates(rows, w)
        got = {r.id: r.rate for r in rows.withColumn("rate", rate).collect()}
        _, have, target = _plain([d[1] for d in data], [d[2:] for d in data], w)
        assert np.allclose(have, target, atol=1e-6)  # these targets can be reached
        assert np.allclose(shares, w, atol=1e-6) and all(0 <= x <= 1 for x in got.values())
        mass = np.array([sum(d[1] * d[2 + k] * got[d[0]] for d in data) for k in range(3)])
        assert np.allclose(mass / mass.sum(), w, atol=1e-6)


def test_targets_out_of_reach(spark):
    data = [(k, 10 + k, 0.6 + 0.004 * k, 0.4 - 0.004 * k) for k in range(20)]  # the first domain has 0.6 to 0.676 of every document
    rows = spark.createDataFrame(data, "id int, tokens long, p0 double, p1 double")
    _, shares = mixing.rates(rows, [0.2, 0.8])
    start = sum(d[1] * d[2] for d in data) / sum(d[1] for d in data)
    assert 0.6 <= shares[0] < start - 0.01  # nearer, and no nearer than the documents allow
    assert sum(shares) == pytest.approx(1.0)


def test_query(spark, make_docs, tables):
    docs, kinds = _docs(make_docs)
    sf = tables(documents=docs, labels=_labels(spark, kinds))
    df = mixing.op8_soft_mixing(spark, sf)
    assert df.columns[:2] == ["doc_id", "tokens"] and df.columns[-2:] == ["rate", "taken"]
    got = {r.doc_id: r for r in df.collect()}
    assert [got[r.doc_id].tokens for r in docs.collect()] == [len(r.text.split()) for r in docs.collect()]
    names = ["high", "low", "toxic"]
    p = [[got[k][f"p_{n}"] for n in names] for k in range(600)]
    assert sum(names[int(np.argmax(x))] == kind for x, kind in zip(p, kinds)) >= 570
    mass = np.array([[got[k].tokens * got[k].rate * x for x in p[k]] for k in range(600)]).sum(axis=0)
    assert np.allclose(mass / mass.sum(), [mixing.TARGETS[n] for n in names], atol=1e-6)
    assert max(r.rate for r in got.values()) == pytest.approx(1.0) and all(not r.taken for r in got.values() if r.rate == 0)


def test_clashing_columns_and_long_texts(spark, make_docs):
    docs, kinds = _docs(make_docs, 60)
    odd = docs.withColumns({"rate": F.lit("x"), "taken": F.lit(3), "tokens": F.lit(1.5), "p0": F.lit("y"), "mark": F.lit(0)})
    odd = odd.unionByName(odd.limit(1).withColumn("text", F.repeat(F.lit("word and "), 300_000)).withColumn("doc_id", F.lit(99).cast("long")))
    out = mixing.take(odd, _labels(spark, kinds))
    assert out.columns == odd.columns and 0 < out.count() <= 61


def test_edges(spark, make_docs):
    docs, kinds = _docs(make_docs, 40)
    none = _labels(spark, kinds).limit(0)
    rows, names, _ = mixing.mix(docs, none, mixing.TARGETS)
    assert names == ["all"] and all(r.taken for r in rows.collect())
    odd = make_docs([None, "", "a b"] * 2, ids=[None, 1, 2, None, 1, 2])
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    out = mixing.take(odd, labels)
    assert out.columns == odd.columns and out.count() == 6
    assert mixing.take(docs.limit(0), _labels(spark, kinds)).count() == 0
    same = mixing.mix(docs.unionByName(docs), _labels(spark, kinds), mixing.TARGETS).rows.groupBy("id").agg(F.countDistinct("taken").alias("n")).filter("n > 1")
    assert same.count() == 0
