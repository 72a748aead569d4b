import random

import numpy as np

from graphloom.llm import blockjoin


def brute(rows, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, dtype=np.float32).astype(float)
    out = {}
    for q in ok:
        if q % 50 == 0:
            s = [(-float(np.dot(ok[q], ok[c]) / np.sqrt(np.dot(ok[q], ok[q]) * np.dot(ok[c], ok[c]))), c) for c in ok if c != q and len(ok[c]) == len(ok[q])]
            out[q] = sorted(s)[:k]
    return out


def test_exact_with_odd_vectors_ties_and_copies(spark, tables):
    rng = random.Random(4)
    v = lambda: [rng.gauss(0, 1) for _ in range(8)]
    hot = v()
    rows = [(k, v()) for k in range(220)] + [(k, hot) for k in range(220, 330)] + [(400, [0.0] * 8), (401, None), (402, [1.0, None] + [0.0] * 6), (403, [float("nan")] * 8), (404, []), (450, hot), (451, [2.0, 1.0]), (None, v()), (7, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exp = brute([(i, x) for i, x in rows if (i, x) != (7, None)], 5)
    got = {}
    for r in blockjoin.op3_block_join(spark, tables(embeddings=df)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == {q for q, s in exp.items() if s}
    for q, s in got.items():
        s.sort()
        assert [r for r, _, _ in s] == list(range(1, len(s) + 1))
        assert np.allclose([x for _, _, x in s], [-x for x, _ in exp[q]], atol=1e-12)
    assert [i for _, i, _ in sorted(got[300])] == [220, 221, 222, 223, 224]  # ties go to the smaller id
    small = blockjoin.nearest(df.filter("vec_id % 50 = 0"), df, 5, query_block=2, block=13).collect()
    assert {(r.query_id, r.rank): r.vec_id for r in small} == {(q, r): i for q, s in got.items() for r, i, _ in s}


def test_empty_and_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in blockjoin.nearest(df.filter("vec_id = 0"), df, 5).collect()] == [(0, 1)]
    assert blockjoin.nearest(df.limit(0), df, 5).count() == 0
    assert blockjoin.nearest(df, df.limit(0), 5).count() == 0


def test_intervals_hold_and_only_survivors_are_fetched():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(20, 48)), rng.normal(size=(300, 48))
    y[100:140] = y[100]
    y[:20] = x * 3 + rng.normal(size=(20, 48)) * 1e-3
    side = lambda v, first: (np.arange(first, first + len(v)), np.array([hash(r.tobytes()) for r in v]), *blockjoin.quantise(v))
    left, right = side(x, 0), side(y, 1000)
    order = np.lexsort((right[0], right[1]))
    q, c, low, high = blockjoin.tile(left, tuple(part[order] for part in right), 3)
    cos = (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)
    true = cos[q, c - 1000]
    assert (low <= true).all() and (true <= high).all() and (high - low < 0.05).all()
    assert len(q) < 20 * 300 / 4
    for k in range(20):
        best = np.argsort(-cos[k], kind="stable")[:3] + 1000
        assert set(best) <= set(c[q == k])


def test_ids_that_repeat_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [1.0, 0.2]), (2, [1.0, 0.2])]
    df = spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, id int, score int, rank int, query_id string")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in blockjoin.nearest(df.filter("vec_id = 0"), df, 5).collect()]
    assert sorted(got) == [(0, 1, 1, 1.0), (0, 2, 2, round(0.2 / 1.04**0.5, 6))]  # the query is the smaller vector, (0, 1)
