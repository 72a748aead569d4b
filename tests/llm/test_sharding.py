import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from graphloom.llm import sharding


def check(rows, texts, shards=24):
    size = Counter()
    slots = defaultdict(list)
    for r in rows:
        t = texts[r.doc_id] or ""
        assert r.size == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode())
        assert 0 <= r.shard < shards
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    most = max((r.size for r in rows), default=0)
    assert max(size.values()) - min(size[k] for k in range(shards)) <= 2 * most
    return size


def test_sizes_are_near_equal_with_a_hot_group(spark, make_docs, tables):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 300))) for _ in range(2000)] + ["copy of one text"] * 1500 + ["x" * 20_000, None, ""]
    rows = sharding.op9_sampled_splitters(spark, tables(documents=make_docs(texts))).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    check(rows, texts)
    where = defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 23  # equal texts part only at a boundary


def test_overfull_ranges_and_repeated_rows(spark, make_docs):
    docs = make_docs(["same"] * 900 + [str(k) for k in range(100)], ids=[1] * 900 + list(range(100)))
    rows = sharding.assign(docs, ranges=64).collect()
    size = Counter()
    for r in rows:
        size[r.shard] += r.size
    assert len(rows) == 1000 and max(size.values()) - min(size.values()) <= 24
    assert all(sorted(x.slot for x in rows if x.shard == k) == list(range(sum(x.shard == k for x in rows))) for k in size)


def test_small_tables(spark, make_docs):
    assert sharding.assign(make_docs(["a"]).limit(0)).count() == 0
    one = sharding.assign(make_docs([None], ids=[None])).collect()
    assert [(r.doc_id, r.size, r.text_crc32, r.slot) for r in one] == [(None, 8, 0, 0)]


def test_many_overfull_ranges_are_all_subdivided(spark, make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "OVERFULL", 1)
    monkeypatch.setattr(sharding, "ROWS", 4)
    texts = [f"{k}" * 3 for k in range(900)] + ["y" * 40_000, "z" * 30_000, "y" * 40_000]
    rows = sharding.assign(make_docs(texts), ranges=150).collect()
    check(rows, texts)


def test_clashing_columns_and_long_texts(spark, make_docs):
    texts = ["long " * 300_000, "short", None]
    docs = make_docs(texts).withColumns({"shard": F.lit("a"), "slot": F.lit("b"), "size": F.lit(None).cast("int"), "range": F.lit(1), "k1": F.lit(2), "uid": F.lit(3)})
    out = sharding.assign(docs)
    assert out.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    check(out.collect(), texts)
