import gzip
import hashlib

from pyspark.sql import functions as F

from graphloom.llm import warc

PAGES = "page_id long, url string, html string, id string, digest int"


def brute(rows):
    first = {}
    for i, h in rows:
        if i is not None and len(h.encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, h in rows:
        f = first.get(h)
        rev = f is not None and i != f
        out.append((i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if rev else "response", f if rev else None))
    return sorted(out, key=str)


def test_round_trip_and_revisits(spark, tables):
    odd = "WARC/1.1\r\nContent-Length: 5\r\n\r\n\r\nWARC/1.1\r\n" + "é😀" * 60
    texts = ["a" * 99, "a" * 99, "b" * 100, "b" * 100, "b" * 100, odd, odd, None, "", "c" * 300_000, "\r\n\r\n" * 40, "\r\n\r\n" * 40]
    rows = [(9 + 5 * k % 37, f"http://x/{k}\r\nX: y" if k else None, t, "z", 1) for k, t in enumerate(texts)] + [(None, "u", "b" * 100, "z", 1)]
    got = warc.op4_warc_revisits(spark, tables(pages=spark.createDataFrame(rows, PAGES))).collect()
    assert all(r.digest_holds for r in got)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute([(r[0], r[2] or "") for r in rows])


def test_repeated_rows_and_empty_table(spark, tables, tmp_path):
    df = spark.createDataFrame([(1, "u", "d" * 200, "", 0)] * 2 + [(2, "u", "d" * 200, "", 0)], PAGES)
    got = sorted((r.page_id, r.record_type) for r in warc.op4_warc_revisits(spark, tables(pages=df)).collect())
    assert got == [(1, "response"), (1, "response"), (2, "revisit")]
    assert warc.op4_warc_revisits(spark, tables(pages=df.limit(0))).count() == 0


def test_reader_takes_plain_and_member_gzip_files():
    one = lambda body: b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    bodies = [b"x" * 10, b"", b"y\r\n\r\n" * 1000]
    for raw in (b"".join(map(one, bodies)), b"".join(gzip.compress(one(b)) for b in bodies), gzip.compress(b"".join(map(one, bodies)))):
        assert [b for _, b in warc.records(raw)] == bodies


def test_payloads_are_not_shuffled(spark, tables, tmp_path, monkeypatch):
    texts = [c * 200 for c in "aabbbcdddde"] * 3 + ["short"] * 4
    df = spark.createDataFrame([(k, "u", x, "", 0) for k, x in enumerate(texts)], PAGES).repartition(6)
    sf = tables(pages=df)
    plans, plain = [], warc._write

    def spy(pages, told, *rest):
        left = pages.join(told.select(F.col("id").alias("_id"), "original"), F.col("page_id") == F.col("_id"), "left")
        plans.append(left._jdf.queryExecution().optimizedPlan().toString())
        plain(pages, told, *rest)

    monkeypatch.setattr(warc, "_write", spy)
    for flags in (1_000_000, 5):  # one run, and a run for every few files
        path = str(tmp_path / f"w{flags}")
        warc.write(spark.read.parquet(f"{sf}/pages.parquet"), path, flags=flags)
        got = warc.resolve(warc.read(spark, path)).collect()
        assert sorted(((int(r.page_id), r.payload_bytes, r.digest, r.record_type, r.original) for r in got), key=str) == brute(list(enumerate(texts)))
    assert len(plans) > 3 and all("strategy=broadcast" in p for p in plans)
    assert warc.batches([("c", 2), ("a", 3), ("b", 0), ("d", 9)], 4) == [["a", "b"], ["c"], ["d"]]


def test_plans_that_are_no_scan_and_large_payloads(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x" * 500, "", 0), (2, "u", "x" * 500, "", 0), (3, "u", "y" * 3_000_000, "", 0)], PAGES)
    warc.write(df.withColumn("digest", F.lit("clash")), str(tmp_path / "w"), file_bytes=1_000)
    got = {int(r.page_id): (r.record_type, r.payload_bytes) for r in warc.resolve(warc.read(spark, str(tmp_path / "w"))).collect()}
    assert got == {1: ("response", 500), 2: ("revisit", 500), 3: ("response", 3_000_000)}
