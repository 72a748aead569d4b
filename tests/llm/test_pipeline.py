import hashlib
import os
import subprocess
import sys

import pytest

import corpus_pipeline
from graphloom.llm import registry

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        rows = out.count()
        assert 0 < rows <= n
        if name != "encode":
            assert out.columns == columns
        docs, n = out, rows
    r = docs.first()
    assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()


def test_run_on_odd_rows(spark, tables):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 AS kept", "'q' AS FP", "0 AS n_tokens")
    none = docs.limit(20).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "CAST(NULL AS BIGINT) AS n_chars", "kept", "FP", "n_tokens")
    sf = tables(documents=docs.unionByName(none).unionByName(docs.limit(30)), labels=spark.read.parquet(f"{SF}/labels.parquet"))
    plain = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and None not in ids
    assert len(plain & set(ids)) > 0.8 * len(plain)
    empty = tables(documents=docs.limit(0), labels=spark.read.parquet(f"{SF}/labels.parquet"))
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_registered():
    import __spark_entry__

    assert set(registry.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert {int(k[2:].split("_")[0]) for k in registry.QUERIES} == set(range(1, 11))


def test_the_rest_works_without_these_folders(tmp_path):
    for d in ("graphloom", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{ROOT}/{d}", tmp_path], check=True)
    subprocess.run(["rm", "-r", f"{tmp_path}/graphloom/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'kg_build_stats' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
