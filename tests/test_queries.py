"""Every registered query with SQL gives DuckDB's rows; the others give rows."""

import math
import os
from collections import Counter

import pytest

from graphloom.plans import queries_graph, queries_text, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or isinstance(v, int):
        return v
    return round(v, 9) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in registry.SQL:
        assert rows
        return
    cur = duck.execute(registry.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert rows == Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_newline_flags_on_odd_texts(spark, duck, tmp_path):
    """Against the query's SQL, and without Python workers: tokens of a batch of long texts do not fit one."""
    odd = [None, "", " ", "\n", "a", "a\nb", "\na\n", " \n\ta b\r\n c\n\n\n d \r", "a\u2028b\u3000\n\u00a0c", "a\x1c\nb\n\x1cc", "a/b\n\n/c\n\U0001f600\nd", "\n \u00a0" * 20_000 + "a" + " \n" * 50_000 + "b" + "\n " * 50_000]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES["token_newline_flags"](spark, str(tmp_path))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    sql = registry.SQL["token_newline_flags"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(duck.execute(sql).fetchall())
