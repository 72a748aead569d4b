"""The registered fuzzy query against difflib over all pairs."""

from difflib import SequenceMatcher

from graphloom.plans import queries_graph


def test_every_name_is_matched(spark, tmp_path):
    names = {k: f"Customer#{k * 7919 % 10**6:09d}" for k in range(1, 151)}
    spark.createDataFrame([(k, n) for k, n in names.items()], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.c_custkey: (r.target, r.name, r.score) for r in queries_graph.fuzzy_best_match(spark, str(tmp_path)).collect()}
    want = {}
    for k, n in names.items():
        at = k % 5 + 3
        t = n[:at] + n[at + 1 :] if k % 3 == 0 else n
        score, first = max((SequenceMatcher(None, t, c, autojunk=False).ratio(), -j) for j, c in names.items())
        if score >= 0.9:
            want[k] = (t, names[-first], round(score, 6))
    assert len(want) == 150 and got == want
