import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import quality


def brute_repeats(words):
    n, seen = len(words), Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    return len({j for k in range(n - 7) if seen[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)})


def test_counts_match_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice(["a", "bb", "é#", " ", "\n", "\t", "|", "A1", " a bb A1 c d e f g h "]) for _ in range(rng.randint(0, 60)))
        words = t.replace("\x0b", " ").split()
        lines = [x for x in t.split("\n") if x.strip(" \t\v\f\r")]
        got = dict(zip(quality.COUNTS, quality.count_text(t)))
        assert got["n_words"] == len(words) and got["word_chars"] == sum(map(len, words))
        assert got["n_symbols"] == sum(t.count(c) for c in "#*$%&|<>")
        assert got["n_dup_lines"] == len(lines) - len(set(lines)) and got["n_repeat_words"] == brute_repeats(words)
    assert quality.count_text(None) == quality.count_text("") == (0,) * len(quality.COUNTS)
    assert quality.count_text("a b c")[0] == 1  # only ASCII white space parts words


def _texts(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "and", "river", "mountain", "house", "garden", "winter", "summer", "people", "letter", "morning", "a", "in", "quiet"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(40, 200))) + "." for _ in range(n)]


def test_outliers_go_and_clean_rows_stay(spark, make_docs):
    clean = _texts(400)
    junk = [" ".join(w + "###" for w in t.split()) for t in _texts(12, 2)] + [t.upper().replace(" ", "!! ") for t in _texts(12, 3)]
    short = ["too short", None, ""]
    docs = make_docs(clean + junk + short)
    out = quality.keep_good(docs)
    assert {r.doc_id for r in out.collect()} == set(range(400))
    assert out.columns == docs.columns and out.first().extra == "y"


def test_groups_nulls_ties_and_empty_tables(spark, make_docs):
    docs = make_docs(_texts(60)).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, "en")).withColumn("source", F.when(F.col("doc_id") % 2 > 0, "s"))
    assert quality.keep_good(docs).count() == 60  # small groups lean on others
    same = make_docs(_texts(1) * 50)
    assert quality.keep_good(same).count() == 50
    assert quality.keep_good(docs.limit(0)).count() == 0
    long = make_docs([" ".join(_texts(2000))])
    assert quality.keep_good(long).count() == 1


def test_query(spark, make_docs, tables):
    sf = tables(documents=make_docs(_texts(30) + [None]))
    got = {r.doc_id: r for r in quality.op1_mcd_quality(spark, sf).collect()}
    assert len(got) == 31 and got[30].base_failed and not got[30].kept and got[0].kept
    assert dict(quality.op1_mcd_quality(spark, sf).dtypes)["n_repeat_words"] == "bigint"


def _plain(counts, langs, sources):
    """Squared distances by numpy: the same rule, row by row and group by group."""
    P, x = quality.P, []
    names = quality.COUNTS
    total = lambda rows, c: sum(counts[k][names.index(c)] for k in rows)
    all_ = list(range(len(counts)))
    groups = {(g, h): [k for k in all_ if (langs[k], sources[k]) == (g, h)] for g, h in set(zip(langs, sources))}
    of_lang = {g: [k for k in all_ if langs[k] == g] for g in set(langs)}
    for k in all_:
        row = []
        for stat, (a, b, pseudo, _) in quality.STATS.items():
            prior = total(all_, a) / max(total(all_, b), 1)
            for rows in (of_lang[langs[k]], groups[langs[k], sources[k]]):
                prior = (total(rows, a) + quality.PRIOR * pseudo * prior) / (total(rows, b) + quality.PRIOR * pseudo)
            ratio = (counts[k][names.index(a)] + pseudo * prior) / (counts[k][names.index(b)] + pseudo)
            row.append(np.log(max(ratio, 0.01)) if stat == "word_length" else np.arcsin(np.sqrt(min(ratio, 1))))
        x.append(row)
    x = np.array(x)
    lower = lambda v, q: np.sort(v)[max(0, int(np.ceil(q * len(v))) - 1)]  # noqa: E731  percentile_approx on few rows

    def blend(rows, m0, c0, shrink=1.0):
        n, s, ss = len(rows), rows.sum(axis=0), rows.T @ rows
        m = (s + quality.PRIOR * m0) / (n + quality.PRIOR)
        return m, (ss + quality.PRIOR * (c0 / shrink + np.outer(m0, m0))) / (n + quality.PRIOR) - np.outer(m, m)

    def d2(rows, m, c):
        return np.maximum(np.einsum("ij,jk,ik->i", rows - m, np.linalg.inv(c + quality._FLOORS), rows - m), 0)

    def bins(d):
        return np.where(d < 1e-6, -160, np.floor(np.log2(np.maximum(d, 1e-300)) * quality._BINS))

    def half(rows, m, c, m0, c0):
        b = bins(d2(rows, m, c))
        edge = np.sort(b)[int(-(-(len(rows) + P + 1) // 2)) - 1] if -(-(len(rows) + P + 1) // 2) <= len(rows) else b.max()
        return blend(rows[b <= edge], m0, c0, quality.HALF)

    det = lambda c: np.linalg.slogdet(c + quality._FLOORS)[1]

    def spread(rows):
        r = np.array([[lower(v, q) for q in (0.25, 0.5, 0.75)] for v in rows.T])
        return r[:, 1], np.diag(((r[:, 2] - r[:, 0]) / 1.349) ** 2)

    def fit(parts, priors, both=True):
        """All groups step together, as long as one of them moves."""
        found = {}
        for g, rows in parts.items():
            m, c = spread(rows)
            m0, c0 = priors[g]
            n = len(rows)
            s, ss = n * m + quality.PRIOR * m0, n * (c + np.outer(m, m)) + quality.PRIOR * (c0 + np.outer(m0, m0))
            first = s / (n + quality.PRIOR)
            found[g] = [(first, ss / (n + quality.PRIOR) - np.outer(first, first))] + [blend(rows, m0, c0)] * both
        for _ in range(quality.STEPS):
            found = {g: [half(parts[g], m, c, *priors[g]) for m, c in f] for g, f in found.items()}
        found = {g: [min(f, key=lambda e: det(e[1]))] for g, f in found.items()}
        for _ in range(quality.MORE_STEPS * both):
            new = {g: [half(parts[g], *f[0], *priors[g])] for g, f in found.items()}
            still = all(abs(det(new[g][0][1]) - det(f[0][1])) < quality.STILL for g, f in found.items())
            found = new
            if still:
                break
        out = {}
        for g, ((m, c),) in found.items():
            rows, n = parts[g], len(parts[g])
            b = bins(d2(rows, m, c))
            levels = np.unique(b)
            below = np.cumsum([(b == v).sum() for v in levels])
            middle = 2.0 ** ((levels[int(np.searchsorted(below, 0.5 * n))] + 0.5) / quality._BINS)
            middle = (n * middle + quality.PRIOR * quality.MIDDLE) / (n + quality.PRIOR)
            at = max(0, int(np.searchsorted(levels, np.log2(quality.KEEP * middle / quality.MIDDLE) * quality._BINS)) - 1)
            m, c = blend(rows[b <= levels[at]], *priors[g], quality.NEARLY_ALL)
            mid = (n * lower(d2(rows, m, c), 0.5) + quality.PRIOR * quality.MIDDLE) / (n + quality.PRIOR)
            out[g] = m, c, min(1.0, quality.MIDDLE / max(mid, 1e-6))
        return out

    langs_fit = fit({g: x[r] for g, r in of_lang.items()}, dict.fromkeys(of_lang, spread(x)), False)
    fits = fit({g: x[r] for g, r in groups.items()}, {g: (langs_fit[g[0]][0], langs_fit[g[0]][1] / langs_fit[g[0]][2]) for g in groups})
    return [float(d2(x[k : k + 1], *fits[langs[k], sources[k]][:2])[0] * fits[langs[k], sources[k]][2]) for k in all_]


def test_distances_match_numpy(spark, make_docs):
    rng = random.Random(9)
    texts = _texts(150, 4) + [" ".join(w + "###" for w in t.split()) for t in _texts(5, 2)] + ["1234 " * 40, None, "x"]
    langs = [rng.choice(["en", "en", "de", None]) for _ in texts]
    sources = [rng.choice(["a", "a", "b"]) if k > 3 else f"rare{k}" for k in range(len(texts))]
    rows = [(k, t, a, b) for k, (t, a, b) in enumerate(zip(texts, langs, sources))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judged(quality.materialise(quality.counts(docs), "t")).collect()}
    want = _plain([quality.count_text(t) for t in texts], langs, sources)
    for k, d in enumerate(want):
        assert math.isclose(got[k].distance, d, rel_tol=1e-6, abs_tol=1e-6)
        assert got[k].kept == (not got[k].base_failed and d <= quality.CUTOFF)
    assert not any(got[k].kept for k in range(150, 158)) and sum(got[k].kept for k in range(150)) >= 148
