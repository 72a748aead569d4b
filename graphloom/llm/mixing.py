"""Mixing to target weights by soft membership (operator 8), with DataFrame functions only.

A labelled table names the domain of some documents. Words, the ends of words,
and the variety of words are features of a naive Bayes classifier over those
features that speak for a domain against all others (at most ``FEATURES`` a
domain, by the G statistic), fitted on one half of a bounded sample of
labelled rows; the other half sets how far its log-odds are to be trusted. Every document gets
posteriors over the domains, so it belongs to each in part.

With t_i tokens and posteriors p_i, document rates r_i >= 0 solve

    min 1/2 sum_k (sum_i t_i p_ik r_i - T_k)^2

where T are the target tokens, by projected gradient from r = 1. The gradient of
a document, per token, is p_i . g, with g the residual; a step takes
r_i to max(0, r_i - p_i . M g). Every step aggregates the residual and the Gram
matrix of the documents that are not at zero over the whole corpus (a handful of
sums, pre-aggregated in every task). M is the inverse of that matrix, which
whitens the residual, or, where such a step does not bring it down, the plain
step 1 / trace. A rate is a fold over the steps taken, so no column of rates is
kept between them. Rates are then scaled so that the largest is 1, which leaves
the mixture as it is. A document is taken with the chance that its rate says, by
a hash of its id; the expected token shares are the targets. Shares that no mix
of the documents reaches are approached as nearly as the steps allow; what is
reached is returned, and a warning is given.

Null and empty texts have no tokens, the prior as posteriors, and weigh
nothing. Labels that repeat count once each; a label row with a null counts
not. Without a usable label all posteriors are equal. Repeated rows share
their rate and their draw. A domain without any mass is left at zero.
"""

from __future__ import annotations

import math
import warnings
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, table

#: Begins the features that are not words; texts cannot hold it inside a word, since it is white space.
MARK = "\t"
#: Telling features of a domain at most.
FEATURES = 256
#: Labelled rows that the classifier sees at most.
SAMPLE = 8_192
SHRINK = 0.5
#: G statistic and lift from which a feature speaks for a domain. Others are left out: small lifts are noise, and common words, which long texts hold together, would be counted again and again.
TELLING = 30.0
LIFT = 2.0
STEPS = 40
#: Residual share at which the rates are found, and difference from a target share that is worth a warning.
FOUND, MISSED = 1e-9, 0.005
#: Trust in the log-odds: factor, power of 100 / length, and bias against the rarer domains where nothing speaks for them.
SCALES = [0.1, 0.3, 0.6, 1.0]
POWERS = [0.0, 0.5]
BIASES = [0.0, -1.0, -2.0, -3.0, -4.0]
#: Token shares of the production mix.
TARGETS = {"high": 0.90, "low": 0.07, "toxic": 0.03}


def domains_of(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, domain) by the columns quality and toxic."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").otherwise("low")
    return labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()).select(F.col(id_col).alias("_id"), domain.alias("domain")).distinct()


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), lambda w: w != "")


def _endings(words: Column) -> Column:
    return F.transform(words, lambda w: F.concat(F.lit(MARK), F.substring(w, -2, 2)))


def _variety(words: Column) -> Column:
    """A feature for how few of the words differ."""
    return F.concat(F.lit(MARK * 2), F.floor(10 * F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))).cast("string"))


def _features(words: Column) -> Column:
    """Distinct words, endings of words, and variety."""
    return F.array_distinct(F.concat(words, _endings(words), F.array(_variety(words))))


def _list(values: list[str], kind: str = "string") -> Column:
    """A constant array, parsed once when the plan is optimised: a single node, however long it is. No value holds a line break."""
    return F.split(F.lit("\n".join(values)), "\n").cast(f"array<{kind}>")


def _score(found: Column, weights: dict[str, float]) -> Column:
    if not weights:
        return F.lit(0.0)
    keys = sorted(weights)
    table_ = F.map_from_arrays(_list(keys), _list([repr(weights[k]) for k in keys], "double"))
    return F.aggregate(found, F.lit(0.0), lambda acc, f: acc + F.coalesce(F.element_at(table_, f), F.lit(0.0)))


def _found(words: Column, telling: list[str]) -> Column:
    """The telling features that a text holds."""
    plain = [t for t in telling if not t.startswith(MARK)]
    ends = [t for t in telling if t.startswith(MARK) and not t.startswith(MARK * 2)]
    none = F.array().cast("array<string>")
    return F.concat(F.array_intersect(words, _list(plain)) if plain else none, F.array_intersect(_endings(words), _list(ends)) if ends else none, F.array(_variety(words)))


def _with_posteriors(rows: DataFrame, prior: list[float], scale: Column, power: Column, bias: Column) -> DataFrame:
    """``rows`` (s1, s2, ..., n) with p0, p1, ...: log-odds are scaled by scale * (100 / n)^power, so that long texts do not always seem certain."""
    size = len(prior)
    f = scale * F.pow(100.0 / F.greatest(F.col("n"), F.lit(100)), power)
    rows = rows.withColumn("_f", f)
    rows = rows.withColumns({"_z0": F.lit(prior[0]), **{f"_z{k}": F.lit(prior[k]) + bias + F.col(f"s{k}") * F.col("_f") for k in range(1, size)}})
    rows = rows.withColumn("_top", F.array_max(F.array(*[F.col(f"_z{k}") for k in range(size)])))
    rows = rows.withColumns({f"_e{k}": F.exp(F.greatest(F.col(f"_z{k}") - F.col("_top"), F.lit(-700.0))) for k in range(size)})
    rows = rows.withColumn("_sum", sum((F.col(f"_e{k}") for k in range(size)), F.lit(0.0)))
    rows = rows.withColumns({f"p{k}": F.col(f"_e{k}") / F.col("_sum") for k in range(size)})
    return rows.drop("_f", "_top", "_sum", *[f"_{c}{k}" for c in "ze" for k in range(size)])


def _fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int):
    """Names, log priors, log-ratios against the first domain, and the trust (scale, power, bias) in the classifier."""
    drawn = labels.orderBy(F.xxhash64("_id"), "_id", "domain").limit(sample)
    drawn = materialise(drawn.withColumn("half", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(2))), "mix-sample")
    count = {r.domain: r.n for r in drawn.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    names = sorted(count, key=lambda n: (-count[n], n))  # the most frequent domain is the reference
    if not names:
        return [], [], [], (1.0, 0.0, 0.0)
    total = sum(count.values())
    prior = [math.log(count[n] / total) for n in names]
    rows = docs.join(F.broadcast(drawn), docs[id_col] == drawn["_id"])  # at most `sample` rows
    rows = rows.withColumn("_mark", F.xxhash64(text_col)).dropDuplicates(["_mark", "domain"])  # copies of a text count once
    rows = materialise(rows.select("domain", "half", _words(F.col(text_col)).alias("w")), "mix-labelled")
    fitted = rows.filter("half = 0")
    n_k = {r.domain: r.n for r in fitted.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n_k = [n_k.get(n, 0) for n in names]
    whole = max(1, sum(n_k))
    sums = [F.sum((F.col("domain") == n).cast("long")).alias(f"c{k}") for k, n in enumerate(names)]
    held = fitted.select("domain", F.explode(_features(F.col("w"))).alias("f")).groupBy("f").agg(F.count("*").alias("n"), *sums)
    ratios = []
    for k in range(1, len(names)):
        c, n, e = F.col(f"c{k}"), F.col("n"), F.col("n") * (n_k[k] / whole)
        part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
        g = 2 * (part(c, e) + part(n - c, n - e))
        best = held.withColumn("g", g).filter((F.col("g") >= TELLING) & (c >= LIFT * e)).orderBy(F.desc("g"), "f").limit(FEATURES).collect()
        ratios.append({r.f: math.log((r[f"c{k}"] + SHRINK) / (r.n * n_k[k] / whole + SHRINK)) for r in best})
    telling = sorted({f for r in ratios for f in r})
    scored = rows.filter("half = 1").select("domain", F.size("w").alias("n"), _found(F.col("w"), telling).alias("b"))
    scored = scored.select("domain", "n", *[_score(F.col("b"), r).alias(f"s{k}") for k, r in enumerate(ratios, 1)])
    grid = [(c, a, b) for c in SCALES for a in POWERS for b in BIASES]
    if not ratios:
        return names, prior, ratios, (1.0, 0.0, 0.0)
    scored = materialise(scored, "mix-scores")
    tried = scored.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))
    of = lambda k: F.element_at(_list([str(x[k]) for x in grid], "double"), F.col("g") + 1)
    tried = _with_posteriors(tried, prior, of(0), of(1), of(2))
    hit = F.element_at(F.array(*[F.col(f"p{k}") for k in range(len(names))]), F.array_position(_list(names), F.col("domain")).cast("int"))
    losses = tried.groupBy("g").agg(F.avg(-F.log(F.greatest(hit, F.lit(1e-6)))).alias("l")).collect()  # a row a setting
    best = min(((r.l, r.g) for r in losses), default=(0.0, 0))[1]
    return names, prior, ratios, grid[best]


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sample: int = SAMPLE) -> tuple[DataFrame, list[str]]:
    """(id, mark, tokens, p0, p1, ...) of every document, and the names of the domains; id and the text's hash ``mark`` key a row."""
    names, prior, ratios, trust = _fit(docs, labels, id_col, text_col, sample)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), _words(F.col(text_col)).alias("w"))
    tokens = F.size("w").cast("long").alias("tokens")
    if not names:
        return rows.select("id", "mark", tokens, F.lit(1.0).alias("p0")), ["all"]
    telling = sorted({f for r in ratios for f in r})
    rows = rows.select("id", "mark", tokens, _found(F.col("w"), telling).alias("b"))
    rows = rows.select("id", "mark", "tokens", *[_score(F.col("b"), r).alias(f"s{k}") for k, r in enumerate(ratios, 1)])
    c, a, b = map(F.lit, trust)
    rows = _with_posteriors(rows.withColumn("n", F.col("tokens")), prior, c, a, b)
    return rows.select("id", "mark", "tokens", *[f"p{k}" for k in range(len(names))]), names


def _solve(m: list[list[float]], v: list[float]) -> list[float]:
    """Gaussian elimination with pivoting; a handful of domains."""
    n = len(v)
    rows = [[*m[k], v[k]] for k in range(n)]
    for k in range(n):
        top = max(range(k, n), key=lambda r: abs(rows[r][k]))
        rows[k], rows[top] = rows[top], rows[k]
        for r in range(n):
            if r != k and rows[k][k]:
                f = rows[r][k] / rows[k][k]
                rows[r] = [a - f * b for a, b in zip(rows[r], rows[k])]
    return [rows[k][n] / rows[k][k] if rows[k][k] else 0.0 for k in range(n)]


def _rate(p: list[Column], moves: list[list[float]]) -> Column:
    """Rates after ``moves``, projected onto zero and above after each."""
    if not moves:
        return F.lit(1.0)
    steps = F.array(*[F.array(*map(F.lit, d)) for d in moves])
    return F.aggregate(steps, F.lit(1.0), lambda acc, d: F.greatest(F.lit(0.0), acc - sum((p[k] * d[k] for k in range(len(p))), F.lit(0.0))))


def rates(rows: DataFrame, weights: list[float], *, steps: int = STEPS) -> tuple[Column, list[float]]:
    """The rate of each document as an expression over its posteriors, and the expected token shares."""
    size = len(weights)
    p = [F.col(f"p{k}") for k in range(size)]
    t = F.col("tokens").cast("double")
    mass = rows.agg(F.sum(t).alias("t"), *[F.sum(t * p[k]).alias(f"m{k}") for k in range(size)]).first()
    if not mass.t:
        return F.lit(1.0), [0.0] * size
    share = [mass[f"m{k}"] / mass.t for k in range(size)]
    live = [k for k in range(size) if share[k] > 0 and weights[k] > 0]
    scale = min((share[k] / weights[k] for k in live), default=1.0)
    target = [scale * w if k in live else 0.0 for k, w in enumerate(weights)]

    def state(moves):
        """Expected masses by domain, and the Gram matrix of the documents that are not at zero."""
        r = _rate(p, moves)
        seen = rows.select(*[(t / mass.t).alias("t"), *p, r.alias("r")])
        on = F.when(F.col("r") > 0, F.col("t")).otherwise(0.0)
        got = seen.agg(*[F.sum(F.col("t") * p[k] * F.col("r")).alias(f"a{k}") for k in range(size)], *[F.sum(on * p[k] * p[j]).alias(f"g{k}_{j}") for k in range(size) for j in range(k + 1)]).first()
        return [got[f"a{k}"] for k in range(size)], [[got[f"g{max(k, j)}_{min(k, j)}"] for j in range(size)] for k in range(size)]

    def miss(have):
        return sum((a - b) ** 2 for a, b in zip(have, target))

    moves: list[list[float]] = []
    have, gram = state(moves)
    tried = 0
    while miss(have) > FOUND**2 and tried < steps:
        g = [a - b for a, b in zip(have, target)]
        trace = sum(gram[k][k] for k in range(size)) or 1.0
        ridge = [[gram[k][j] + (1e-12 * trace if k == j else 0.0) for j in range(size)] for k in range(size)]
        for d in (_solve(ridge, g), [x / trace for x in g]):
            tried += 1
            new = state([*moves, d])
            if miss(new[0]) < 0.999 * miss(have):
                moves.append(d)
                have, gram = new
                break
        else:
            break  # no mix of these documents comes nearer
    top = rows.filter("tokens > 0").agg(F.max(_rate(p, moves)).alias("r")).first().r
    return F.least(F.lit(1.0), _rate(p, moves) / (top or 1.0)), [x / (sum(have) or 1.0) for x in have]


def limited(rows: DataFrame, weights: list[float]) -> list[float]:
    """Weights that are limits: a domain below its own keeps its share, and the first domain takes the rest."""
    t = F.col("tokens").cast("double")
    got = rows.agg(F.sum(t).alias("t"), *[F.sum(t * F.col(f"p{k}")).alias(f"m{k}") for k in range(len(weights))]).first()
    if not got.t:
        return weights
    out = [min(w, got[f"m{k}"] / got.t) for k, w in enumerate(weights)]
    return [1.0 - sum(out[1:]), *out[1:]]


class Mix(NamedTuple):
    """(id, mark, tokens, posteriors, rate, taken) of every document, the names of the domains, and (target, expected) token share of each."""

    rows: DataFrame
    names: list[str]
    shares: dict[str, tuple[float, float]]


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", *, limits: bool = False, sample: int = SAMPLE) -> Mix:
    """Rates by which documents make up the targets."""
    found, names = classify(docs, domains_of(labels, id_col), id_col, text_col, sample=sample)
    rows = materialise(found, "mix-posteriors")
    weights = [targets.get(n, 0.0) for n in names] if names != ["all"] else [1.0]
    weights = limited(rows, weights) if limits else weights
    rate, reached = rates(rows, weights)
    total = sum(weights) or 1.0
    shares = {n: (w / total, r) for n, w, r in zip(names, weights, reached)}
    far = [f"{n}: {r:.4f} for {w:.4f}" for n, (w, r) in shares.items() if abs(w - r) > MISSED]
    if far and any(reached):
        warnings.warn(f"no mix of these documents has the target shares; {', '.join(far)}", stacklevel=2)
    u = F.shiftrightunsigned(F.xxhash64("id", "mark", F.lit("mix")), 11) / F.lit(float(1 << 53))
    return Mix(rows.withColumn("rate", rate).withColumn("taken", u < F.col("rate")), names, shares)


def take(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", *, limits: bool = True) -> DataFrame:
    """The rows of ``docs`` that the mix takes. The targets are limits unless told otherwise, so that a domain which is rare already does not thin out all others."""
    decided = mix(docs, labels, targets, id_col, text_col, limits=limits).rows
    gone = materialise(decided.filter(~F.col("taken")).select(F.col("id").alias("_id"), F.col("mark").alias("_mark")).distinct(), "mix-left-out")
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (F.xxhash64(docs[text_col]) == gone["_mark"]), "left_anti")


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names, _ = mix(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), TARGETS)
    return rows.select(F.col("id").alias("doc_id"), "tokens", *[F.col(f"p{k}").alias(f"p_{n}") for k, n in enumerate(names)], "rate", "taken")
