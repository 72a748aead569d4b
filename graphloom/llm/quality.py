"""Robust multivariate outliers as a quality rule (operator 1).

One pass counts what each whole text holds. Ratios of these counts are shrunk
towards the pooled ratio of their group (short texts say little) and
transformed to stable variance. Each group of language and source gets a
minimum-covariance-determinant estimate of centre and scatter: from two
deterministic starts, concentration steps re-estimate both from the half of
the rows with the smallest Mahalanobis distances, the lower determinant wins and
goes on until it stands still or ``MORE_STEPS`` are done, and one reweighting
step follows. Rows beyond the cutoff are rejected.

Every group, however small, has an estimate of its own. It leans on the estimate
of its language (from the robust start alone) as on ``PRIOR`` further rows, and
that of a language on the medians and quartile ranges of all rows; in large groups these rows do not
count, and there is no size at which the rule changes. Pooled ratios lean on
each other in the same way.

A step is one aggregation: distances fall into narrow bins, and every bin's
count and moments are summed per group, so the half and its moments come from
at most a few hundred rows per group, however many documents it has. The half
is closed to the upper edge of its last bin, so ties are never split.

A null language or source is a group of its own. A null or empty text has no
words and fails the base rules. Repeated rows count as often as they occur. Rows
at the very cutoff are kept.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import materialise, small_batches, table, without

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
MARKS = b"!?.,;:"
WINDOW = 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_doubled"]
#: statistic: (numerator, denominator, pseudo-count of the denominator, floor of the standard deviation)
STATS = {
    "word_length": ("word_chars", "n_words", 40.0, 0.06),
    "symbols": ("n_symbols", "word_chars", 200.0, 0.05),
    "upper": ("n_upper", "word_chars", 200.0, 0.05),
    "marks": ("n_marks", "word_chars", 200.0, 0.05),
    "digits": ("n_digits", "word_chars", 200.0, 0.07),
    "dup_lines": ("n_dup_lines", "n_lines", 8.0, 0.12),
    "repeats": ("n_repeat_words", "n_words", 40.0, 0.12),
    "doubled": ("n_doubled", "n_words", 40.0, 0.07),
}
P = len(STATS)
#: Squared distance beyond which a row is rejected; the 0.9999 quantile of chi-squared with 8 degrees of freedom is 31.83.
CUTOFF = 31.83
#: Squared distance that the reweighting step keeps: the 0.975 quantile of chi-squared with 8 degrees of freedom.
KEEP = 17.53
#: Median of chi-squared with 8 degrees of freedom.
MIDDLE = 7.344
#: Times that normal scatter is larger than that of its central half, and of its central 0.975 (eight dimensions).
HALF, NEARLY_ALL = 1.625, 1.041
#: Rows that a group's prior counts for, and documents' worth of pseudo-counts that a pooled ratio leans on.
PRIOR = 100
#: Concentration steps for all starts, and at most for the better one then; these end when no determinant moves by more than STILL (logarithm).
STEPS, MORE_STEPS, STILL = 2, 4, 0.01
_BINS = 8  # per doubling of the squared distance

_mix = np.random.default_rng(8).integers(1, 1 << 63, size=WINDOW, dtype=np.uint64) | np.uint64(1)


def _repeat_words(ids: np.ndarray) -> int:
    """Words in windows that occur twice or more; windows meet by a 64-bit hash of their word numbers."""
    n = len(ids)
    if n < WINDOW + 1:
        return 0
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    h = np.zeros(n - WINDOW + 1, dtype=np.uint64)
    for k in range(WINDOW):
        h += x[k : n - WINDOW + 1 + k] * _mix[k]
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.nonzero(np.isin(h, twice))[0]
    cover = np.zeros(n + 1, dtype=np.int64)
    cover[at] += 1
    cover[at + WINDOW] -= 1
    return int((np.cumsum(cover)[:-1] > 0).sum())


def count_text(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, in the order of ``COUNTS``."""
    raw = (text or "").encode()
    words = raw.split()
    size = len(raw)
    have = lambda chars: size - len(raw.translate(None, chars))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    number = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    return (len(words), len(text or "") - have(SPACE), have(SYMBOLS), len(lines) - len(set(lines)), _repeat_words(ids), len(lines), have(UPPER), have(DIGITS), have(MARKS), int((ids[1:] == ids[:-1]).sum()))


def counts(docs: DataFrame, text_col: str = "text", *, keep_text: bool = False) -> DataFrame:
    """Every row with ``COUNTS``; the text goes unless kept."""
    small_batches(docs.sparkSession)
    source = without(docs, COUNTS)
    kept = [f for f in source.schema.fields if keep_text or f.name != text_col]
    names = {f.name for f in kept}
    schema = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def run(batches):
        for b in batches:
            found = np.array([count_text(t.as_py()) for t in b.column(b.schema.get_field_index(text_col))], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i, f in enumerate(b.schema) if f.name in names), *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(len(COUNTS)))], names=schema.names)

    return source.mapInArrow(run, schema)


def base_failed() -> F.Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _distance(x: list[str]) -> F.Column:
    """Squared Mahalanobis distance of columns ``x`` by columns ``m`` (centre) and ``w`` (inverse scatter, row by row)."""
    d = [f"({c} - m[{k}])" for k, c in enumerate(x)]
    terms = [f"w[{i * P + j}] * {d[i]} * {d[j]}" + " * 2D" * (i != j) for i in range(P) for j in range(i + 1)]
    return F.expr(f"greatest({' + '.join(terms)}, 0D)")


_FLOORS = np.diag([f * f for *_, f in STATS.values()])
_PARAMS = "gid string, start int, m array<double>, c array<double>, w array<double>, logdet double, moved double"


def _row(gid, start, n, s, ss, m0, c0, shrink=1.0, old=np.inf):
    """Centre, scatter (without floors), inverse scatter and determinant of ``n`` rows with sums ``s`` and ``ss`` and of the prior's rows."""
    total = n + PRIOR
    m = (s + PRIOR * m0) / total
    c = (ss + PRIOR * (c0 / shrink + np.outer(m0, m0))) / total - np.outer(m, m)
    full = c + _FLOORS
    logdet = float(np.linalg.slogdet(full)[1])
    return {"gid": gid, "start": start, "m": list(m), "c": list(c.ravel()), "w": list(np.linalg.inv(full).ravel()), "logdet": logdet, "moved": abs(logdet - old)}


def _unpack(f: pd.DataFrame):
    s = np.stack([f[f"s{i}"].to_numpy() for i in range(P)], axis=1)
    ss = np.zeros((len(f), P, P))
    for i in range(P):
        for j in range(i + 1):
            ss[:, i, j] = ss[:, j, i] = f[f"q{i}_{j}"].to_numpy()
    return f["n"].to_numpy(float), s, ss


def _prior(f: pd.DataFrame, k: int = 0):
    return np.array(f["m0"].iloc[k], dtype=float), np.array(f["c0"].iloc[k], dtype=float).reshape(P, P)


def _moments(x):
    return [F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(F.col(x[i]) * F.col(x[j])).alias(f"q{i}_{j}") for i in range(P) for j in range(i + 1)]]


def _step(rows: DataFrame, params: DataFrame, prior: DataFrame, keep_half: bool) -> DataFrame:
    """One concentration step (the half with the smallest distances), or the reweighting step, for every group and start."""
    x = list(STATS)
    bin_ = F.when(F.col("d2") < 1e-6, -160).otherwise(F.floor(F.log2("d2") * _BINS)).cast("int").alias("bin")
    near = rows.join(params.select("gid", "start", "m", "w"), "gid").withColumn("d2", _distance(x)).select("gid", "start", bin_, *x)
    told = params.select("gid", "start", F.col("logdet").alias("old")).join(prior, "gid")
    summed = near.groupBy("gid", "start", "bin").agg(*_moments(x)).join(told, ["gid", "start"])

    def estimate(f, n, s, ss):
        bins, below = f["bin"].to_numpy(), np.cumsum(n)
        half = -(-(n.sum() + P + 1) // 2)
        at = int(np.searchsorted(below, half)) if keep_half else int(np.searchsorted(below, 0.5 * n.sum()))
        if not keep_half:  # distances are scaled so that their median is that of chi-squared, then the central rows are kept
            middle = 2.0 ** ((bins[at] + 0.5) / _BINS)
            middle = (n.sum() * middle + PRIOR * MIDDLE) / (n.sum() + PRIOR)
            edge = np.log2(KEEP * max(middle, 1e-6) / MIDDLE) * _BINS
            at = max(0, int(np.searchsorted(bins, edge)) - 1)
        k = min(at, len(n) - 1) + 1
        return _row(f["gid"].iloc[0], int(f["start"].iloc[0]), n[:k].sum(), s[:k].sum(axis=0), ss[:k].sum(axis=0), *_prior(f), HALF if keep_half else NEARLY_ALL, f["old"].iloc[0])

    def edges(f):
        return np.nonzero(((f["gid"] != f["gid"].shift()) | (f["start"] != f["start"].shift())).to_numpy())[0]

    def run(frames):
        """Groups come one after the other, each in the order of its bins; the last one of a batch may go on in the next."""
        rest = None
        for f in itertools.chain(frames, [None]):
            whole, rest = rest if f is None else f if rest is None else pd.concat([rest, f], ignore_index=True), None
            if whole is None or whole.empty:
                continue
            cut = edges(whole)
            if f is not None:
                rest, whole, cut = whole.iloc[cut[-1] :], whole.iloc[: cut[-1]], cut[:-1]
            if len(cut):
                n, s, ss = _unpack(whole)
                parts = [slice(i, j) for i, j in zip(cut, [*cut[1:], len(whole)])]
                yield pd.DataFrame([estimate(whole.iloc[p], n[p], s[p], ss[p]) for p in parts])

    # by an expression of its own, so that this shuffle stays: without it a skewed join might hand one group to several tasks
    return summed.repartition(F.xxhash64("gid", "start")).sortWithinPartitions("gid", "start", "bin").mapInPandas(run, _PARAMS)


def _quartiles(x: list[str]):
    return [F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(f"r{i}") for i, c in enumerate(x)]


def _spread(f: pd.DataFrame, k: int):
    r = np.array([f[f"r{i}"].iloc[k] for i in range(P)], dtype=float)
    return r[:, 1], np.diag(((r[:, 2] - r[:, 0]) / 1.349) ** 2)


def _starts(rows: DataFrame, prior: DataFrame, both_starts: bool) -> DataFrame:
    """Start 0: medians and quartile ranges. Start 1: mean and covariance of all rows."""
    x = list(STATS)
    both = rows.groupBy("gid").agg(*_moments(x), *_quartiles(x)).join(prior, "gid")

    def run(frames):
        for f in frames:
            n, s, ss = _unpack(f)
            out = []
            for k in range(len(f)):
                m, c = _spread(f, k)
                out.append(_row(f["gid"].iloc[k], 0, n[k], n[k] * m, n[k] * (c + np.outer(m, m)), *_prior(f, k)))
                if both_starts:
                    out.append(_row(f["gid"].iloc[k], 1, n[k], s[k], ss[k], *_prior(f, k)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _PARAMS.split(", ")])

    return both.mapInPandas(run, _PARAMS)


def statistics(counted: DataFrame, lang: str = "lang", source: str = "source", ids=()) -> DataFrame:
    """(ids, lid, gid, transformed statistics) of every counted row; lid names its language, gid its language and source."""
    key = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")).alias(n) for c, n in ((lang, "_lang"), (source, "_source"))]
    named = counted.select("*", *key).withColumns({"lid": F.to_json(F.struct("_lang")), "gid": F.to_json(F.struct("_lang", "_source"))})
    used = sorted({c for a, b, *_ in STATS.values() for c in (a, b)})
    sums = materialise(named.groupBy("lid", "gid").agg(*[F.sum(c).alias(f"t_{c}") for c in used]), "mcd-sums")
    of_lang = sums.groupBy("lid").agg(*[F.sum(f"t_{c}").alias(f"l_{c}") for c in used])
    whole = sums.agg(*[F.sum(f"t_{c}").alias(c) for c in used]).first()
    one = sums.join(of_lang, "lid")
    lean = lambda a, b, level, k, to: (F.col(f"{level}_{a}") + PRIOR * k * to) / (F.col(f"{level}_{b}") + PRIOR * k)
    pooled = []
    for name, (a, b, k, _) in STATS.items():
        top = F.lit((whole[a] or 0) / max(whole[b] or 0, 1))
        pooled.append(lean(a, b, "t", k, lean(a, b, "l", k, top)).alias(f"p_{name}"))
    rows = named.join(materialise(one.select("gid", *pooled), "mcd-pooled"), "gid")
    out = []
    for name, (a, b, k, _) in STATS.items():
        ratio = (F.col(a) + k * F.col(f"p_{name}")) / (F.col(b) + k)
        out.append((F.log(F.greatest(ratio, F.lit(0.01))) if name == "word_length" else F.asin(F.sqrt(F.least(ratio, F.lit(1.0))))).alias(name))
    return rows.select(*ids, "lid", "gid", *out)


def _settled(rows: DataFrame, params: DataFrame, prior: DataFrame) -> DataFrame:
    """``params`` after concentration steps until no determinant moves, ``MORE_STEPS`` at most."""
    for _ in range(MORE_STEPS):
        params = materialise(_step(rows, params, prior, True), "mcd-step")
        moved = params.agg(F.max("moved").alias("d")).first().d
        if moved is None or moved < STILL:
            break
    return params


def estimates(rows: DataFrame, prior: DataFrame, *, both_starts: bool = True) -> DataFrame:
    """(gid, m, c, w, scale) of each group: reweighted centre, scatter, inverse scatter, and the factor that brings its median squared distance to chi-squared's. ``prior``: (gid, m0, c0)."""
    params = materialise(_starts(rows, prior, both_starts), "mcd-start")
    for _ in range(STEPS):
        params = materialise(_step(rows, params, prior, True), "mcd-step")
    best = params
    if both_starts:
        best = params.groupBy("gid").agg(F.min_by(F.struct("start", "m", "c", "w", "logdet"), F.struct("logdet", "start")).alias("b")).select("gid", "b.*")
        best = _settled(rows, materialise(best, "mcd-best"), prior)
    best = materialise(_step(rows, best, prior, False), "mcd-reweighted")
    near = rows.join(best.select("gid", "m", "w"), "gid").groupBy("gid").agg(F.percentile_approx(_distance(list(STATS)), 0.5, 1000).alias("mid"), F.count("*").alias("n"))
    mid = (F.col("n") * F.col("mid") + PRIOR * MIDDLE) / (F.col("n") + PRIOR)
    scale = F.least(F.lit(1.0), MIDDLE / F.greatest(mid, F.lit(1e-6)))  # never makes a tight group stricter than its floors
    return materialise(best.join(near, "gid").select("gid", "m", "c", "w", scale.alias("scale")), "mcd-estimates")


def fitted(rows: DataFrame) -> DataFrame:
    """(gid, m, c, w, scale) of every language and source; ``rows`` (lid, gid, statistics), written."""
    x = list(STATS)
    whole = pd.DataFrame([r.asDict() for r in [rows.agg(*_quartiles(x)).first()] if r.r0 is not None])
    m, c = _spread(whole, 0) if len(whole) else (np.zeros(P), np.zeros((P, P)))
    langs = rows.select(F.col("lid").alias("gid"), *x)
    start = langs.select("gid").distinct().select("gid", F.array(*map(F.lit, m.tolist())).alias("m0"), F.array(*map(F.lit, c.ravel().tolist())).alias("c0"))
    of_lang = estimates(langs, materialise(start, "mcd-prior"), both_starts=False)
    told = of_lang.select(F.col("gid").alias("lid"), F.col("m").alias("m0"), F.transform("c", lambda v: v / F.col("scale")).alias("c0"))
    prior = rows.select("lid", "gid").distinct().join(told, "lid").select("gid", "m0", "c0")
    return estimates(rows.select("gid", *x), materialise(prior, "mcd-prior"))


def judged(counted: DataFrame, lang: str = "lang", source: str = "source", *, cutoff: float = CUTOFF) -> DataFrame:
    """``counted`` (written) with ``base_failed``, ``distance`` (squared) and ``kept``."""
    ids = [f"`{c}`" for c in counted.columns]
    rows = statistics(counted, lang, source, ids)
    fit = materialise(statistics(counted, lang, source), "mcd-rows")
    found = rows.join(fitted(fit).select("gid", "m", "w", "scale"), "gid").withColumn("distance", _distance(list(STATS)) * F.col("scale"))
    return found.select(*ids, base_failed().alias("base_failed"), "distance", (~base_failed() & (F.col("distance") <= cutoff)).alias("kept"))


def keep_good(docs: DataFrame, *, text_col: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` less the rows that the rules reject."""
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(docs.columns)])
    at = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    counted = materialise(counts(plain, at[text_col], keep_text=True), "mcd-docs")
    found = judged(counted, at[lang], at[source], cutoff=cutoff)
    return found.filter("kept").select(*[F.col(v).alias(c) for c, v in at.items()])


def op1_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = judged(materialise(counts(docs), "mcd-docs"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
