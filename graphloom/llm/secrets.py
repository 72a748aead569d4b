"""Secret scans (operator 2), with DataFrame functions only.

Patterns find assignments, access keys and hexadecimal strings. The battery
looks at every run of 20 or more characters of the usual encodings: it infers
the encoding (hexadecimal, base 32, letters, decimal, base 64) and asks

* whether the alphabet is used uniformly (chi-squared),
* whether values above and below the middle alternate as by chance (runs),
* whether neighbouring values are uncorrelated (lag-1 serial correlation).

Each test gives a p-value under the null that the string is random, and a Cauchy
combination makes one of the three. Benjamini-Hochberg control, separately for each
encoding and band of lengths (short strings carry little evidence, and there are
many of them), dismisses strings as not random; at most ``DISMISS`` of those
dismissed are expected to be random after all.

For those left, a second p-value is the chance that natural text of the encoding
and length holds so many rare letters (letters, base 32, base 64), changes
character class so often (hexadecimal; with rare letters in base 32 and base 64),
repeats letters so rarely (base 64), or has so few equal or neighbouring digits
in a row (decimal). Where several of these are asked, the least p-value counts
times their number. The same control over all candidates of the corpus, those
dismissed counted at p = 1, bounds the share of false discoveries at ``RATE``. A
discovery adds a span of kind ``random`` unless a pattern span covers it.

A candidate has ``LEAST_LENGTH`` characters, of which ``LEAST_CORE`` belong to
its alphabet; shorter strings have no battery.

Match positions come from ``split`` and ``regexp_extract_all``: the pieces
between matches and the matches themselves add up to code-point offsets. Null
and empty texts hold nothing. Repeated rows give the same spans, and count as
often as they occur in the control of false discoveries.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import joined_spans, materialise, of_kind, table

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the run's first AKIA is the longest match, so a length of 20 can be part of the pattern
HEX = r"[0-9a-f]{24,}"
LEAST_LENGTH, LEAST_CORE = 20, 16
TOKEN = rf"[A-Za-z0-9+/_=-]{{{LEAST_LENGTH},}}"
#: False-discovery rates: of strings reported, and of strings dismissed as not random.
RATE = 0.01
DISMISS = 0.005
#: Natural text: changes of character class a step, chance that two letters are equal, share of rare letters, share of steps to the same or a neighbouring digit.
CHANGES = 0.15
COINCIDENCE = 0.065
RARE, RARE_LETTERS = 0.15, "bfgjkpqvwxyz"
STEPS = 0.5
BANDS = (32, 64)
_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: encoding: (pattern of the whole string, alphabet)
ENCODINGS = {
    "decimal": (r"^[0-9]+$", _DIGIT),
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", _DIGIT + "abcdef"),
    "base32": (r"^[A-Z2-7]+$", _UPPER + "234567"),
    "letters": (r"^[A-Za-z]+$", _LOWER),
    "base64": (r"", _UPPER + _LOWER + _DIGIT + "+/"),
}
_GRID = 20  # steps of the p-value grid a power of ten


def _matches(text: Column, pattern: str, test=None, group: int = 0) -> Column:
    """(start, end, keep-test value) structs of all matches, leftmost first."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), whole.alias("m"), tested.alias("t"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,t:string>>").alias("out"))

    def add(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        one = F.struct(start.alias("start"), end.alias("end"), x["t"].alias("t"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["m"].isNull() | (~test(x["t"]) if test else F.lit(False)), acc["out"]).otherwise(F.array_append(acc["out"], one)).alias("out"))

    found = F.aggregate(parts, zero, add)["out"]
    return F.when(F.size(whole) > 0, found).otherwise(zero["out"])


def _normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution: a rational approximation, absolute error 1e-7, relative error about one per cent in the far tail."""
    x = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, upper).otherwise(1.0 - upper)


def _joint(ps: list[Column]) -> Column:
    """One p-value of several by the Cauchy combination, which holds if they depend on each other, as those of runs and serial correlation do."""
    t = sum((1.0 / F.tan(math.pi * F.least(F.greatest(p, F.lit(1e-30)), F.lit(0.99))) for p in ps), F.lit(0.0)) / len(ps)
    return F.atan2(F.lit(1.0), t) / math.pi


def _battery(s: Column) -> Column:
    """struct(encoding, chi, runs, lag, battery, p) of a candidate string: the deviates of the three tests, their joint p-value for random strings, and the p-value for natural text."""
    core = F.regexp_replace(F.regexp_replace(s, "=+$", ""), "[_-]", "")
    flat = F.when(core.rlike(ENCODINGS["hex"][0]) | core.rlike(ENCODINGS["letters"][0]) & ~core.rlike(ENCODINGS["base32"][0]), F.lower(core)).otherwise(core)
    encoding = F.lit("base64")
    for name in ("letters", "base32", "hex", "decimal"):
        encoding = F.when(core.rlike(ENCODINGS[name][0]), F.lit(name)).otherwise(encoding)
    alphabet = F.element_at(F.create_map(*[F.lit(x) for k, (_, a) in ENCODINGS.items() for x in (k, a)]), encoding)

    def tests(x):
        t, alpha = x["t"], x["alpha"]
        n, a = F.length(t).cast("double"), F.length(alpha).cast("double")
        squares = F.aggregate(F.sequence(F.lit(1), F.length(alpha)), F.lit(0.0), lambda acc, i: acc + F.pow(n - F.length(F.replace(t, F.substr(alpha, i, F.lit(1)), F.lit(""))), 2.0))
        chi = a / n * squares - n
        df = a - 1
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        codes = F.transform(F.split(t, ""), lambda c: (F.instr(alpha, c) - 1).cast("double"))
        high = F.array_join(F.transform(codes, lambda c: F.when(2 * c >= a, "h").otherwise("l")), "")
        n1 = n - F.length(F.replace(high, F.lit("h"), F.lit("")))
        n2 = n - n1
        runs = F.size(F.regexp_extract_all(high, F.lit("h+|l+"), F.lit(0)))
        mean = 1 + 2 * n1 * n2 / n
        spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
        z_runs = (runs - mean) / spread
        total = F.aggregate(codes, F.lit(0.0), lambda acc, c: acc + c)
        power = F.aggregate(codes, F.lit(0.0), lambda acc, c: acc + c * c)
        lag = F.aggregate(F.zip_with(codes, F.slice(codes, 2, F.length(t)), lambda c, d: c * F.coalesce(d, codes[0])), F.lit(0.0), lambda acc, c: acc + c)  # the last value is followed by the first
        z_lag = ((n * lag - total * total) / F.greatest(n * power - total * total, F.lit(1e-9)) + 1 / (n - 1)) * F.sqrt(n)
        two_sided = lambda z: F.least(F.lit(1.0), 2 * _normal_tail(F.abs(z)))
        battery = _joint([_normal_tail(z_chi), two_sided(z_runs), two_sided(z_lag)])
        changes = F.size(F.regexp_extract_all(x["core"], F.lit("(?<=[a-z])(?=[A-Z])|(?<=[0-9])(?=[A-Za-z+/])|(?<=[A-Za-z+/])(?=[0-9])"), F.lit(0)))
        z_changes = (changes - 0.5 - (n - 1) * CHANGES) / F.sqrt((n - 1) * CHANGES * (1 - CHANGES))
        equal = (squares - n) / (n * (n - 1))
        z_equal = (COINCIDENCE - equal) / (1.5 * F.sqrt(2 * COINCIDENCE * (1 - COINCIDENCE) / (n * (n - 1))))
        letters = F.length(F.regexp_replace(x["core"], "[^A-Za-z]", ""))
        rare = F.length(F.regexp_replace(x["core"], f"[^{RARE_LETTERS}{RARE_LETTERS.upper()}]", ""))
        z_rare = (rare - 0.5 - letters * RARE) / F.sqrt(F.greatest(letters, F.lit(1)) * RARE * (1 - RARE))
        near = F.aggregate(F.zip_with(codes, F.slice(codes, 2, F.length(t)), lambda c, d: (F.abs(c - d) <= 1).cast("int")), F.lit(0), lambda acc, c: acc + F.coalesce(c, F.lit(0)))
        z_steps = ((n - 1) * STEPS - near - 0.5) / F.sqrt((n - 1) * STEPS * (1 - STEPS))
        both = (z_changes + z_rare) / 2**0.5
        asked = {"letters": [z_rare], "decimal": [z_steps], "hex": [z_changes], "base32": [z_rare, both]}
        tail = lambda zs: F.least(len(zs) * _normal_tail(F.least(F.greatest(*zs) if len(zs) > 1 else zs[0], F.lit(15.0))), F.lit(1.0))
        p = tail([z_rare, both, (z_changes + z_equal) / 2**0.5])
        for name, zs in asked.items():
            p = F.when(x["encoding"] == name, tail(zs)).otherwise(p)
        return F.struct(x["encoding"].alias("encoding"), z_chi.alias("chi"), z_runs.alias("runs"), z_lag.alias("lag"), battery.alias("battery"), p.alias("p"))

    one = F.array(F.struct(flat.alias("t"), core.alias("core"), alphabet.alias("alpha"), encoding.alias("encoding")))
    fit = F.length(core) >= LEAST_CORE  # a string of little but separators has no battery
    return F.when(fit, F.transform(one, tests)[0])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans, candidates) of every row: pattern spans (start, kind, end), and strings with their encoding, deviates and p-values."""
    t = F.col("_text")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def kind(k, found):
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))

    assign = F.when(t.rlike("[:=]") & t.rlike(ASSIGN), kind(0, _matches(t, ASSIGN, lambda g: F.length(g) >= 6, 2))).otherwise(none)
    access = F.when(F.contains(t, F.lit("AKIA")), kind(1, _matches(t, ACCESS))).otherwise(none)
    hexes = F.when(t.rlike(HEX), kind(2, _matches(t, HEX))).otherwise(none)
    empty = F.array().cast("array<struct<start:int,end:int,t:string>>")
    tokens = F.when(t.rlike(TOKEN), _matches(t, TOKEN)).otherwise(empty)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select("id", F.array_sort(F.concat(assign, access, hexes)).alias("spans"), tokens.alias("tokens"))
    judged = F.transform("tokens", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _battery(x["t"]).alias("b")))
    return rows.select("id", "spans", F.filter(judged, lambda x: x["b"].isNotNull()).alias("candidates"))


def _band(n: Column) -> Column:
    out = F.lit(len(BANDS))
    for k, edge in reversed(list(enumerate(BANDS))):
        out = F.when(n < edge, k).otherwise(out)
    return out


def _step(p: Column) -> Column:
    return F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * _GRID).cast("int")


_NEVER = 31 * _GRID
_NAMES = list(ENCODINGS)


def _class(encoding: Column, n: Column) -> Column:
    """Number of a string's encoding and band of lengths."""
    return (F.array_position(F.array(*map(F.lit, _NAMES)), encoding).cast("int") - 1) * (len(BANDS) + 1) + _band(n)


def controlled(counts: dict[int, int], total: int, rate: float) -> int:
    """Benjamini-Hochberg on a grid: the smallest step from which p-values are rejected; counts: strings at each step."""
    found, best = 0, _NEVER
    for step in sorted(counts, reverse=True):
        found += counts[step]
        if found and 10 ** (-step / _GRID) * total / found <= rate:
            best = step
    return best


def thresholds(scanned: DataFrame, rate: float = RATE, dismiss: float = DISMISS) -> tuple[list[int], list[int]]:
    """For each class of strings the grid steps from which the battery dismisses a string, and from which the rest are discoveries."""
    all_ = scanned.select(F.explode("candidates").alias("c")).select(_class(F.col("c.b.encoding"), F.col("c.end") - F.col("c.start")).alias("k"), _step(F.col("c.b.battery")).alias("battery"), _step(F.col("c.b.p")).alias("step"))
    counted = all_.groupBy("k", "battery", "step").agg(F.count("*").alias("n")).collect()  # a row a class and pair of grid steps
    out, bar = [_NEVER] * len(_NAMES) * (len(BANDS) + 1), [_NEVER] * len(_NAMES) * (len(BANDS) + 1)
    for k in range(len(out)):
        rows = [r for r in counted if r.k == k]
        total, tested, left = sum(r.n for r in rows), Counter(), Counter()
        for r in rows:
            tested[r.battery] += r.n
        out[k] = controlled(tested, total, dismiss)
        for r in rows:
            left[r.step if r.battery < out[k] else 0] += r.n
        bar[k] = controlled(left, total, rate)
    return out, bar


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rate: float = RATE, dismiss: float = DISMISS) -> DataFrame:
    """(id, spans, added) of every row: pattern spans and discoveries, as (start, kind, end)."""
    scanned = materialise(scan(docs, id_col, text_col), "secrets")
    out, bar = (F.array(*map(F.lit, x)) for x in thresholds(scanned, rate, dismiss))
    kind = lambda x: _class(x["b"]["encoding"], x["end"] - x["start"])
    good = F.filter("candidates", lambda x: (_step(x["b"]["battery"]) < out[kind(x)]) & (_step(x["b"]["p"]) >= bar[kind(x)]) & ~F.exists("spans", lambda s: (s["start"] <= x["start"]) & (s["end"] >= x["end"])))
    added = F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    return scanned.select(F.col("id").alias(id_col), "spans", added.alias("added"))


def op2_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    n = [of_kind("spans", k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *n, F.sha2(joined_spans(F.col("spans"), KINDS), 256).alias("base_sha256"), joined_spans(F.concat("spans", "added"), KINDS).alias("spans"), F.size("added").cast("long").alias("n_random"))
