"""Language identification by cross-parsing entropy (operator 10).

Each language's labelled text becomes a suffix automaton. A text is parsed
greedily against it: every phrase is the longest match that starts where the
last one ended, and a symbol that the language lacks is a phrase by itself. A
language that fits needs few phrases; the fewest phrases, normalised as
phrases * log2(training length) / text length, win.

Training: of each language, distinct texts in the order of their hash until
``chars`` characters are reached (all languages share ``total_chars``); the
bounds are parameters and each further row is left out of the fit only. The
parse covers whole texts and is exact: blocks of ``BLOCK`` symbols run side by
side as lanes of one vector, each as if a phrase began with it; then every block
is run again from the state in which the one before it ended, up to the symbol
at which both runs agree, which is mostly the end of the first phrase.

Letters are compared in lower case, and a run of other characters is one
separator. Every language has codes for all letters of its own training text;
a letter that it lacks ends a phrase, whatever other languages know. Languages
of few letters have dense transitions, those of over ``WIDE`` letters sparse
ones. A null text, or one without a letter, is ``und`` with score 0, as
is every text if nothing can be learned. Ties go to the smaller language name.
The score, h2 / (h1 + h2) of the two best, is 0.5 for a tie and 1 if only one
language was learned. A null id counts as the empty text in the hold-out rule.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import small_batches, table, without

CHARS = 49_152
TOTAL_CHARS = 1 << 20
DOCS = 400  # texts of a language that are considered at most
WIDE = 128  # letters from which a language has sparse transitions
BLOCK = 512
#: States that a run over blocks notes at most, about.
NOTED = 8_000_000
UNKNOWN = "und"

_SEPARATOR, _OTHER = 0, 1


def suffix_automaton(codes: list[int], size: int) -> np.ndarray:
    """Transitions [state, code] of the automaton of all substrings of ``codes``; -1 where there is none."""
    n = 2 * len(codes) + 2
    go = np.full((n, size), -1, dtype=np.int32)
    link, length = [-1] * n, [0] * n
    last, used = 0, 1
    for c in codes:
        new, used = used, used + 1
        length[new] = length[last] + 1
        p = last
        while p >= 0 and go[p, c] < 0:
            go[p, c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = int(go[p, c])
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin, used = used, used + 1
                length[twin] = length[p] + 1
                go[twin] = go[q]
                link[twin] = link[q]
                while p >= 0 and go[p, c] == q:
                    go[p, c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return go[:used]


def sparse_automaton(codes: list[int]) -> list[dict[int, int]]:
    """The same automaton with a dict of transitions for each state."""
    go: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return go


class Dense:
    """Automata of few letters in one table [state, letter]. A negative entry is the complement of a state that a new phrase leads to."""

    def __init__(self):
        self.at, self.roots, self.own, self.parts, self.size = [], [], [], [], 0

    def add(self, at: int, codes: np.ndarray, local: np.ndarray, known: int) -> None:
        width = known + 2  # columns: known symbols, one for all others, padding
        go, base = suffix_automaton(codes.tolist(), width), self.size
        fresh = np.where(go[0] >= 0, go[0] * width, 0) + base
        to = np.where(go >= 0, go * width + base, ~fresh)
        to[0] = ~fresh  # at the root a phrase begins with any symbol
        to[:, known + 1] = np.arange(len(go)) * width + base
        self.at.append(at)
        self.roots.append(base)
        self.own.append(local)
        self.parts.append(to.astype(np.int32).ravel())
        self.size += to.size

    def ready(self) -> None:
        self.table = np.concatenate(self.parts)
        self.parts = []
        self.local = np.array(self.own, dtype=np.int32)
        self.roots = np.array(self.roots, dtype=np.int32)

    def step(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """[language, lane] after one symbol a lane."""
        return self.table[state + self.local[:, symbols]]

    def step_at(self, which: np.ndarray, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        return self.table[state + self.local[which, symbols]]


class Sparse:
    """The automaton of a language of many letters, its transitions as sorted keys."""

    def __init__(self, at: int, codes: np.ndarray, local: np.ndarray, known: int):
        self.at, self.local, self.width, self.roots = [at], local, known + 2, np.zeros(1, dtype=np.int64)
        go = sparse_automaton(codes.tolist())
        edges = np.array(sorted((k * self.width + c, v) for k, d in enumerate(go) if k for c, v in d.items()) or [(-1, 0)], dtype=np.int64)
        self.keys, self.to = edges[:, 0].copy(), edges[:, 1].copy()
        self.fresh = np.array([go[0].get(c, 0) for c in range(self.width)], dtype=np.int64)

    def step(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        return self.step_at(None, state, symbols)

    def step_at(self, which, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        c = self.local[symbols]
        key = state * self.width + c
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(c == self.width - 1, state, np.where(self.keys[place] == key, self.to[place], ~self.fresh[c]))


def _state(raw: np.ndarray) -> np.ndarray:
    return raw ^ (raw >> (8 * raw.dtype.itemsize - 1))


def _parse(a, symbols: np.ndarray, follows: np.ndarray, before: np.ndarray | None):
    """Phrases [language, lane] that begin in each block, and the states after the last one.

    ``symbols`` [place, lane] holds a block a lane; a block that ``follows`` goes
    on in the state of the lane to its left, the first one in ``before``.
    """
    n = symbols.shape[1]
    roots = np.repeat(a.roots[:, None], n, axis=1)
    noted = np.empty((len(symbols), *roots.shape), dtype=roots.dtype)
    state = roots
    for t, c in enumerate(symbols):
        noted[t] = a.step(state, c)
        state = _state(noted[t])
    count = (noted < 0).sum(axis=0)
    begun = roots.copy()
    while True:
        last = _state(noted[-1])
        at = begun.copy()
        at[:, 1:] = np.where(follows[1:], last[:, :-1], roots[:, 1:])
        at[:, 0] = before if before is not None and follows[0] else a.roots
        which, lane = np.nonzero(at != begun)
        if not len(lane):
            return count, last[:, -1]
        state, begun = at[which, lane], at
        for t, c in enumerate(symbols):  # until the run from this state agrees with the one that was noted
            raw, old = a.step_at(which, state, c[lane]), noted[t, which, lane]
            count[which, lane] += (raw < 0).astype(np.int64) - (old < 0)
            noted[t, which, lane] = raw
            state = _state(raw)
            apart = state != _state(old)
            if not apart.all():
                which, lane, state = which[apart], lane[apart], state[apart]
                if not len(lane):
                    break


class Model:
    """Automata of all languages, ready for parsing."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        letters = sorted({c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha()})
        self.pad = 2 + len(letters)
        self.code = np.fromiter((_OTHER if chr(k).isalpha() else _SEPARATOR for k in range(0x110000)), dtype=np.min_scalar_type(self.pad), count=0x110000)
        for k, c in enumerate(letters):
            self.code[ord(c)] = 2 + k
        self.bits = np.zeros(len(self.names))
        dense, self.automata = Dense(), []
        for at, name in enumerate(self.names):
            codes = np.concatenate([np.append(self.encode(t), _SEPARATOR) for t in samples[name]]).astype(np.int64)
            self.bits[at] = np.log2(max(2, len(codes)))
            known = np.unique(codes)
            local = np.full(self.pad + 1, len(known), dtype=np.int32)
            local[known] = np.arange(len(known))
            local[self.pad] = len(known) + 1
            if len(known) > WIDE:
                self.automata.append(Sparse(at, local[codes], local, len(known)))
            else:
                dense.add(at, local[codes], local, len(known))
        if dense.at:
            dense.ready()
            self.automata.append(dense)

    def encode(self, text: str) -> np.ndarray:
        codes = self.code[np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)]
        keep = codes != _SEPARATOR
        keep[1:] |= codes[:-1] != _SEPARATOR
        return codes[keep]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """[text, language] phrases."""
        blocks = [-(-len(t) // BLOCK) for t in texts]
        out = np.zeros((len(texts), len(self.names)), dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), blocks)
        flat = np.full((len(owner), BLOCK), self.pad, dtype=self.code.dtype)
        at = 0
        for t, n in zip(texts, blocks):
            flat[at : at + n].reshape(-1)[: len(t)] = t
            at += n
        follows = np.zeros(len(owner), dtype=bool)
        follows[1:] = owner[1:] == owner[:-1]
        for a in self.automata:
            lanes, end = max(64, NOTED // (BLOCK * len(a.at))), None
            for k in range(0, len(owner), lanes):
                count, end = _parse(a, np.ascontiguousarray(flat[k : k + lanes].T), follows[k : k + lanes], end)
                for at, n in zip(a.at, count):
                    np.add.at(out[:, at], owner[k : k + lanes], n)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        codes = [self.encode(t or "") for t in texts]
        rows = [k for k, c in enumerate(codes) if (c != _SEPARATOR).any()]
        if not rows or not self.names:
            return out
        found = self.phrases([codes[k] for k in rows])
        for k, p in zip(rows, found):
            h = p * self.bits / len(codes[k])
            best = int(np.argmin(h))
            rest = np.delete(h, best)
            out[k] = (self.names[best], float(rest.min() / (rest.min() + h[best])) if len(rest) else 1.0)
        return out


def sample(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", *, chars: int = CHARS, total_chars: int = TOTAL_CHARS, docs: int = DOCS) -> dict[str, list[str]]:
    """The bounded training texts of each language; copies of a text count once."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    marks = rows.select("lang", F.xxhash64("text").alias("mark"), F.length("text").alias("n")).groupBy("lang", "mark").agg(F.max("n").alias("n"))
    n = max(1, marks.select("lang").distinct().count())
    share = max(1, min(chars, total_chars // n))
    order = Window.partitionBy("lang").orderBy("mark")
    first = marks
    for parts in (512, 64, 8, 1):  # a language may hold most rows, so its smallest marks are found in parts of parts
        some = Window.partitionBy("lang", F.pmod(F.col("mark"), F.lit(parts))).orderBy("mark")
        first = first.withColumn("k", F.row_number().over(some)).filter(F.col("k") <= docs)
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    chosen = first.withColumn("room", share - F.coalesce(before, F.lit(0))).filter("room > 0").select("lang", "mark", "room")
    texts = rows.withColumn("mark", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "mark"])  # at most `docs` rows a language
    texts = texts.groupBy("lang", "mark").agg(F.first(F.expr("substring(text, 1, cast(room as int))")).alias("text"))
    out: dict[str, list[str]] = {}
    for r in texts.orderBy("lang", "mark").collect():  # at most total_chars characters
        out.setdefault(r.lang, []).append(r.text)
    return out


_models: dict[str, Model] = {}


def identify(docs: DataFrame, samples: dict[str, list[str]], text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` less its text, with ``lang_pred`` and ``score``."""
    spark = docs.sparkSession
    small_batches(spark)
    source = without(docs, [c for c in ("lang_pred", "score") if c != text_col])
    schema = T.StructType([f for f in source.schema.fields if f.name != text_col] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = spark.sparkContext.broadcast(samples)
    fit = uuid.uuid4().hex  # workers build a model once

    def run(batches):
        if fit not in _models:
            _models.clear()
            _models[fit] = Model(shared.value)
        model = _models[fit]
        for b in batches:
            found = model.predict(b.column(b.schema.get_field_index(text_col)).to_pylist())
            cols = [b.column(i) for i, f in enumerate(b.schema) if f.name != text_col]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def op10_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = sample(docs.filter(~held_out()))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, samples)
