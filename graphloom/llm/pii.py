"""Personal data: patterns, and information-theoretic sanitisation (operator 7).

Patterns find the protected entities (email, ip, card, phone). A term within
``REACH`` words of an entity co-occurs with it. Over all documents, with N
documents, n_e that hold entity e, n_t that hold term t, and n_te in which they
co-occur, the term discloses the entity by

    PMI(t; e) / IC(e) = log2(N n_te / (n_t n_e)) / log2(N / n_e)

which is 1 if the term never occurs without the entity. A pair counts once it
stands in ``SUPPORT`` differing contexts, so copies of one text prove nothing.
In every document that holds e, each occurrence of a term that discloses e by
``GENERALISE`` or more becomes its class, by ``REMOVE`` or more it goes.

Candidate pairs come from one pass over the texts. A second pass counts the
candidate terms in all documents and notes where they occur beside their
entities; it knows the candidates by two bit tables, whose size follows the
number of pairs up to a bound, and exact joins drop what these let through
wrongly. Only spans are shuffled, not texts. The work on a text is linear in
its words and spans, but for a binary search.

Null and empty texts hold nothing. Rows that repeat get the same spans.
Overlapping spans are all reported, and are masked as one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import joined_spans, materialise, of_kind, small_batches, table

KINDS = ["email", "ip", "card", "phone", "term"]
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
REACH = 8
SUPPORT = 3
GENERALISE = 0.8
REMOVE = 0.95
#: Spans that an output batch of the scan holds, about.
MANY = 16_384
#: Bits of a table for each candidate pair, and bits of a table at least and at most (16 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 27

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_digit = re.compile(r"[0-9]")
_ip = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a run of digits fails or matches from its first
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_word = re.compile(r"[^ \t-\r]+")
_core = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every match of the patterns, in order."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _local:
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    if _digit.search(text):
        if "." in text:
            for m in _ip.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                    out.append((m.start(), 1, m.end()))
        for m in _card.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _phone.finditer(text):
                if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _entity(text: str, span: tuple[int, int, int]) -> str:
    start, kind, end = span
    value = text[start:end].lower()
    return f"{KINDS[kind]}:{re.sub('[^0-9]', '', value) if kind > 1 else value}"


def term_of(word: str) -> str | None:
    """A word without its outer punctuation, in lower case; None if under three characters are left."""
    m = _core.search(word)
    return m.group().lower() if m and len(m.group()) > 2 else None


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts).encode(), 42)


class Covered:
    """Tells whether a stretch of a text overlaps one of its spans."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts, self.ends = [], []
        for s, _, e in sorted(spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def __call__(self, a: int, b: int) -> bool:
        k = bisect_right(self.ends, a)
        return k < len(self.ends) and self.starts[k] < b


def _contexts(text: str, spans: list[tuple[int, int, int]]):
    """(entity, term, context) for the terms near each entity, each once; the context numbers the words around it."""
    words = [(m.start(), m.end()) for m in _word.finditer(text)]
    starts = [a for a, _ in words]
    covered, known = Covered(spans), {}

    def term(k: int) -> str | None:
        if k not in known:
            a, b = words[k]
            known[k] = None if covered(a, b) else term_of(text[a:b])
        return known[k]

    seen = set()
    for span in spans:
        first = bisect_right(starts, span[0]) - 1
        last = bisect_right(starts, span[2] - 1)
        terms = [t for k in (*range(max(0, first - REACH), max(0, first)), *range(last, min(last + REACH, len(words)))) if (t := term(k))]
        entity, context = _entity(text, span), _hash(*terms) >> 1
        if (entity, context) not in seen:
            seen.add((entity, context))
            for t in set(terms):
                yield entity, t, context


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_NEAR = T.ArrayType(T.StructType([T.StructField("entity", T.StringType()), T.StructField("term", T.StringType()), T.StructField("context", T.LongType())]))
_arrow_spans = [("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]
_arrow_near = [("entity", pa.string()), ("term", pa.string()), ("context", pa.int64())]


def _lists(rows: list[tuple], fields: list[tuple]) -> pa.ListArray:
    """A list of structs a row; a row holds a tuple of values for each field, or nothing."""
    flat = [pa.array([x for r in rows if r for x in r[k]], t) for k, (_, t) in enumerate(fields)]
    ends = np.cumsum([0, *(len(r[0]) if r else 0 for r in rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(flat, [n for n, _ in fields]))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, mark, spans, near) of every row: pattern spans, and terms beside entities. doc and the text's hash ``mark`` key a row."""
    small_batches(docs.sparkSession)
    schema = T.StructType([docs.select(F.col(id_col).alias("doc")).schema[0], T.StructField("mark", T.LongType()), T.StructField("spans", _SPANS), T.StructField("near", _NEAR)])

    def run(batches):
        for b in batches:
            spans, near, size, start = [], [], 0, 0
            for k in range(b.num_rows):  # a text with very many spans ends its batch
                text = b.column(2)[k].as_py() or ""
                found = base_spans(text)
                spans.append(tuple(zip(*found)))
                near.append(tuple(zip(*_contexts(text, found))) if found else ())
                size += len(found)
                if size > MANY or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(start, k + 1 - start) for c in (0, 1)), _lists(spans, _arrow_spans), _lists(near, _arrow_near)], names=schema.names)
                    spans, near, size, start = [], [], 0, k + 1

    return _keyed(docs, id_col, text_col).mapInArrow(run, schema)


def _table_bits(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, n * BITS_EACH - 1).bit_length()))


def _bit_table(rows: DataFrame, size: int, *cols: str) -> np.ndarray:
    """``size`` bits of the hashed values; size / 32768 rows of 4 KB reach the driver."""
    h = F.xxhash64(F.concat_ws("\x00", *cols))
    at = F.pmod(h, F.lit(size)) + 1
    parts = rows.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(size // 8, dtype=np.uint8)
    for r in parts:
        out[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return out


def _has(bits: np.ndarray, *parts: str) -> bool:
    at = _hash(*parts) % (8 * len(bits))
    return bool(bits[at >> 3] >> (at & 7) & 1)


def _recount(docs: DataFrame, id_col: str, text_col: str, terms: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """Second pass: (term, n) over batches, and occurrences (doc, mark, entity, term, start, end) beside candidate entities."""
    keyed = _keyed(docs, id_col, text_col)
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in keyed.schema.fields[:2]], *[T.StructField(n, t) for n, t in (("entity", T.StringType()), ("term", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("n", T.LongType()))]])
    tables = docs.sparkSession.sparkContext.broadcast((terms, pairs))  # 32 MB at most

    def run(batches):
        term_bits, pair_bits = tables.value
        known: dict[str, str | None] = {}

        def candidate(word: str) -> str | None:
            t = term_of(word)
            t = t if t and _has(term_bits, t) else None
            if len(known) < 300_000:
                known[word] = t
            return t

        for b in batches:
            n: Counter = Counter()
            rows = []
            for k, value in enumerate(b.column(2)):
                text = value.as_py() or ""
                raw = set(text.encode().split())
                here = {t for w in map(bytes.decode, raw) if (t := known[w] if w in known else candidate(w))}
                n.update(here)
                if not here or not (spans := base_spans(text)):
                    continue
                entities = sorted({_entity(text, s) for s in spans})
                wanted = {t: es for t in here if (es := [e for e in entities if _has(pair_bits, e, t)])}
                if wanted:
                    covered = Covered(spans)
                    for m in _word.finditer(text):
                        core = _core.search(m.group())
                        if core and core.group().lower() in wanted:
                            start, end = m.start() + core.start(), m.start() + core.end()
                            if not covered(start, end):
                                rows += [(k, e, core.group().lower(), start, end) for e in wanted[core.group().lower()]]
            at = pa.array([r[0] for r in rows] + [None] * len(n), pa.int32())
            pad = [None] * len(n)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array([r[1] for r in rows] + pad, pa.string()), pa.array([r[2] for r in rows] + list(n), pa.string()), pa.array([r[3] for r in rows] + pad, pa.int32()), pa.array([r[4] for r in rows] + pad, pa.int32()), pa.array([None] * len(rows) + list(n.values()), pa.int64())],
                names=schema.names,
            )

    return keyed.mapInArrow(run, schema)


def disclosed(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame | None:
    """(doc, mark, terms) of the rows in which terms disclose an entity: spans with their disclosure. None if no pair has the support."""
    near = scanned.select("doc", "mark", F.explode("near").alias("x")).select("doc", "mark", "x.*")
    contexts = near.groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
    pairs = materialise(contexts.groupBy("entity", "term").agg(F.count("*").alias("contexts")).filter(F.col("contexts") >= support), "pii-pairs")
    size = _table_bits(n := pairs.count())
    if not n:
        return None
    again = materialise(_recount(docs, id_col, text_col, _bit_table(pairs, size, "term"), _bit_table(pairs, size, "entity", "term")), "pii-recount")
    total = scanned.count()
    n_t = again.filter("n is not null").groupBy("term").agg(F.sum("n").alias("n_t"))
    one = near.select("doc", "mark", "entity", "term").distinct()  # a document counts once for a pair
    n_te = one.join(pairs, ["entity", "term"]).groupBy("entity", "term").agg(F.count("*").alias("n_te"))
    held = scanned.select("doc", "mark", F.explode(F.array_distinct(F.transform("near", lambda x: x["entity"]))).alias("entity"))
    n_e = held.groupBy("entity").agg(F.count("*").alias("n_e"))
    ratio = F.log2(total * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / F.log2(total / F.col("n_e"))
    telling = n_te.join(n_t, "term").join(n_e, "entity").filter(F.col("n_e") < total).select("entity", "term", F.least(ratio, F.lit(1.0)).alias("disclosure"))
    telling = materialise(telling.filter(F.col("disclosure") >= generalise), "pii-telling")
    spans = again.filter("n is null").join(telling, ["entity", "term"])
    spans = spans.groupBy("doc", "mark", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    return materialise(spans.groupBy("doc", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms")), "pii-terms")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(id, base spans, term spans) of every row."""
    scanned = materialise(scan(docs, id_col, text_col), "pii-scan")
    terms = disclosed(docs, scanned, id_col, text_col, support=support, generalise=generalise)
    empty = F.array().cast("array<struct<start:int,end:int,disclosure:double>>")
    if terms is None:
        return scanned.select(F.col("doc").alias(id_col), "spans", empty.alias("terms"))
    t = terms.select(F.col("doc").alias("_d"), F.col("mark").alias("_m"), "terms")
    joined = scanned.join(t, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m")), "left")
    return joined.select(F.col("doc").alias(id_col), "spans", F.coalesce("terms", empty).alias("terms"))


def masked(text: str, terms, remove: float = REMOVE) -> str:
    """The text with every span replaced; ``terms``: (start, end, disclosure)."""
    cuts = [(s, e, MASKS[KINDS[k]]) for s, k, e in base_spans(text)]
    for s, e, d in terms:
        cuts.append((s, e, "" if d >= remove else "[NUMBER]" if text[s:e].isdigit() else "[TERM]"))
    out, at = [], 0
    for s, e, mask in sorted(cuts):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length_col: str = "n_chars", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``docs`` with sanitised texts (null stays null); ``length_col``, where there is one, follows the text."""
    spark = docs.sparkSession
    small_batches(spark)
    scanned = materialise(scan(docs, id_col, text_col), "pii-scan")
    terms = disclosed(docs, scanned, id_col, text_col, support=support, generalise=generalise)
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(docs.columns)])
    at = {c: k for k, c in enumerate(docs.columns)}
    empty = F.array().cast("array<struct<start:int,end:int,disclosure:double>>")
    if terms is None:
        rows = plain.withColumn("_terms", empty)
    else:
        same = F.col(f"_c{at[id_col]}").eqNullSafe(F.col("_d")) & (F.xxhash64(f"_c{at[text_col]}") == F.col("_m"))
        rows = plain.join(terms.select(F.col("doc").alias("_d"), F.col("mark").alias("_m"), F.col("terms").alias("_terms")), same, "left").drop("_d", "_m")
    schema = plain.schema

    def run(batches):
        for b in batches:
            texts = [None if t is None else masked(t, [(x["start"], x["end"], x["disclosure"]) for x in m or ()], remove) for t, m in zip(b.column(at[text_col]).to_pylist(), b.column(len(at)).to_pylist())]
            cols = list(b.columns)[: len(at)]
            cols[at[text_col]] = pa.array(texts, cols[at[text_col]].type)
            if length_col in at:
                cols[at[length_col]] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(cols[at[length_col]].type)
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return rows.mapInArrow(run, schema).select(*[F.col(f"_c{k}").alias(c) for c, k in at.items()])


def op7_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = [of_kind("spans", k).alias(f"n_{KINDS[k]}") for k in range(4)]
    term = F.transform("terms", lambda x: F.struct(x["start"].alias("start"), F.lit(4).alias("kind"), x["end"].alias("end")))
    return found.select("doc_id", *n, F.sha2(joined_spans(F.col("spans"), KINDS), 256).alias("base_sha256"), joined_spans(F.concat("spans", term), KINDS).alias("spans"), F.size("terms").cast("long").alias("n_term"))
