"""Alignment of extractions to the source text, and merging of several passes.

Alignment compares a whole list of extractions with all tokens of their text as
difflib's matching blocks do, and passes are merged in order, so both work on one
document at a time in Arrow batches.
"""

from __future__ import annotations

from bisect import bisect_left
from heapq import heapify, heappop, heappush
from math import ceil

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import places, words

#: Stands between the extractions of a text while they are matched.
DELIMITER = "␟"
THRESHOLD = 0.75
ALIGNED = "array<struct<ord:int,status:string,tok_start:int,tok_end:int,char_start:int,char_end:int>>"
_ALIGNED = pa.list_(pa.struct([("ord", pa.int32()), ("status", pa.string()), *((c, pa.int32()) for c in ("tok_start", "tok_end", "char_start", "char_end"))]))


def _light(tokens: list[str]) -> list[str]:
    """Tokens in lower case without the s of a plural."""
    return [t[:-1] if t[-1] == "s" and len(t) > 3 and t[-2] != "s" else t for t in tokens]


def _places(goal: list[str]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for j, t in enumerate(goal):
        out.setdefault(t, []).append(j)
    return out


def _blocks(source: list[str], lo: int, hi: int, places: dict[str, list[int]], first: int, end: int):
    """difflib's matching blocks (unsorted, without junk) of source[lo:hi] and the part first:end of the list that has its tokens at ``places``."""
    todo = [(lo, hi, first, end)]
    while todo:
        lo, hi, first, end = todo.pop()
        i = j = size = 0
        runs: dict[int, int] = {}
        for k in range(lo, hi):
            now = {}
            for at in places.get(source[k], ()):
                if at >= end:
                    break
                if at >= first:
                    n = now[at] = runs.get(at - 1, 0) + 1
                    if n > size:
                        i, j, size = k + 1 - n, at + 1 - n, n
            runs = now
        if size:
            yield i, j, size
            if lo < i and first < j:
                todo.append((lo, i, first, j))
            if i + size < hi and j + size < end:
                todo.append((i + size, hi, j + size, end))


def _shared(*part) -> int:
    return sum(b[2] for b in _blocks(*part))


def _in_order(tokens, masks: dict[str, int], skip: int, n: int) -> int:
    """Length of the longest common subsequence with the last n - skip wanted tokens; masks: the places of a token as bits."""
    full = (1 << n - skip) - 1
    v = full
    for t in tokens:
        u = v & (masks[t] >> skip)
        v = (v + u) | (v - u)
    return n - skip - (v & full).bit_count()


def _wide(source: list[str], inside: list[int], places: dict[str, list[int]], n: int, best: int):
    """Ranges of windows of over ``n`` tokens that may match more than ``best``: (width of the first, its start, the inside tokens that end the first and follow the last, the longest block of them all as size, its place in the source, among the wanted tokens and inside, the most that they match).

    From one start, the longest block changes only where a window's end first
    takes in a longer one; between these ends, what stands left of the block
    matches the same, and what stands right of it at most what is wanted there.
    """
    firsts: list[tuple[int, int, int]] = [(0, 0, 0)]  # by size: the first block from here on, at its first place among the wanted tokens
    runs: dict[int, int] = {}
    out = []
    for x in range(len(inside) - 1, -1, -1):
        a = inside[x]
        if x + 1 < len(inside) and inside[x + 1] > a + 1:
            runs = {}
        runs = {j: runs.get(j + 1, 0) + 1 for j in places[source[a]]}
        most = max(runs.values())
        firsts += [(0, 0, 0)] * (most + 1 - len(firsts))
        for j in reversed(runs):
            firsts[1 : runs[j] + 1] = [(a, j, x)] * runs[j]
        ends = len(inside)
        for size in range(len(firsts) - 1, 0, -1):
            i, j, at = firsts[size]
            most = size + min(j, at - x) + min(n - j - size, ends - at - size)
            if most > best:
                y = max(at + size - 1, bisect_left(inside, a + n))
                if y < ends:
                    out.append((inside[y] + 1 - a, a, y, ends, size, i, j, at, most))
            ends = min(ends, at + size - 1)  # the window that ends with this token is the first to hold the block
            if ends <= x or inside[ends - 1] < a + n:
                break
    return out


def _fuzzy(wanted: list[str], source: list[str], threshold: float) -> tuple[int, int] | None:
    """The window of the source, of as many tokens as are wanted at least, that holds the largest share of them as difflib matches them; the shortest and first on ties.

    A window over ``n`` tokens that begins or ends with a token which is not
    wanted matches no more than the one without it, which is shorter; so beyond
    ``n`` tokens only windows between wanted tokens count, and at ``n`` those
    that hold one. None matches more than the longest common subsequence.
    """
    n, need = len(wanted), max(1, ceil(len(wanted) * threshold))
    places = _places(wanted)
    inside = [k for k, t in enumerate(source) if t in places]
    if n > len(source) or len(inside) < need:
        return None
    masks = {t: sum(1 << j for j in at) for t, at in places.items()}
    most = _in_order((source[k] for k in inside), masks, 0, n)
    if most < need:
        return None
    best, where = need - 1, None
    known: dict[tuple, int] = {}  # repeated texts have few different windows
    a = 0
    for p in inside:
        for a in range(max(a, p - n + 1), min(p, len(source) - n) + 1):
            if bisect_left(inside, a + n) - bisect_left(inside, a) <= best:
                continue
            part = tuple(source[a : a + n])
            if part not in known:
                known[part] = _shared(part, 0, n, places, 0, n)
            if known[part] > best:
                best, where = known[part], (a, a + n)
                if best == most:
                    return where
        a = max(a, min(p, len(source) - n) + 1)
    heap = _wide(source, inside, places, n, best)
    heapify(heap)
    exact: set[tuple[int, int]] = set()
    while heap:
        width, a, y, ends, size, i, j, at, limit = heap[0]
        heappop(heap)
        if limit <= best:
            continue
        left = (tuple(source[a:i]), j)
        if left not in known:
            known[left] = _shared(left[0], 0, i - a, places, 0, j)
        rest = j + size
        if (a, size) not in exact:
            exact.add((a, size))
            right = (at + size, ends, rest)
            if right not in known:
                known[right] = _in_order((source[k] for k in inside[at + size : ends]), masks, rest, n)
            limit = size + known[left] + known[right]
            if limit <= best:
                continue
        right = (i + size, a + width, rest, n)
        if right not in known:
            known[right] = _shared(source, i + size, a + width, places, rest, n)
        found = size + known[left] + known[right]
        if found > best:
            best, where = found, (a, a + width)
            if best == most:
                break
        if limit > best and y + 1 < ends:
            heappush(heap, (inside[y + 1] + 1 - a, a, y + 1, ends, size, i, j, at, limit))
    return where


def align_texts(text: str, wanted: list[str], *, fuzzy: bool = True, threshold: float = THRESHOLD, accept_lesser: bool = True, toks: list[str] | None = None) -> list[tuple[str | None, int, int]]:
    """(status, first token, end token) of every extraction text; status None if it is not found. ``toks``: the text's tokens, if they are known."""
    source = [t.lower() for t in (words(text) if toks is None else toks)]
    goal, starts = [], {}
    lists = []
    for k, w in enumerate(wanted):
        if DELIMITER in w:
            raise ValueError("an extraction holds the delimiter")
        own = [t.lower() for t in words(w)]
        if goal:
            goal.append(DELIMITER)
        starts[len(goal)] = k
        lists.append(own)
        goal += own
    sizes = [len(own) for own in lists]
    if not any(sizes):
        raise ValueError("no extraction has a token")
    out: list[tuple[str | None, int, int]] = [(None, 0, 0)] * len(wanted)
    for i, j, n in _blocks(source, 0, len(source), _places(goal), 0, len(goal)):
        k = starts.get(j)
        if k is None or not sizes[k]:
            continue
        if n == sizes[k]:
            out[k] = ("match_exact", i, i + n)
        elif accept_lesser and n < sizes[k]:
            out[k] = ("match_lesser", i, i + n)
    if fuzzy and any(o[0] is None and n for o, n in zip(out, sizes)):
        plain = _light(source)
        for k, own in enumerate(lists):
            if out[k][0] is None and own:
                hit = _fuzzy(_light(own), plain, threshold)
                if hit:
                    out[k] = ("match_fuzzy", *hit)
    return out


def align(rows: DataFrame, text_col: str, wanted_col: str, *, tok_offset: str | None = None, char_offset: str | None = None, out_col: str = "aligned", **options) -> DataFrame:
    """Every row with ``aligned``, one entry an extraction text of ``wanted_col`` (array<string>), in order; positions are moved by the offsets of a chunk in its document."""

    @F.arrow_udf(ALIGNED)
    def run(text: pa.Array, wanted: pa.Array) -> pa.Array:
        out = []
        for t, w in zip(text.to_pylist(), wanted.to_pylist()):
            w = [x or "" for x in (w if w is not None else [])]
            at = places(t)
            toks = [t[a:b] for a, b in at]
            try:
                found = align_texts(t or "", w, toks=toks, **options) if w else []
            except ValueError:
                found = [(None, 0, 0)] * len(w)
            out.append([{"ord": k, "status": s, "tok_start": a if s else None, "tok_end": b if s else None, "char_start": at[a][0] if s else None, "char_end": at[b - 1][1] if s else None} for k, (s, a, b) in enumerate(found)])
        return pa.array(out, _ALIGNED)

    found = run.asNondeterministic()(F.col(text_col), F.col(wanted_col))  # or Spark runs it a second time for a filter of what is exploded
    tok, char = (F.col(c) if c else F.lit(0) for c in (tok_offset, char_offset))
    names = {"tok_start": tok, "tok_end": tok, "char_start": char, "char_end": char}
    moved = lambda x: F.struct(x["ord"].alias("ord"), x["status"].alias("status"), *[(x[c] + o).cast("int").alias(c) for c, o in names.items()])
    return rows.withColumn(out_col, F.transform(found, moved))


def merge_passes(rows: DataFrame, doc: str, order: list[str], start: str, end: str, pass_: str = "pass") -> DataFrame:
    """Rows of all passes less those of later passes that overlap a kept one; rows without a span stay.

    A document's extractions are few, and an item can be blocked by one that the
    same pass has kept before it, so the rule is applied in order, by document.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values([pass_, *order], kind="stable")
        first = f[pass_].min()
        kept: list[tuple[int, int]] = []
        keep = []
        for p, s, e in zip(f[pass_], f[start], f[end]):
            known = not (pd.isna(s) or pd.isna(e))
            free = p == first or not known or all(not (s < b and a < e) for a, b in kept)
            keep.append(free)
            if free and known:
                kept.append((s, e))
        return f[keep]

    return rows.groupBy(doc).applyInPandas(run, rows.schema)


def merge_two_passes(first: DataFrame, second: DataFrame, doc: str, start: str, end: str) -> DataFrame:
    """The same for two passes of which the second does not overlap itself: a range anti join."""
    a, b = second.alias("a"), first.select(F.col(doc).alias("_d"), F.col(start).alias("_s"), F.col(end).alias("_e")).alias("b")
    clash = (F.col(f"a.{doc}") == F.col("_d")) & (F.col(f"a.{start}") < F.col("_e")) & (F.col("_s") < F.col(f"a.{end}"))
    return first.unionByName(a.join(b, clash, "left_anti"))


def valid_spans(rows: DataFrame, start: str = "char_start", end: str = "char_end", strict: bool = False) -> DataFrame:
    keep = F.col(start).isNotNull() & F.col(end).isNotNull()
    return rows.filter(keep & (F.col(start) < F.col(end)) if strict else keep)


def boundary_events(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Start and end events of spans with ``place``, the order in which nested marks are written: by position, ends before starts, short ends first, long starts first."""
    from pyspark.sql import Window

    size = F.col(end) - F.col(start)
    ev = lambda pos, kind, rank, by: F.struct(F.col(pos).alias("pos"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), by.alias("by"))
    rows = valid_spans(rows, start, end, True).withColumn("_e", F.explode(F.array(ev(start, "start", 1, -size), ev(end, "end", 0, size))))
    rest = [c for c in rows.columns if c != "_e"]
    w = Window.partitionBy(*keys).orderBy("pos", "rank", "by", *[c for c in rest if c not in keys])
    return rows.select(*rest, "_e.*").withColumn("place", F.row_number().over(w)).drop("rank", "by")


def highlight(text: str, marks: list[tuple[int, int, str, str]]) -> str:
    """HTML of a text with (start, end, class, colour) marks, nested as their spans are."""
    import html

    events = []
    for k, (s, e, cls, colour) in enumerate(m for m in marks if m[0] < m[1]):
        events += [(s, 1, -(e - s), k, f'<mark style="background:{colour}" title="{html.escape(cls, quote=True)}">'), (e, 0, e - s, k, "</mark>")]
    out, at = [], 0
    for pos, _, _, _, tag in sorted(events):
        out += [html.escape(text[at:pos]), tag]
        at = pos
    return "".join([*out, html.escape(text[at:])])


def legend(colours: dict[str, str]) -> str:
    """HTML of the classes and their colours."""
    import html

    return " ".join(f'<mark style="background:{c}">{html.escape(k)}</mark>' for k, c in sorted(colours.items()))


#: Characters that are shown before and after an extraction; fixed value.
CONTEXT = 150


def shown(rows: DataFrame, text: str, start: str, end: str, context: int = CONTEXT) -> DataFrame:
    """``rows`` with ``before``, ``inside`` and ``after``: an extraction and the text around it."""
    lo = F.greatest(F.lit(0), F.col(start) - context)
    part = lambda a, b: F.substring(F.col(text), a + 1, F.greatest(b - a, F.lit(0)))
    return rows.withColumns({"before": part(lo, F.col(start)), "inside": part(F.col(start), F.col(end)), "after": part(F.col(end), F.col(end) + context)})


def pages(annotated: DataFrame, colours: dict[str, str]) -> DataFrame:
    """document_id, html of annotated documents (document_id, text, extractions): a legend, and the text with marks."""
    head = legend(colours)

    @F.pandas_udf("string")
    def page(text: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, xs in zip(text, found):
            placed = [x for x in (xs if xs is not None else []) if x["char_interval"] and not pd.isna(x["char_interval"]["start_pos"]) and not pd.isna(x["char_interval"]["end_pos"])]
            marks = [(int(x["char_interval"]["start_pos"]), int(x["char_interval"]["end_pos"]), x["extraction_class"], colours.get(x["extraction_class"], "#ffff8d")) for x in placed]
            body = highlight(t or "", marks)
            out.append(f'<div class="legend">{head}</div>\n<pre>{body}</pre>')
        return pd.Series(out)

    return annotated.select("document_id", page("text", "extractions").alias("html"))
