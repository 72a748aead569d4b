"""Operators on small inputs with known answers."""

import json
import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from graphloom import schemas as S
from graphloom.functions import similarity, text
from graphloom.operators import align, catalog, chunks, client, cluster, extract, graph, merge
from graphloom.plans import extraction
from graphloom.sources import readers, store
from graphloom.streaming import ingest


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_spans_and_sentences():
    t = "Dr. Who came. He left\nThen A/B 12!"
    toks = chunks.spans(t)
    assert [x[2] for x in toks] == ["Dr", ".", "Who", "came", ".", "He", "left", "Then", "A/B", "12", "!"]
    assert [x[1] for x in toks][-4:] == ["WORD", "ACRONYM", "NUMBER", "PUNCTUATION"]
    assert [x[5] for x in toks].index(True) == 7
    assert all(t[a:b] == w for _, _, w, a, b, _ in toks)
    assert chunks.sentence_ends(t, toks) == [5, 7, 11]
    assert chunks.spans("") == [] and chunks.sentence_chunks_of("", 10) == [] and chunks.sentence_chunks_of(None, 10) == []


def test_sentence_chunks_cover_all_tokens_within_the_limit():
    rng = random.Random(3)
    for _ in range(200):
        t = "".join(rng.choice(["word", " ", "\n", ". ", "Longword", "x", "? ", "A/B", "，"]) for _ in range(rng.randint(0, 60)))
        toks, most = chunks.spans(t), rng.randint(3, 40)
        got = chunks.sentence_chunks_of(t, most)
        assert [k for a, b in got for k in range(a, b)] == list(range(len(toks)))
        assert all(b == a + 1 or toks[b - 1][4] - toks[a][3] <= most for a, b in got)


def test_chunk_examples():
    cut = lambda t, n: [t[chunks.spans(t)[a][3] : chunks.spans(t)[b - 1][4]] for a, b in chunks.sentence_chunks_of(t, n)]
    report = "Rain fell over the low fields\nand the river rose\nby a hand every hour.\nBoats were tied up."
    assert cut(report, 52) == ["Rain fell over the low fields\nand the river rose", "by a hand every hour.", "Boats were tied up."]  # a long sentence parts at a line, its rest stands alone
    assert cut("We met Rindfleischetikettierung there.", 16) == ["We met", "Rindfleischetikettierung", "there."]  # a token over the limit is a chunk
    assert cut("One bell. Two bells. Three bells. Four.", 21) == ["One bell. Two bells.", "Three bells. Four."]
    assert cut("Mr. Orr left. Ann stayed.", 14) == ["Mr. Orr left.", "Ann stayed."]


def slow_chunks(text, most):
    """The chunks by their rule, each found anew from the list of sentences: (first, end) tokens."""
    toks = chunks.spans(text)
    sentences, a = [], 0
    for e in chunks.sentence_ends(text, toks):
        sentences.append((a, e))
        a = e
    size = lambda a, b: toks[b - 1][4] - toks[a][3]
    out, rest, left = [], None, list(sentences)
    while left or rest:
        a, e = rest or left.pop(0)
        alone, rest = rest is not None, None
        if size(a, a + 1) > most:
            out.append((a, a + 1))
            rest = (a + 1, e) if a + 1 < e else None
        elif size(a, e) > most:
            fits = max(k for k in range(a + 1, e + 1) if size(a, k) <= most)
            lines = [k for k in range(a + 1, fits + 1) if toks[k][5]]  # the token that breaks the limit may begin the line
            stop = lines[-1] if lines else fits
            out.append((a, stop))
            rest = (stop, e)
        else:
            while not alone and left and size(a, left[0][1]) <= most:
                e = left.pop(0)[1]
            out.append((a, e))
    return out


def test_sentence_chunks_equal_the_slow_rule():
    rng = random.Random(7)
    for _ in range(600):
        t = "".join(rng.choice(["word", " ", " ", "\n", ". ", "Longword", "x", "? ", "A/B", "，", "Dr", "\nThe "]) for _ in range(rng.randint(0, 50)))
        most = rng.randint(2, 45)
        assert chunks.sentence_chunks_of(t, most) == slow_chunks(t, most), (t, most)


def test_paragraph_chunks(spark):
    a, b, c = "a" * 30, "b" * 30, "c" * 5
    texts = {"": [], "one": ["one"], f"{a}\n\n{b}\n\n{c}": [a, "a" * 8 + "\n\n\n\n" + b, "b" * 8 + "\n\n\n\n" + c], "\n\n\n\n \n": [], "é" * 99: ["é" * 99]}
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", chunks.paragraph_chunks(F.col("t"), 40, 10).alias("c"))
    assert [r.c for r in df.orderBy("k").collect()] == list(texts.values())


def test_names(spark):
    df = spark.createDataFrame([("a  b-c",), ("9x",), ("***",), ("",), (None,), ("中 文（x）",)], "n string")
    got = rows(df.select(text.property_name(F.col("n")), text.match_name(F.col("n")), text.relation_name(F.col("n"))))
    assert got == [("a_b_c", "a_b_c", "a__b_c"), ("prop_9x", "_9x", "9x"), ("property", "", "___"), ("", "", ""), (None, None, None), ("中_文_x", "中_文（x）", "中_文_x_")]
    df = spark.createDataFrame([("cats",), ("Glass",), ("is",)], "t string")
    assert [r[0] for r in df.select(text.stem(F.col("t"))).collect()] == ["cat", "glass", "is"]


def test_parse_and_faults(spark):
    good = '{"extractions":[{"公司":"甲","公司_attributes":{"行业":"制造"}},{"关系":"","关系_attributes":{"主体":"甲","谓词":"位于","客体":"乙"}},{"城市":"乙","城市_attributes":null}]}'
    df = spark.createDataFrame([(0, good), (1, None), (2, "x"), (3, "[1]"), (4, "{}"), (5, '{"extractions": {}}'), (6, '{"extractions": [2]}'), (7, '{"extractions": [{"a": 1, "a_attributes": "b"}]}')], "k int, a string")
    assert [r.f for r in df.orderBy("k").select(extract.fault(F.col("a")).alias("f")).collect()] == [None, "not json", "not json", "not an object", "no extractions", "extractions is not a list", "an extraction is not an object", "attributes are not an object"]
    items = extract.unnest(df.filter("k = 0"), "a", ["k"])
    assert rows(items.select("extraction_index", "group_index", "class", "text"), "extraction_index") == [(1, 0, "公司", "甲"), (2, 1, "关系", ""), (3, 2, "城市", "乙")]
    assert rows(extract.relations(items, ["k"]).select("source", "type", "target")) == [("甲", "位于", "乙")]
    nodes, edges = extraction.graph_of(df.select(F.col("k").alias("doc"), F.lit(0).alias("chunk"), F.col("a").alias("answer")))
    assert {r.node_id for r in nodes.collect()} == {"公司_甲", "城市_乙"}
    assert rows(edges.select("source_id", "relation_type", "target_id")) == [("公司_甲", "位于", "城市_乙")]


def test_models_and_retries(spark):
    calls = {"n": 0}

    def moody(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "prompt string").coalesce(1)
    got = {r.prompt: (r.answer, r.error) for r in extract.infer(df, moody, retries=1).collect()}
    assert got == {"a": ("A", None), "bad": (None, "no"), "c": ("C", None)} and calls["n"] == 0
    docs = spark.createDataFrame([(1, "Ada met Bob. Carl slept."), (2, " \n "), (3, None)], "doc_id int, text string")
    nodes, edges = extraction.graph_of(extraction.answers(docs, extract.RuleModel(), "Find names."))
    assert {r.node_name for r in nodes.collect()} == {"Ada", "Bob", "Carl"}
    assert rows(edges.select("source_id", "target_id")) == [("Name_Ada", "Name_Bob")]
    bad = extraction.graph_of(extraction.answers(docs, extract.FaultyModel(), "x"))
    assert bad[0].count() == bad[1].count() == 0


def test_prompt(spark):
    shots = [{"text": "T", "extractions": [{"class": "c", "text": "é", "attributes": {"k": "v"}}]}, {"text": "", "extractions": []}]
    p = spark.range(1).select(extract.prompt(F.lit("Q?"), "Do it.", shots, F.lit("ctx"))).first()[0]
    assert p.startswith("Do it.\n\nctx\n\nExamples\nQ: T\nA: {") and p.endswith("Q: Q?\nA: ") and "\\u00e9" in p
    assert json.loads(extract.example_answer(shots[0]["extractions"]))["extractions"][0]["c"] == "é"
    assert extract.example_answer(shots[0]["extractions"], fence=True).startswith("```json\n")


def test_alignment():
    t = "Patient takes aspirin daily. Blood tests were normal."
    got = align.align_texts(t, ["aspirin daily", "blood test", "missing thing", "patients took aspirin daily"])
    assert got[0] == ("match_exact", 2, 4)
    assert got[1] == ("match_lesser", 5, 6) and got[2][0] is None and got[3] == ("match_fuzzy", 0, 4)
    assert align.align_texts(t, ["blood test"], accept_lesser=False) == [("match_fuzzy", 5, 7)]
    with pytest.raises(ValueError):
        align.align_texts(t, [" "])
    with pytest.raises(ValueError):
        align.align_texts(t, ["a ␟ b"])


def slow_alignment(text, wanted, accept_lesser=True):
    """difflib over all tokens, and every window of every width."""
    source = [x[2].lower() for x in chunks.spans(text)]
    lists = [[x[2].lower() for x in chunks.spans(w)] for w in wanted]
    goal, starts = [], {}
    for k, own in enumerate(lists):
        goal += ["␟"] * bool(goal)
        starts[len(goal)] = k
        goal += own
    out = [(None, 0, 0)] * len(wanted)
    for i, j, n in SequenceMatcher(None, source, goal, autojunk=False).get_matching_blocks():
        k = starts.get(j)
        if n and k is not None and lists[k] and (n == len(lists[k]) or (accept_lesser and n < len(lists[k]))):
            out[k] = ("match_exact" if n == len(lists[k]) else "match_lesser", i, i + n)
    light = lambda x: x[:-1] if len(x) > 3 and x.endswith("s") and not x.endswith("ss") else x
    plain = [light(x) for x in source]
    for k, own in enumerate(lists):
        own, best = [light(x) for x in own], (0.0, None)
        if out[k][0] is None and own:
            for width in range(len(own), len(plain) + 1):
                for a in range(len(plain) - width + 1):
                    part = plain[a : a + width]
                    if sum(min(own.count(x), part.count(x)) for x in set(own)) >= int(len(own) * 0.75):
                        share = sum(m.size for m in SequenceMatcher(None, part, own, autojunk=False).get_matching_blocks()) / len(own)
                        best = (share, (a, a + width)) if share > best[0] else best
            if best[0] >= 0.75:
                out[k] = ("match_fuzzy", *best[1])
    return out


def test_alignment_equals_the_slow_rule():
    rng = random.Random(13)
    vocabulary = ["tests", "test", "glass", "a", "b", "c", "dogs", "dog", "A/B", "1"]
    seen = set()
    for k in range(400):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 22)))
        wanted = [" ".join(rng.choice([*vocabulary, "absent"]) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 4))]
        if not any(w.strip() for w in wanted):
            continue
        got = align.align_texts(text, wanted, accept_lesser=k % 2 == 0)
        assert got == slow_alignment(text, wanted, k % 2 == 0), (text, wanted)
        seen |= {s for s, _, _ in got}
    assert seen == {None, "match_exact", "match_lesser", "match_fuzzy"}


def test_alignment_of_repeated_texts():
    """Against the slow rule where texts and phrases repeat, so that windows beyond the phrase's length win; and in time on a chunk of one repeated word and on a run of letters and digits."""
    rng = random.Random(14)
    wide = 0
    for k in range(150):
        unit = [rng.choice("abcd") for _ in range(rng.randint(1, 4))]
        toks, want = unit * rng.randint(1, 5), unit * rng.randint(1, 3)
        for x in (toks, want, want):
            x[rng.randrange(len(x))] = rng.choice(["x", "y", "a"])
        got = align.align_texts(" ".join(toks), [" ".join(want), "a absent"])
        assert got == slow_alignment(" ".join(toks), [" ".join(want), "a absent"]), (toks, want)
        wide += sum(s == "match_fuzzy" and b - a > n for (s, a, b), n in zip(got, (len(want), 2)))
    assert wide
    began = time.process_time()
    assert align.align_texts("Èrépa " * 166, ["Èrépas Èrépa Èrépa Èrépa", "absent phrase"]) == [("match_fuzzy", 1, 17), (None, 0, 0)]
    assert len(chunks.spans("a1" * 100_000)) == 200_000
    assert time.process_time() - began < 5  # 70 s and more before


def test_passes(spark):
    data = [("d", 0, 0, 0, 5), ("d", 0, 1, 3, 8), ("d", 1, 0, 4, 6), ("d", 1, 1, 8, 9), ("d", 1, 2, 8, 12), ("d", 1, 3, None, None)]
    df = spark.createDataFrame(data, "doc string, pass int, ord int, s int, e int")
    got = rows(align.merge_passes(df, "doc", ["ord"], "s", "e").select("pass", "ord"), "pass", "ord")
    assert got == [(0, 0), (0, 1), (1, 1), (1, 3)]


def test_annotate(spark):
    docs = spark.createDataFrame([(1, "Ada met Bob.\nCarl slept well."), (2, "nothing here")], "doc_id int, text string")
    got = {r.document_id: r for r in extraction.annotate(docs, extract.RuleModel(), "Find names.", most=20, passes=2).collect()}
    named = [(x.extraction_text, x.char_interval and (x.char_interval.start_pos, x.char_interval.end_pos)) for x in got["1"].extractions if x.extraction_class == "Name"]
    assert named == [("Ada", (0, 3)), ("Bob", (8, 11)), ("Carl", (13, 17))]
    assert got["2"].extractions == []


def test_folds(spark):
    data = [("n", "t", {"a": "1", "b": None}, 1, "d1"), ("n", "t", {"a": "2", "c": "3"}, 2, ""), ("n", "t", None, 3, None)]
    df = spark.createDataFrame(data, "name string, type string, props map<string,string>, ord int, description string")
    assert merge.merge_entities(df).first().props == {"a": "1", "b": None, "c": "3"}
    n = merge.build_nodes(df).first()
    assert n.props == {"a": "2", "c": "3"} and n.description == "d1" and n.node_id == "t_n"


def test_similarity_and_clusters(spark):
    assert similarity.ratio("tide", "diet") == 0.25 and similarity.ratio("diet", "tide") == 0.5
    assert similarity.name_similarity("ab", "abcd") == pytest.approx(2 * 2 / 6 + 0.2)
    ents = [("公司", "甲乙丙公司", {"地区": "北"}, 1), ("公司", "甲乙丙有限公司", {"地区": "北"}, 2), ("公司", "甲乙丙公司", {"地区": "南"}, 3), ("公司", "丁", {}, 4)]
    df = spark.createDataFrame(ents, "type string, name string, props map<string,string>, ord long")
    assert rows(cluster.clusters(df).select("ord", "cluster"), "ord") == [(1, 1), (2, 1), (3, 3), (4, 4)]
    f = {r.cluster: r for r in cluster.fuse(cluster.clusters(df)).collect()}
    assert f[1]["name"] == "甲乙丙有限公司" and f[1].source_count == 2


def test_best_match_equals_all_pairs(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(120)]
    targets = [n[:-1] + "x" if k % 2 else n for k, n in enumerate(names[:40])]
    got = {r.target: r["name"] for r in cluster.best_match(spark.createDataFrame([(t,) for t in targets], "target string"), spark.createDataFrame(list(zip(names, range(120))), "name string, ord int"), 0.8).collect()}
    for t in set(targets):
        best = max(range(120), key=lambda k: (SequenceMatcher(None, t, names[k]).ratio(), -k))
        ok = SequenceMatcher(None, t, names[best]).ratio() >= 0.8
        assert got.get(t) == (names[best] if ok else None)


def _node(spark, *data):
    return spark.createDataFrame([(t, i, i.upper(), "x", d, p, f, [], o) for t, i, d, p, f, o in data], S.NODE + ", ord int")


def test_upserts(spark):
    old = _node(spark, ("g", "a", "old", {"k": "1"}, ["f1"], 0)).drop("ord")
    new = _node(spark, ("g", "a", "new", {"k": "2", "m": "3"}, ["f1", "f2"], 1), ("g", "b", "b1", {}, ["f2"], 2), ("g", "b", "b2", {}, ["f3"], 3))
    c = {r.node_id: r for r in graph.upsert_nodes(old, new).collect()}
    assert c["a"].description == "old" and c["a"].props == {"k": "1"} and c["b"].description == "b1"
    o = {r.node_id: r for r in graph.upsert_nodes(old, new, "overwrite").collect()}
    assert o["a"].description == "new" and o["a"].props == {"k": "2", "m": "3"} and o["a"].filename == ["f1", "f2"] and o["b"].filename == ["f2", "f3"]
    with pytest.raises(ValueError):
        graph.check_level("Other", None)
    with pytest.raises(ValueError):
        graph.check_level("DocumentLevel", None)


def test_catalog(spark):
    g = catalog.new_graph(spark.createDataFrame([(1, "n", None), (2, "m", "d")], "id long, name string, description string"))
    assert g.first().status == 0 and g.first().graph_name == "kg_1"
    assert [r.description for r in catalog.public(g).orderBy("id").collect()] == ["", "d"]
    assert catalog.soft_delete(g, F.col("id") == 1).filter("del_flag = 1").count() == 1
    assert catalog.find(g, id=3).count() == 0
    t, f = catalog.new_tasks(spark.createDataFrame([(7, 1, "t"), (8, 1, "u")], "id long, kg_id long, name string"), spark.createDataFrame([(1, 7, "p"), (2, 8, None)], "id long, task_id long, path string"))
    assert [r.id for r in t.collect()] == [7] and f.count() == 1


def test_files(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.md").write_text("héllo")
    (d / "b.txt").write_bytes("中文".encode("gbk"))
    (d / "c.csv").write_text("x,y\n1,2\n3,4\n")
    (d / "d.json").write_text('{"k": [1]}')
    (d / "e.xml").write_text("<r a='1'><x>t</x><y><z>u</z></y></r>")
    (d / "f.yaml").write_text("a: 1\n")
    (d / "g.bin").write_bytes(b"\x00")
    (d / "h.json").write_text("{")
    got = {r.path.rpartition("/")[2]: r for r in readers.processed(readers.files(spark, str(d))).collect()}
    assert got["a.md"].extracted_text == "héllo" and got["b.txt"].extracted_text == "中文"
    assert got["c.csv"].extracted_text.splitlines() == ["CSV表头: x | y", "-" * 50, "1 | 2", "3 | 4"]
    assert "键数量: 1" in got["d.json"].extracted_text and "    z: u" in got["e.xml"].extracted_text
    assert got["f.yaml"].success and not got["g.bin"].success and got["h.json"].extracted_text.startswith("JSON解析错误")
    assert {r.file_name for r in readers.text_directory(spark, str(d)).collect()} == {"a.md", "b.txt"}
    s = readers.storage_stats(readers.files(spark, str(d), content=False)).first()
    assert s.files == 8 and s.directories == 1
    raw = spark.createDataFrame([(b"\xd6\xd0",), (b"\xff",), ("é".encode(),), (None,)], "b binary")
    assert [r[0] for r in raw.select(readers.decode_cascade(F.col("b"))).collect()] == ["中", "ff", "é", None]


def test_round_trips(spark, tmp_path):
    docs = spark.createDataFrame([("1", 'a "q", \n b'), ("2", "é|,")], "document_id string, text string")
    store.write_csv(docs, str(tmp_path / "x.csv"))
    assert rows(readers.csv_dataset(spark, str(tmp_path / "x.csv"), "text", "document_id"), "document_id") == rows(docs, "document_id")
    with pytest.raises(NotImplementedError):
        readers.csv_dataset(spark, "x.parquet", "a", "b")
    ann = extraction.annotate(spark.createDataFrame([(1, "Ada met Bob.")], "doc_id int, text string"), extract.RuleModel(), "x")
    store.write_annotated(ann, str(tmp_path / "ann"))
    assert rows(readers.annotated(spark, str(tmp_path / "ann"))) == rows(ann)
    with pytest.raises(ValueError):
        store.write_annotated(ann.limit(0), str(tmp_path / "none"))
    n = _node(spark, ("g", "a", "d", {"k": "v"}, ["f"], 0)).drop("ord")
    path = store.write_version(n, str(tmp_path / "nodes"))
    assert store.read_version(spark, path, S.NODE).select(*n.columns).first() == n.first()
    bad = store.send(spark.range(5), lambda batch: 1 / 0 if any(r["id"] == 3 for r in batch) else None, 2)
    assert [json.loads(r.row)["id"] for r in bad.collect()] == [3]
    names = spark.createDataFrame([("d", "a.md", 1), ("d", "a.md", 2), ("e", "a.md", 3)], "dir string, name string, o int")
    assert [r.unique_name for r in store.unique_names(names, "dir", "name", "o").orderBy("o").collect()] == ["a.md", "a_1.md", "a.md"]


def test_stream(spark, tmp_path):
    d = tmp_path / "land"
    d.mkdir()
    (d / "a.md").write_text("Ada")
    seen = []
    q = ingest.ingest(ingest.landed(spark, str(d)), lambda df, k: seen.extend(r.text for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert seen == ["Ada"] and not ingest.progress(q)["active"]


def test_highlight():
    assert align.highlight("a<bc", [(0, 4, "X", "#1"), (1, 2, "Y", "#2")]) == '<mark style="background:#1" title="X">a<mark style="background:#2" title="Y">&lt;</mark>bc</mark>'


def test_places_without_one_big_window(spark):
    got = rows(chunks.with_places(spark.range(100).repartition(7), ["id"], "p"), "id")
    assert got == [(k, k) for k in range(100)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_places_of_many_wide_rows(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        n = 1_000_000
        wide = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("a"), F.sha2((F.col("id") + 1).cast("string"), 256).alias("b"))
        got = chunks.with_places(wide, ["k"], "place").agg(F.count("*").alias("n"), F.sum((F.col("place") == F.col("k")).cast("long")).alias("right"), F.max("place").alias("last")).first()
        assert (got.n, got.right, got["last"]) == (n, n, n - 1)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])


def test_merges_collect_no_hot_key(spark):
    n = 20_000
    hot = spark.range(n).select(F.lit("n").alias("name"), F.lit("t").alias("type"), F.create_map(F.lit("k"), F.col("id").cast("string"), F.concat(F.lit("p"), (F.col("id") % 5).cast("string")), F.lit("x")).alias("props"), F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("description"))
    first, last = merge.merge_entities(hot).first(), merge.build_nodes(hot).first()
    assert first.props["k"] == "0" and last.props["k"] == str(n - 1) and len(last.props) == 6
    assert last.description == str(n - 1 - (n - 1) % 3) and first.ord == 0
    files = hot.select(F.lit("i").alias("node_id"), F.lit("n").alias("node_name"), F.lit(None).cast("string").alias("node_type"), "description", "props", F.array(F.concat(F.lit("f"), (F.col("ord") % 7).cast("string")), F.lit(None).cast("string")).alias("filename"), "ord")
    r = merge.merge_nodes_across(files).first()
    assert r.description == hot.filter(F.col("ord") == n - 1).first().description and r.filename == [None, *[f"f{k}" for k in range(7)]]
    text = merge.build_nodes(hot)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in text.split("explode")[-1]  # before the entries are taken apart nothing is collected


def test_tasks_end_to_end(spark):
    from graphloom.plans import service

    none_n, none_e = spark.createDataFrame([], S.NODE), spark.createDataFrame([], S.EDGE)
    docs = spark.createDataFrame([(1, "Ada met Bob. Carl slept."), (2, "Ada met Carl."), (3, "")], "doc_id int, text string")
    n, e, bad = service.run_task(docs, extract.RuleModel(), "Find names.", none_n, none_e, "t1")
    assert {r.node_id for r in n.collect()} == {"Name_Ada", "Name_Bob", "Name_Carl"} and bad.count() == 0
    assert rows(e.select("source_id", "target_id"), "target_id") == [("Name_Ada", "Name_Bob"), ("Name_Ada", "Name_Carl")]
    _, _, bad = service.run_task(docs, extract.FaultyModel(), "Find names.", none_n, none_e, "t1")
    assert bad.count() == 2
    r = service.task_result(n, e, 7, "t1").first()
    assert (r.id, r.ok, r.entities, r.relations) == (7, True, 3, 2)
    master = _node(spark, ("kg", "d1", "x", {}, [], 0)).drop("ord").withColumn("node_name", F.lit("annual report"))
    m_n, m_e = service.merge_matched(n.unionByName(master), e, "t1", "kg", "d1")
    assert m_n.filter("graph_tag = 'kg'").count() == 4
    assert m_e.filter(F.col("relation_type") == S.DERIVED_FROM).count() == 3
    tasks = spark.createDataFrame([(1, "annual reprot.md", 2, 0), (2, "something else.md", 2, 0), (3, "annual report.md", 1, 0)], "id long, name string, status byte, del_flag byte")
    named = master.withColumn("node_name", F.lit("annual_report"))
    got = {x.id: (x.node_id, x.error) for x in service.matches(tasks, named, "kg", "x").collect()}
    assert got == {1: ("d1", None), 2: (None, "no match")}
    assert [x.status for x in service.merged(tasks, spark.createDataFrame([(1,)], "id long")).orderBy("id").collect()] == [3, 2, 1]


def test_ontology_text_and_validation(spark):
    from graphloom.operators import ontology

    o = {"nodes": [{"id": "1", "label": "City", "attr": [{"label": "nodeId"}, {"label": "size", "type": "INT", "description": "people"}]}], "edges": [{"label": "near", "source": "1", "target": "2"}]}
    key, t = ontology.template(o)
    assert len(key) == 8 and t.splitlines() == ["Entity types:", "- City [size (INT): people]", "Relation types:", "- near: City -> "]
    assert spark.range(1).select(ontology.question(F.lit("x"), o)).first()[0].endswith("Text:\nx")
    df = spark.createDataFrame([("", 1), ("a.md", None), ("a.md", 0), ("a.xyz", 1), ("a.md", 5)], "path string, size int")
    assert [r.error_message for r in ontology.checked(df, "path", "size", [".md"]).collect()] == ["no path", "no such file", "the file is empty", "unsupported: .xyz", None]
    assert ontology.drawn(spark.range(100), 10, "id").count() == 10 and ontology.perturbed("abc", 1) != "abc"


def test_answers_in_fences_and_yaml(spark):
    good = '{"extractions": [{"Name": "Ada", "Name_attributes": {"role": "x"}}]}'
    texts = [good, f"Sure:\n```json\n{good}\n```\nbye", f"```json\n{good}", None, "```json\n```"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, answer string").withColumn("chunk", F.lit(0))
    faults = [r.f for r in df.orderBy("doc").select(extract.fault(extract.as_json(F.col("answer"))).alias("f")).collect()]
    assert faults == [None, None, "not json", "not json", "not json"]
    nodes, _ = extraction.graph_of(df)
    assert rows(nodes.select("node_id", F.col("props")["role"])) == [("Name_Ada", "x")]
    yaml = "words\n```yaml\nextractions:\n- Name: Ada\n  Name_attributes: {role: x}\n- 关系: ''\n  关系_attributes: {主体: Ada, 谓词: knows, 客体: Ada}\n```"
    df = spark.createDataFrame([(0, 0, yaml), (1, 0, "extractions: ["), (2, 0, "- 1")], "doc int, chunk int, answer string")
    nodes, edges = extraction.graph_of(df, "yaml")
    assert rows(nodes.select("node_id")) == [("Name_Ada",)] and rows(edges.select("source_id", "relation_type", "target_id")) == [("Name_Ada", "knows", "Name_Ada")]
    with pytest.raises(ValueError):
        extract.as_json(F.lit("x"), "toml")


def test_two_step_extraction(spark):
    def model(prompts):  # finds entities when asked for them, and relations only among those that it is told of
        out = []
        for p in prompts:
            text = p.rpartition("Q: ")[2].removesuffix("\nA: ")
            if "relations" in p.splitlines()[0]:
                told = [x.removeprefix("- Name: ") for x in p.splitlines() if x.startswith("- Name: ")]
                items = [{"关系": "", "关系_attributes": {"主体": a, "谓词": "knows", "客体": b}} for a, b in zip(told, told[1:])]
            else:
                items = [{"Name": w} for w in text.split() if w.istitle()] + [{"Name": ""}] * ("blank" in text)
            out.append("nonsense" if "broken" in text else "```json\n" + json.dumps({"extractions": items}, ensure_ascii=False) + "\n```")
        return out

    docs = spark.createDataFrame([(1, "Ada met Bob"), (2, "only Carl here"), (3, "nobody"), (4, "blank and Dan and Eve"), (5, "broken"), (6, "Ada " * 900)], "doc_id int, text string")
    found = extraction.answers(docs, model, "Find entities.", relation_description="Find relations.")
    got = sorted((r.doc, r.route, r.step) for r in found.select("doc", "route", "step").collect())
    both = lambda d: [(d, "twostep", "entities"), (d, "twostep", "relations")]
    assert got == [*both(1), *both(4), (5, "twostep", "entities"), (6, "oneshot", "all")]
    nodes, edges = extraction.graph_of(found)
    assert {r.node_name for r in nodes.collect()} == {"Ada", "Bob", "Dan", "Eve"}
    assert rows(edges.select("source_id", "target_id"), "source_id") == [("Name_Ada", "Name_Bob"), ("Name_Dan", "Name_Eve")]


def test_clients():
    assert [client.dialect(u, m) for u, m in (("https://dashscope.aliyuncs.com/x", "q"), ("https://x", "DeepSeek-r1"), ("https://api.openai.com", "g"), ("https://open.zhipuai.cn", "g"), ("http://me", "m"))] == ["dashscope", "deepseek", "openai-compatible", "zhipu", "unknown"]
    headers, body = client.request("hi", "https://dashscope.aliyuncs.com", "m", "k", temperature=0.5, top_p=1)
    assert headers["Accept"] == "application/json" and headers["Authorization"] == "Bearer k" and body == {"model": "m", "messages": [{"role": "user", "content": "hi"}], "temperature": 0.5, "top_p": 1}
    assert client.reply({"choices": [{"message": {"content": "a"}}]}, "unknown") == client.reply({"output": {"choices": [{"message": {"content": "a"}}]}}, "dashscope") == client.reply({"output": {"text": "a"}}, "dashscope") == client.reply({"choices": [{"text": "a"}]}, "dashscope") == "a"
    assert json.loads(client.reply({"x": 1}, "unknown")) == {"x": 1}
    for body, kind in (({}, "dashscope"), ({"choices": []}, "openai-compatible"), ({"choices": [{}]}, "zhipu")):
        with pytest.raises(ValueError):
            client.reply(body, kind)
    assert [client.wait_after(k, "429 Too Many") for k in (0, 1)] == [35, 70] and client.wait_after(2, "timeout") == 120
    waits, replies = [], [(429, "slow"), (500, "Rate limit"), (200, '{"choices": [{"message": {"content": "ok"}}]}')]
    model = client.HttpModel(lambda *a: replies.pop(0), "http://me", "m", "k", sleep=waits.append)
    assert model(["p"]) == ["ok"] and waits == [35, 70]
    with pytest.raises(ValueError):
        client.HttpModel(lambda *a: (500, ""), "http://me", "m", "k", retries=1)(["p"])
    with pytest.raises(ValueError):
        client.HttpModel(print, "http://me", "m", "")


def test_clusters_equal_the_slow_rule(spark):
    rng = random.Random(21)
    names = ["".join(rng.choice("ab") for _ in range(rng.randint(4, 12))) for _ in range(150)]
    ents = [(["t", "组织"][k % 2], n, {"地区": rng.choice(["x", "y", ""])}, k) for k, n in enumerate(names)]
    df = spark.createDataFrame(ents, "type string, name string, props map<string,string>, ord long")
    got = {r.ord: r.cluster for r in cluster.clusters(df).collect()}
    leaders, want = [], {}
    for t, n, p, k in ents:
        dis = p["地区"] if t == "组织" else ""
        mine = next((o for u, m, d, o in leaders if u == t and cluster.should_merge(m, n, d, dis)), None)
        if mine is None:
            leaders.append((t, n, dis, k))
        want[k] = k if mine is None else mine
    assert got == want and 10 < len(leaders) < 150
