"""Plugs, objects, readers and small helpers, with services that live in the test."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from graphloom.operators import align, chunks, extract, graph, ontology
from graphloom.sources import readers, remote, store


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), content)
    return out.getvalue()


def test_conversion_polls_and_unpacks(spark):
    zipped = archive(full_dot_md="# Title", images__a_dot_png=b"\x89", images__note_dot_md="no")

    class Service:
        asked = 0

        def submit(self, name, content):
            if content == b"bad":
                raise OSError("refused")
            return "b-" + name

        def status(self, batch):
            self.asked += 1
            name = batch[2:]
            if self.asked % 3 == 1:
                return {"message": "busy"}
            state = "failed" if "broken" in name else "running" if self.asked % 3 == 2 else "done"
            return {"data": {"extract_result": [{"file_name": "other", "state": "done"}, {"file_name": name, "state": state, "err_msg": "torn page", "full_zip_url": "" if "lost" in name else "http://z"}]}}

        def download(self, url):
            return zipped

    text, images = remote.convert(Service(), "a.pdf", b"x", sleep=lambda s: None)
    assert text == "# Title" and images == [("images/a.png", b"\x89")]
    assert remote.unpacked(archive(a_dot_txt="x")) == ("", [])
    with pytest.raises(TimeoutError):
        remote.convert(Service(), "a.pdf", b"x", polls=2, sleep=lambda s: None)
    waits = []
    remote.convert(Service(), "a.pdf", b"x", sleep=waits.append)
    assert waits == [10, 10]
    assert remote.batch_states(Service(), ["b-x"]) == []
    service = Service()
    service.asked = 1
    assert remote.batch_states(service, ["b-x"]) == [("b-x", "other", "done"), ("b-x", "x", "running")]
    files = spark.createDataFrame([("d/a.pdf", b"x"), ("d/broken.pdf", b"x"), ("d/lost.pdf", b"x"), ("d/c.pdf", b"bad")], "path string, content binary").coalesce(1)
    results = remote.converted(files, Service(), wait=0)
    got = {r.path: r for r in results.collect()}
    assert got["d/a.pdf"].extracted_text == "# Title" and "torn page" in got["d/broken.pdf"].error_message
    assert "no archive" in got["d/lost.pdf"].error_message and "refused" in got["d/c.pdf"].error_message
    assert [(r.path, r.idx, r.name) for r in remote.images_of(results).collect()] == [("d/a.pdf", 0, "images/a.png")]


def test_document_flags(spark):
    files = spark.createDataFrame([("d/a.pdf", b"%PDF /Font /Subtype/Image"), ("d/b.pdf", b"%PDF /Encrypt")], "path string, content binary")
    got = [(r.file_name, r["size"], r.has_text, r.has_images, r.is_encrypted) for r in remote.document_flags(files).orderBy("path").collect()]
    assert got == [("a.pdf", 25, True, True, False), ("b.pdf", 13, False, False, True)]


def test_search_and_prompts(spark):
    def search(q, n):
        if q == "bad":
            raise OSError("down")
        return [{"title": f"{q}{k}", "url": "u", "content": "c"} for k in range(9)]

    rows = remote.searched(spark.createDataFrame([("a",), ("bad",), ("b",)], "query string"), search, most=2).collect()
    assert sorted((r.query, r["rank"], r.title, r.error) for r in rows if r.error is None) == [("a", 1, "a0", None), ("a", 2, "a1", None), ("b", 1, "b0", None), ("b", 2, "b1", None)]
    assert [(r["rank"], r.error) for r in rows if r.query == "bad"] == [(None, "down")]
    stored = {("p", "production"): "Find {{ kind }} in {{text}} {{rest}}"}
    prompts = remote.Prompts(lambda n, label: stored[n, label], {"q": "local {{x}}"})
    assert prompts.text("p", kind="names", text="T") == "Find names in T {{rest}}" and prompts.text("q", x=1) == "local 1"
    with pytest.raises(KeyError):
        prompts.text("nothing")


def test_objects(spark, tmp_path):
    o = remote.Objects(spark, str(tmp_path / "store"))
    assert o.put("b", "x/a.md", "é".encode()) == {"bucket": "b", "key": "x/a.md", "size": 2, "content_type": "text/markdown"}
    o.put("b", "x/a.md", b"newer")
    o.put("b", "y.bin", bytes(range(256)))
    assert o.get("b", "x/a.md") == b"newer" and o.get("b", "y.bin") == bytes(range(256))
    assert o.exists("b", "y.bin") and not o.exists("b", "z") and o.stat("b", "x/a.md")["size"] == 5
    assert sorted((r["key"], r["size"]) for r in o.listed("b").collect()) == [("x/a.md", 5), ("y.bin", 256)] and o.listed("b", "x/").count() == 1
    assert o.delete("b", "y.bin") and not o.exists("b", "y.bin") and not o.delete("b", "y.bin")
    assert o.url("b", "k").endswith("/b/k")
    for bucket, key in (("", "a"), ("b", "../c")):
        with pytest.raises(ValueError):
            o.put(bucket, key, b"")
    up = remote.uploads(spark, [("a.md", b"x", None), ("b", b"y", "text/x")])
    assert [(r.filename, bytes(r.content), r.content_type) for r in up.orderBy("filename").collect()] == [("a.md", b"x", "text/markdown"), ("b", b"y", "text/x")]
    root = str(tmp_path)

    def put(path, content):
        if "bad" in path:
            raise OSError("full")
        with open(f"{root}/{path}", "wb") as f:
            f.write(content)

    sent = remote.stored(spark.createDataFrame([("p1", b"1"), ("bad", b"2")], "path string, content binary"), put).collect()
    assert sorted((r.path, r.success, r.error) for r in sent) == [("bad", False, "full"), ("p1", True, None)] and (tmp_path / "p1").read_bytes() == b"1"


def test_registries_and_settings():
    class Base: ...

    class One(Base):
        def __init__(self, a=1, b=2):
            self.a, self.b = a, b

    r = remote.Registry(Base)
    r.register("One", One)
    assert r.names() == ["one"] and (r.make("ONE", a=5, b=None).a, r.make("one").b) == (5, 2)
    with pytest.raises(TypeError):
        r.register("x", str)
    with pytest.raises(ValueError):
        r.make("two")
    assert remote.origins('["a", "b"]') == remote.origins("a, b") == remote.origins("[a, 'b']") == remote.origins(["a", "b"]) == ["a", "b"]
    assert remote.origins("[]") == remote.origins(None) == []
    assert remote.database_url("u", "p&", "h", 3306, "d") == "jdbc:mysql://h:3306/d?user=u&password=p%26"


def test_processed_files_are_written(spark, tmp_path):
    results = spark.createDataFrame([("d/a.md", ".md", True, "text é\nline", {}, None), ("d/b.csv", ".csv", True, "", {}, None), ("d/c.bin", ".bin", False, None, {}, "no processor")], "path string, file_type string, success boolean, extracted_text string, metadata map<string,string>, error_message string")
    out = str(tmp_path / "out")
    got = {r.name: (r.output, r.error_message) for r in remote.processed_to(results, out).collect()}
    assert got == {"a": (f"{out}/kind=md", None), "b": (f"{out}/kind=csv", None), "c": (None, "no processor")}
    again = spark.read.text(out).collect()
    assert sorted((r.kind, json.loads(r.value)["text"]) for r in again) == [("csv", ""), ("md", "text é\nline")]


def test_readers_without_a_query(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"node_id": "a", "node_name": "A", "node_type": "t", "properties": {"k": "v"}}], "edges": [{"source_id": "a", "target_id": "b", "relation_type": "r"}]}))
    n, e = readers.graph_json(spark, str(tmp_path / "g.json"), "tag")
    assert [(r.graph_tag, r.node_id, r.props, r.ord) for r in n.collect()] == [("tag", "a", {"k": "v"}, 0)]
    assert [(r.source_id, r.target_id, r.weight, r.bidirectional) for r in e.collect()] == [("a", "b", 1.0, False)]
    (tmp_path / "p.yaml").write_text("description: D\nexamples: []\n")
    (tmp_path / "p.json").write_text('{"description": "J"}')
    assert readers.prompt_template(str(tmp_path / "p.yaml"))["description"] == "D" and readers.prompt_template(str(tmp_path / "p.json"))["description"] == "J"
    info = {r.file_name: r for r in readers.file_info(readers.files(spark, str(tmp_path), content=False)).collect()}
    assert info["p.yaml"].extension == ".yaml" and info["p.yaml"]["size"] == 28 and "T" in info["p.yaml"].modified
    known = {r.processor: r.extensions for r in readers.processors(spark).collect()}
    assert known["plain"] == [".md", ".txt"] and ".csv" in known["text_of_csv"]
    pages = {"http://a": "é".encode(), "http://b": "中".encode("gbk")}
    got = {r.url: (r.content, r.error) for r in readers.fetched(spark.createDataFrame([("http://a",), ("http://b",), ("http://c",)], "url string"), lambda u: pages[u]).collect()}
    assert got["http://a"] == ("é", None) and got["http://b"][0] == "中" and got["http://c"][0] is None
    assert store.healthy(spark)
    store.create_tables(spark, {"graphloom_probe": "id long"})
    assert spark.table("graphloom_probe").count() == 0
    store.drop_tables(spark, ["graphloom_probe"])
    assert not spark.catalog.tableExists("graphloom_probe")


def test_token_ranges():
    t = "Ada met Dr. Bob. They left."
    toks = chunks.spans(t)
    assert chunks.tokens_text(t, toks, 1, 4) == "met Dr." and chunks.char_interval(toks, 0, 1) == (0, 3)
    assert chunks.sentence_range(t, toks, 2) == (2, 6) and chunks.sentence_range(t, toks, 6)[1] == len(toks)
    for a, b in ((-1, 2), (2, 2), (0, 99)):
        with pytest.raises(ValueError):
            chunks.tokens_text(t, toks, a, b)
    with pytest.raises(IndexError):
        chunks.sentence_range(t, toks, 99)


def test_keyset_pages(spark):
    pages = list(graph.paged(spark.range(25).repartition(3), "id", 10))
    assert [[r.id for r in p] for p in pages] == [list(range(10)), list(range(10, 20)), list(range(20, 25))]
    assert list(graph.paged(spark.range(0), "id", 10)) == [] and len(list(graph.paged(spark.range(20), "id", 10))) == 2


def test_highlight_pages(spark):
    doc = [("d", "a<bc", [{"extraction_class": "X", "extraction_text": "a", "char_interval": {"start_pos": 0, "end_pos": 2}}, {"extraction_class": "Y", "extraction_text": "", "char_interval": None}])]
    df = spark.createDataFrame(doc, "document_id string, text string, extractions array<struct<extraction_class:string,extraction_text:string,char_interval:struct<start_pos:int,end_pos:int>>>")
    html = align.pages(df, {"X": "#1", "<": "#2"}).first().html
    assert '<mark style="background:#1" title="X">a&lt;</mark>bc' in html and "&lt;</mark>" in align.legend({"<": "#2"}) and html.startswith('<div class="legend">')
    store_rows = align.shown(spark.createDataFrame([("0123456789", 4, 6)], "t string, a int, b int"), "t", "a", "b", 3).first()
    assert (store_rows.before, store_rows.inside, store_rows.after) == ("123", "45", "678")


def test_default_descriptions():
    assert ontology.description("entities", None, "- City").endswith("Entity types:\n- City")
    assert ontology.description("relations", " Mine. ", "- City", "- near") == "Mine.\n\nRelation types:\n- near"
    both = ontology.description("combined", "", "- City", "- near")
    assert "Entity types" in both and "Relation types" in both and both.startswith(ontology.ENTITY_PROMPT)
    with pytest.raises(ValueError):
        ontology.description("other")


def test_equal_prompts_are_asked_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def model(prompts):
        with open(log, "a") as f:
            f.write("x" * len(prompts))
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(10)], "k int, prompt string")
    assert sorted((r.k, r.answer) for r in extract.remembered(rows, model).collect()) == [(k, "AB"[k % 2]) for k in range(10)]
    with open(log) as f:
        assert f.read() == "xx"
    blank = spark.createDataFrame([("t", ""), ("", "x"), ("t", "y")], "class string, text string")
    assert [r.text for r in extract.entities(blank, allow_blank=False).select(F.col("text")).collect()] == ["y"]
