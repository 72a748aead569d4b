"""Queries over documents, text, model answers and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import ids, text
from ..operators import align, catalog, chunks, extract
from ..sources import readers, remote
from . import extraction
from .fixtures import FILES, GRAPHS, TASKS, files, graphs, spread, table, tasks
from .registry import query

#: White space as the tokenizer sees it, for SQL engines whose \s is ASCII only.
WS = r"\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
TOKEN_SQL = rf"[A-Za-z0-9]+(?:/[A-Za-z0-9]+)+|[A-Za-z]+|[0-9]+|[^A-Za-z0-9{WS}]+"


def built_answers(spark, sf):
    """documents as model answers: a language, a source, and their relation."""
    d = table(spark, sf, "documents")
    attrs = lambda **kv: F.to_json(F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)]))
    q = lambda c: F.to_json(F.array(c))
    inner = lambda c: F.substring(q(c), 2, 1_000_000).substr(F.lit(1), F.length(q(c)) - 2)
    body = F.concat(
        F.lit('{"extractions": [{"Language": '), inner(F.col("lang")), F.lit(', "Language_attributes": '), attrs(source=F.col("source")), F.lit('}, {"Source": '), inner(F.col("source")), F.lit(', "Source_attributes": null}, {"关系": "", "关系_attributes": '),
        attrs(主体=F.col("lang"), 谓词=F.lit("appears in"), 客体=F.col("source")), F.lit("}]}"),
    )
    return d.select(F.col("doc_id").alias("doc"), F.lit(0).alias("chunk"), body.alias("answer"))


@query("""
SELECT 'Language' AS node_type, count(DISTINCT lang) AS node_count, (SELECT count(*) FROM (SELECT DISTINCT lang, source FROM documents)) AS edge_count FROM documents
UNION ALL SELECT 'Source', count(DISTINCT source), 0 FROM documents""")
def kg_build_stats(spark, sf):
    return extraction.counts(*extraction.graph_of(built_answers(spark, sf)))


@query(f"WITH {GRAPHS} SELECT CAST(id AS VARCHAR) AS id, name, coalesce(description, '') AS description, status FROM graphs WHERE del_flag = 0")
def catalog_live_list(spark, sf):
    return catalog.public(catalog.live(graphs(spark, sf))).select("id", "name", "description", "status")


@query(f"WITH {GRAPHS} SELECT id, name, status FROM graphs WHERE del_flag = 0 ORDER BY id LIMIT 10 OFFSET 20")
def catalog_page(spark, sf):
    return catalog.page(catalog.live(graphs(spark, sf)), 3, 10).select("id", "name", "status")


@query(f"WITH {GRAPHS} SELECT id, name FROM graphs WHERE del_flag = 0 AND name ILIKE '%MER#00000%'")
def catalog_name_search(spark, sf):
    return catalog.named_like(catalog.live(graphs(spark, sf)), "mer#00000").select("id", "name")


@query(f"WITH {GRAPHS} SELECT count(*) AS total FROM graphs WHERE del_flag = 0")
def catalog_total(spark, sf):
    return catalog.live(graphs(spark, sf)).agg(F.count("*").alias("total"))


@query(f"WITH {TASKS} SELECT id, kg_id, status FROM tasks WHERE del_flag = 0 AND id = 7")
def task_point_lookup(spark, sf):
    return catalog.find(tasks(spark, sf), id=7).select("id", "kg_id", "status")


@query(f"WITH {TASKS} SELECT id, status <> 1 AS can_delete, status = 2 AS can_merge FROM tasks WHERE del_flag = 0")
def task_status_guard(spark, sf):
    return catalog.live(tasks(spark, sf)).select("id", catalog.can_delete(F.col("status")).alias("can_delete"), catalog.can_merge(F.col("status")).alias("can_merge"))


@query(f"WITH {FILES}, p AS (SELECT * FROM files ORDER BY id LIMIT 10 OFFSET 10) SELECT id, filename, (SELECT count(*) FROM p) AS page_total, (SELECT count(*) FROM files) AS total FROM p")
def file_page_local_total(spark, sf):
    f = files(spark, sf)
    p = catalog.page(f, 2, 10)
    n = p.agg(F.count("*").alias("page_total")).join(f.agg(F.count("*").alias("total")))  # one row each
    return p.select("id", "filename").join(n)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ingest_skip_existing(spark, sf):
    return catalog.missing(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


@query("SELECT count(*) AS requested, count(d.doc_id) AS found FROM labels l LEFT JOIN documents d USING (doc_id)")
def paths_all_exist(spark, sf):
    wanted, there = table(spark, sf, "labels").select("doc_id"), table(spark, sf, "documents").select("doc_id", F.lit(1).alias("x"))
    return wanted.join(there, "doc_id", "left").agg(F.count("*").alias("requested"), F.count("x").alias("found"))


@query(f"""
WITH {GRAPHS}, {TASKS}, {FILES},
gone AS (SELECT id FROM graphs WHERE id % 7 = 0 AND status <> 1),
t AS (SELECT id, CASE WHEN kg_id IN (SELECT id FROM gone) AND status <> 1 THEN 1 ELSE del_flag END AS del_flag, kg_id IN (SELECT id FROM gone) AND status <> 1 AS dropped FROM tasks)
SELECT 'graphs' AS kind, (SELECT count(*) FROM graphs WHERE CASE WHEN id % 7 = 0 AND status <> 1 THEN 1 ELSE del_flag END = 0) AS n
UNION ALL SELECT 'tasks', count(*) FROM t WHERE del_flag = 0
UNION ALL SELECT 'files', count(*) FROM files WHERE task_id NOT IN (SELECT id FROM t WHERE dropped)""")
def soft_delete_cascade(spark, sf):
    g, t, f = catalog.delete_cascade(graphs(spark, sf), tasks(spark, sf), files(spark, sf), F.col("id") % 7 == 0)
    n = lambda df, k: df.agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
    return n(catalog.live(g), "graphs").union(n(catalog.live(t), "tasks")).union(n(f, "files"))


@query(f"""WITH {TASKS} SELECT id, CASE WHEN id % 3 <> 0 THEN status WHEN id % 2 = 0 THEN 2 ELSE 4 END AS status,
  CASE WHEN id % 6 = 0 THEN 5 ELSE 0 END AS entity_count, CASE WHEN id % 3 = 0 AND status = 4 THEN 1 ELSE 0 END AS retry_count FROM tasks""")
def task_finish_update(spark, sf):
    t = tasks(spark, sf)
    done = t.filter("id % 3 = 0").select("id", (F.col("id") % 2 == 0).alias("ok"), F.lit(5).alias("entities"), F.lit(3).alias("relations"))
    return catalog.finish(t, done).select("id", "status", "entity_count", "retry_count")


@query("SELECT event_id, (((epoch_us(ts) // 1000) - 1640995200000) << 22) | (7 << 12) | ((row_number() OVER (PARTITION BY (epoch_us(ts) // 1000) ORDER BY event_id)) - 1) AS snowflake FROM events")
def snowflake_compose(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return ids.with_snowflakes(e, "ts", "event_id", 7).select("event_id", "snowflake")


@query("SELECT event_id, (epoch_us(ts) // 1000) AS ms, CAST(event_id % 1024 AS BIGINT) AS machine, CAST(event_id % 4096 AS BIGINT) AS seq FROM events")
def snowflake_parse(spark, sf):
    e = table(spark, sf, "events")
    s = ids.snowflake(F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id") % 1024, F.col("event_id") % 4096)
    return e.select("event_id", ids.snowflake_parts(s).alias("p")).select("event_id", "p.ms", "p.machine", "p.seq")


@query(f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{TOKEN_SQL}')) AS tok FROM documents)
SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (regexp_full_match(tok, '[0-9]+')) AS n_numbers,
  count(*) FILTER (regexp_full_match(tok, '[A-Za-z0-9]+(/[A-Za-z0-9]+)+')) AS n_acronyms, count(*) FILTER (regexp_full_match(tok, '[A-Za-z]+')) AS n_words FROM t GROUP BY doc_id""")
def token_types(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    n = text.token_counts(F.col("text"))
    d = d.select("doc_id", *[c.alias(f"n_{k.lower()}s") for k, c in n.items()])
    total = F.col("n_acronyms") + F.col("n_numbers") + F.col("n_words") + F.col("n_punctuations")
    return d.select("doc_id", total.alias("n_tokens"), "n_numbers", "n_acronyms", "n_words").filter("n_tokens > 0")


@query(f"SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g'), '[{WS}]*[\\n\\r][{WS}]*')) AS n_after_newline FROM documents")
def token_newline_flags(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", text.tokens_after_newline(F.col("text")).alias("n_after_newline"))


@query(f"""SELECT doc_id, length(text) AS n_chars, len(list_filter(regexp_split_to_array(text, '[{WS}]+'), lambda w: w <> '')) AS n_words, len(string_split(text, chr(10))) AS n_lines,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{WS}]'))) AS n_full_lines, round(length(text) / len(string_split(text, chr(10))), 6) AS chars_per_line FROM documents""")
def text_stats(spark, sf):
    s = text.statistics(F.col("text"))
    s["chars_per_line"] = F.round(s["chars_per_line"], 6)
    return table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in s.items()])


#: Tokens with what stands before them, numbered; then whether a sentence ends after each.
SENTENCES_SQL = rf"""items AS (SELECT doc_id, regexp_extract_all(text, '[{WS}]*(?:{TOKEN_SQL})') AS l FROM documents WHERE text IS NOT NULL),
toks AS (SELECT doc_id, unnest(l) AS m, generate_subscripts(l, 1) AS k, len(l) AS n FROM items),
cut AS (SELECT *, regexp_replace(m, '^[{WS}]+', '') AS tok FROM toks),
near AS (SELECT *, lag(tok, 1, '') OVER w AS before, lead(tok) OVER w AS after, lead(m) OVER w AS after_m FROM cut WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
ends AS (SELECT *, regexp_full_match(tok, '[^A-Za-z0-9]+') AND right(tok, 1) IN ('.', '?', '!') AND before || tok NOT IN ('Mr.', 'Mrs.', 'Ms.', 'Dr.', 'Prof.', 'St.')
  OR coalesce(contains(left(after_m, length(after_m) - length(after)), chr(10)) AND upper(left(after, 1)) = left(after, 1) AND lower(left(after, 1)) <> left(after, 1), false) AS stop FROM near)"""


@query(f"WITH {SENTENCES_SQL}, c AS (SELECT doc_id, count(*) FILTER (stop OR k = n) AS n FROM ends GROUP BY doc_id) SELECT doc_id, coalesce(c.n, 0) AS n_sentences FROM documents LEFT JOIN c USING (doc_id)")
def sentence_count(spark, sf):
    @F.pandas_udf("long")
    def n(x):
        import pandas as pd

        return pd.Series([len(chunks.sentence_ends(t or "", chunks.spans(t))) for t in x])

    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", n("text").alias("n_sentences"))


@query()
def sentence_chunks(spark, sf):
    c = chunks.sentence_chunks(spread(table(spark, sf, "documents").select("doc_id", "text")), "text", 1000)
    return c.select("doc_id", "chunk_id", "tok_start", "tok_end", "char_start", "char_end", F.md5("text").alias("digest"))


STRIP_SQL = f"regexp_replace(%s, '^[{WS}]+|[{WS}]+$', '', 'g')"
PARAGRAPHS_SQL = f"""list_reduce(list_transform(string_split(t, chr(10) || chr(10)), lambda p: {{'done': []::VARCHAR[], 'cur': p}}),
  lambda acc, x: CASE WHEN length(acc.cur) + length(x.cur) > 5000 AND acc.cur <> '' THEN {{'done': list_append(acc.done, {STRIP_SQL % 'acc.cur'}), 'cur': CASE WHEN length(acc.cur) > 500 THEN right(acc.cur, 500) ELSE acc.cur END || chr(10) || chr(10) || x.cur || chr(10) || chr(10)}}
    ELSE {{'done': acc.done, 'cur': acc.cur || x.cur || chr(10) || chr(10)}} END, {{'done': []::VARCHAR[], 'cur': ''}})"""


@query(f"""WITH d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, {PARAGRAPHS_SQL} AS r FROM d),
l AS (SELECT doc_id, list_concat(r.done, CASE WHEN {STRIP_SQL % 'r.cur'} = '' THEN []::VARCHAR[] ELSE [{STRIP_SQL % 'r.cur'}] END) AS l FROM r),
c AS (SELECT doc_id, unnest(l) AS chunk, generate_subscripts(l, 1) - 1 AS chunk_id FROM l) SELECT doc_id, CAST(chunk_id AS INTEGER) AS chunk_id, CAST(length(chunk) AS INTEGER) AS n_chars, md5(chunk) AS digest FROM c""")
def paragraph_chunks(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")))
    d = d.select("doc_id", F.posexplode(chunks.paragraph_chunks(F.col("text"))).alias("chunk_id", "chunk"))
    return d.select("doc_id", "chunk_id", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 10 AS BIGINT) AS batch FROM documents")
def batch_assignment(spark, sf):
    return chunks.batches(table(spark, sf, "documents").select("doc_id"), 10, "doc_id")


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM documents WHERE doc_id % 5 = 0) GROUP BY doc_id HAVING count(*) > 1")
def duplicate_doc_ids(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return chunks.duplicate_ids(d.union(d.filter("doc_id % 5 = 0")))


@query("SELECT CASE WHEN length(text) > 3000 THEN 'oneshot' ELSE 'twostep' END AS route, count(*) AS n FROM documents GROUP BY 1")
def route_by_length(spark, sf):
    return table(spark, sf, "documents").groupBy(extract.route(F.col("text")).alias("route")).agg(F.count("*").alias("n"))


NAMES_SQL = "names AS (SELECT p_partkey, p_name || CASE p_partkey % 7 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.png' WHEN 3 THEN '.md' WHEN 4 THEN '.tar.gz' WHEN 5 THEN '.csv' ELSE '' END AS name FROM part)"


def _names(spark, sf):
    k = F.col("p_partkey") % 7
    end = F.element_at(F.array(*map(F.lit, [".PDF", ".docx", ".png", ".md", ".tar.gz", ".csv", ""])), (k + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.concat("p_name", end).alias("name"))


@query(f"""WITH {NAMES_SQL} SELECT p_partkey, split_part(name, '.', 1) AS stem,
  CASE WHEN p_partkey % 7 = 0 THEN 'pdf' WHEN p_partkey % 7 = 1 THEN 'office' WHEN p_partkey % 7 = 2 THEN 'image' WHEN p_partkey % 7 IN (3, 5) THEN 'text' ELSE 'unknown' END AS route FROM names""")
def route_by_extension(spark, sf):
    return _names(spark, sf).select("p_partkey", text.stem_of_file(F.col("name")).alias("stem"), text.route(F.col("name")).alias("route"))


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'document' WHEN 1 THEN 'document' WHEN 2 THEN 'image' WHEN 3 THEN 'text' WHEN 5 THEN 'data' ELSE 'unknown' END AS type,
  CASE p_partkey % 7 WHEN 0 THEN 'PDF文档' WHEN 1 THEN 'Word文档' WHEN 2 THEN 'PNG图片' WHEN 3 THEN 'Markdown文件' WHEN 5 THEN 'CSV数据文件' ELSE '未知类型文件' END AS description FROM part""")
def extension_info(spark, sf):
    n = _names(spark, sf).select("p_partkey", text.extension_info(text.extension(F.col("name"))).alias("i"))
    return n.select("p_partkey", "i.type", "i.description")


@query(r"""WITH n AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN page_id || '-' || url ELSE '《' || url || '》' END AS raw FROM pages),
a AS (SELECT page_id, raw, regexp_replace(regexp_replace(regexp_replace(raw, '[^a-zA-Z0-9_一-鿿]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS p,
  regexp_replace(regexp_replace(regexp_replace(raw, '[^a-zA-Z0-9_一-鿿（）《》“”、？！：；。，]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS m FROM n)
SELECT page_id, CASE WHEN p = '' THEN 'property' WHEN regexp_matches(p, '^[0-9]') THEN 'prop_' || p ELSE p END AS property, CASE WHEN regexp_matches(m, '^[0-9]') THEN '_' || m ELSE m END AS matching,
  regexp_replace(raw, '[^\p{L}\p{N}]', '_', 'g') AS relation, regexp_replace(regexp_replace(raw, '[<>:"/\\|?*]', '_', 'g'), '[\s.]+', '_', 'g') AS filename FROM a""")
def sanitise_names(spark, sf):
    p, u = F.col("page_id"), F.col("url")
    raw = F.when(p % 3 == 0, u).when(p % 3 == 1, F.concat(p.cast("string"), F.lit("-"), u)).otherwise(F.concat(F.lit("《"), u, F.lit("》")))
    return table(spark, sf, "pages").select("page_id", text.property_name(raw).alias("property"), text.match_name(raw).alias("matching"), text.relation_name(raw).alias("relation"), text.safe_filename(raw).alias("filename"))


@query("""WITH n AS (SELECT s_suppkey, regexp_replace(s_name, '#', '') AS bare FROM supplier), k AS (SELECT *, bare || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE '大' END AS company FROM n)
SELECT s_suppkey, lower(bare) AS plain, CASE WHEN regexp_full_match(company, '[A-Za-z0-9]+') THEN lower(company) ELSE company END AS company FROM k""")
def normalize_entity_name(spark, sf):
    s = table(spark, sf, "supplier")
    bare = F.regexp_replace("s_name", "#", "")
    name = F.concat(F.lit(" 《"), bare, F.when(F.col("s_suppkey") % 2 == 0, "》有限公司").otherwise("》大集团"))
    return s.select("s_suppkey", text.entity_name(bare, F.lit("x")).alias("plain"), text.entity_name(name, F.lit("公司")).alias("company"))


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[{WS}]+', ' ', 'g'), '^ | $', '', 'g')) AS digest FROM documents WHERE regexp_matches(text, '[^{WS}]')")
def whitespace_sanitize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.one_line(F.col("text")).alias("t")).filter("t is not null").select("doc_id", F.md5("t").alias("digest"))


SHOTS = [{"text": "Ada sleeps.", "extractions": [{"class": "Name", "text": "Ada", "attributes": {"role": "é"}}]}, {"text": " ", "extractions": []}]
PROMPT_SQL = """'Find names.' || chr(10) || chr(10) || 'role ' || role || chr(10) || chr(10) || 'Examples' || chr(10) || 'Q: Ada sleeps.' || chr(10) || 'A: {' || chr(10) || '  "extractions": [' || chr(10) || '    {' || chr(10) || '      "Name": "Ada",' || chr(10)
  || '      "Name_attributes": {' || chr(10) || '        "role": "' || chr(92) || 'u00e9"' || chr(10) || '      }' || chr(10) || '    }' || chr(10) || '  ]' || chr(10) || '}' || chr(10) || chr(10) || 'Q: ' || text || chr(10) || 'A: '"""


@query(f"SELECT conv_id, turn, md5({PROMPT_SQL}) AS digest, md5('Find names.' || chr(10) || chr(10) || 'Q: ' || text || chr(10) || 'A: ') AS bare_digest FROM conversations")
def render_prompt(spark, sf):
    full = extract.prompt(F.col("text"), "Find names.", SHOTS, F.concat(F.lit("role "), "role"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(full).alias("digest"), F.md5(extract.prompt(F.col("text"), "Find names.")).alias("bare_digest"))


def _bad_answers(spark, sf):
    k = F.col("event_id") % 6
    bad = F.array(*map(F.lit, extract.FaultyModel.KINDS))
    good = F.concat(F.lit('{"extractions": [{"event": "'), F.col("event_type"), F.lit('", "event_attributes": '), F.col("props"), F.lit("}]}"))
    return table(spark, sf, "events").select("event_id", F.when(k == 5, good).otherwise(F.element_at(bad, (k % 5 + 1).cast("int"))).alias("answer"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'not json' WHEN 1 THEN 'not an object' WHEN 2 THEN 'no extractions' WHEN 3 THEN 'an extraction is not an object' WHEN 4 THEN 'attributes are not an object' END AS fault FROM events""")
def parse_reject_bad(spark, sf):
    return _bad_answers(spark, sf).select("event_id", extract.fault(F.col("answer")).alias("fault"))


@query("SELECT event_id, 0 AS group_index, 1 AS extraction_index, event_type AS text, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 6 = 5")
def parse_extractions(spark, sf):
    a = _bad_answers(spark, sf).filter(extract.fault(F.col("answer")).isNull())
    return extract.unnest(a, "answer", ["event_id"]).select("event_id", "group_index", "extraction_index", "text", F.col("attributes")["k"].alias("k"))


@query("""SELECT doc_id AS doc, 0 AS group_index, 1 AS extraction_index, 'Language' AS class, lang AS text FROM documents
UNION ALL SELECT doc_id, 1, 2, 'Source', source FROM documents UNION ALL SELECT doc_id, 2, 3, '关系', '' FROM documents""")
def unnest_extractions(spark, sf):
    return extract.unnest(built_answers(spark, sf), "answer", ["doc"]).select("doc", "group_index", "extraction_index", "class", "text")


@query("SELECT event_id, CAST(event_id % 50 AS INT) AS extraction_index, event_type AS text FROM events WHERE event_id % 4 <> 0")
def unnest_indexed(spark, sf):
    idx = F.when(F.col("event_id") % 4 != 0, F.concat(F.lit(', "event_index": '), (F.col("event_id") % 50).cast("string"))).otherwise(F.lit(""))
    a = table(spark, sf, "events").select("event_id", F.concat(F.lit('{"extractions": [{"event": "'), F.col("event_type"), F.lit('"'), idx, F.lit("}]}")).alias("answer"))
    return extract.unnest(a, "answer", ["event_id"], index_suffix="_index").select("event_id", "extraction_index", "text")


def _fenced(spark, sf):
    """Answers as models give them: plain, fenced with words around, as YAML, and with an open fence only."""
    k = F.col("event_id") % 4
    body = F.concat(F.lit('{"extractions": [{"event": "'), F.col("event_type"), F.lit('", "event_attributes": {"user": "'), F.col("user_id").cast("string"), F.lit('"}}]}'))
    yaml = F.concat(F.lit("Here it is:\n```yaml\nextractions:\n- event: "), F.col("event_type"), F.lit("\n  event_attributes:\n    user: '"), F.col("user_id").cast("string"), F.lit("'\n```"))
    answer = F.when(k == 0, body).when(k == 1, F.concat(F.lit("Sure!\n```json\n"), body, F.lit("\n```\nDone."))).when(k == 2, yaml).otherwise(F.concat(F.lit("```json\n"), body))
    return table(spark, sf, "events").select("event_id", (k == 2).alias("yaml"), answer.alias("answer"))


@query("SELECT event_id, event_type AS text, CAST(user_id AS VARCHAR) AS user FROM events WHERE event_id % 4 <> 3")
def answers_unfenced(spark, sf):
    rows = _fenced(spark, sf)
    plain = rows.filter("not yaml").withColumn("answer", extract.as_json(F.col("answer"))).unionByName(rows.filter("yaml").withColumn("answer", extract.as_json(F.col("answer"), "yaml")))
    good = plain.filter(extract.fault(F.col("answer")).isNull())
    return extract.unnest(good, "answer", ["event_id"]).select("event_id", "text", F.col("attributes")["user"].alias("user"))


def _notes(spark, sf):
    """A short text for every customer: nobody, one name, or two names in a sentence."""
    name = lambda c: F.initcap(F.regexp_replace(c, " ", ""))
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, "nobody was seen").when(k == 1, F.concat(F.lit("we saw "), name("r_name"))).otherwise(F.concat(name("c_mktsegment"), F.lit(" lies in "), name("r_name"), F.lit(".")))
    return c.select(F.col("c_custkey").alias("doc_id"), text.alias("text"))


@query("""WITH f AS (SELECT c_custkey % 3 AS k, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS n, upper(left(replace(r_name, ' ', ''), 1)) || lower(substr(replace(r_name, ' ', ''), 2)) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT DISTINCT 'Name_' || n AS source_id, 'near' AS relation_type, 'Name_' || r AS target_id FROM f WHERE k = 2""")
def two_step_edges(spark, sf):
    found = extraction.answers(_notes(spark, sf), extract.RuleModel(), "Find names.", relation_description="Find relations.")
    return extraction.graph_of(found)[1].select("source_id", "relation_type", "target_id")


@query("SELECT CASE c_custkey % 3 WHEN 2 THEN 'relations' END AS step, count(*) AS n FROM customer WHERE c_custkey % 3 = 2 GROUP BY 1 UNION ALL SELECT 'entities', count(*) FROM customer WHERE c_custkey % 3 = 2")
def two_step_calls(spark, sf):
    found = extraction.answers(_notes(spark, sf), extract.RuleModel(), "Find names.", relation_description="Find relations.")
    return found.groupBy("step").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name AS source, 'in' AS type, CAST(c_nationkey AS VARCHAR) AS target FROM customer WHERE c_custkey % 5 <> 0")
def relation_key_fallback(spark, sf):
    c = table(spark, sf, "customer")
    first = F.col("c_custkey") % 2 == 0
    key = lambda k: F.when(first, k[0]).otherwise(k[1])
    a = F.map_from_arrays(F.array(key(S.SUBJECT_KEYS), key(S.PREDICATE_KEYS), key(S.OBJECT_KEYS)), F.array("c_name", F.when(F.col("c_custkey") % 5 == 0, "").otherwise("in"), F.col("c_nationkey").cast("string")))
    rows = c.select("c_custkey", F.lit(S.RELATION_CLASS).alias("class"), F.lit("").alias("text"), a.alias("attributes"))
    return extract.relations(rows, ["c_custkey"])


@query("SELECT c_custkey, c_name AS subject, c_mktsegment AS predicate, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS object FROM customer")
def example_fallback(spark, sf):
    c = table(spark, sf, "customer")
    k = (F.col("c_custkey") % 3 + 1).cast("int")
    key = lambda keys: F.element_at(F.array(*map(F.lit, keys[:3])), k)
    a = F.map_from_arrays(F.array(key(S.EXAMPLE_SUBJECT_KEYS), key(S.EXAMPLE_PREDICATE_KEYS), key(S.EXAMPLE_OBJECT_KEYS)), F.array("c_name", "c_mktsegment", F.when(k == 3, "").otherwise(F.col("c_nationkey").cast("string"))))
    return c.select("c_custkey", extract.normalised_example(a).alias("e")).select("c_custkey", "e.*")


def _nested(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = F.format_string('```json\n{"entities": {"nation": {"%s": {"key": "%d"}}, "region": {"%s": {}}}, "relations": {"in": [{"subject": {"name": "%s", "label": "nation"}, "object": {"name": "%s", "type": "region"}}]}}\n```', "n_name", "n_nationkey", "r_name", "n_name", "r_name")
    return n.select("n_nationkey", body.alias("answer"))


@query("SELECT n_nationkey, 'nation' AS type, n_name AS name, CAST(n_nationkey AS VARCHAR) AS key FROM nation UNION ALL SELECT n_nationkey, 'region', r_name, NULL FROM nation JOIN region ON n_regionkey = r_regionkey")
def nested_result_unnest(spark, sf):
    return extract.nested_entities(_nested(spark, sf), "answer", ["n_nationkey"]).select("n_nationkey", "type", "name", F.col("props")["key"].alias("key"))


@query("SELECT n_nationkey, 'in' AS type, 'nation' AS subject_type, n_name AS subject_name, 'region' AS object_type, r_name AS object_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def nested_relation_unnest(spark, sf):
    return extract.nested_relations(_nested(spark, sf), "answer", ["n_nationkey"])


@query("SELECT event_type AS class, 'k' AS attribute, false AS is_list FROM events GROUP BY 1 UNION ALL SELECT event_type, 'many', max(event_id % 100) = 99 FROM events GROUP BY 1")
def schema_inference(spark, sf):
    many = F.when(F.col("event_id") % 100 == 99, '["a", "b"]').otherwise("a")
    e = table(spark, sf, "events").select(F.col("event_type").alias("class"), F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("many"), many)).alias("attributes"))
    return extract.inferred_schema(e)


@query("SELECT class, count(*) AS n, count(DISTINCT text) AS distinct_texts FROM (SELECT 'Language' AS class, lang AS text FROM documents UNION ALL SELECT 'Source', source FROM documents UNION ALL SELECT '关系', '' FROM documents) GROUP BY class")
def extraction_summary(spark, sf):
    return extract.unnest(built_answers(spark, sf), "answer", ["doc"]).groupBy("class").agg(F.count("*").alias("n"), F.countDistinct("text").alias("distinct_texts"))


def wanted_of(words):
    """Phrases to look for in a chunk of ``words``: its very long words, each with the word after it; its first words, the first of them altered; and words that are absent."""
    pairs = F.filter(F.transform(words, lambda w, i: F.when((F.length(w) > 12) & (i + 1 < F.size(words)), F.concat(w, F.lit(" "), F.get(words, i + 1)))), lambda p: p.isNotNull())
    altered = F.when(F.size(words) > 3, F.array(F.concat(F.get(words, F.lit(0)), F.lit("s "), F.get(words, F.lit(1)), F.lit(" "), F.get(words, F.lit(2)), F.lit(" "), F.get(words, F.lit(3))))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_distinct(pairs), altered, F.array(F.lit("absent phrase")))


@query()
def align_extractions(spark, sf):
    d = spread(table(spark, sf, "documents").filter("doc_id is not null").select("doc_id", "text"))
    words = F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")  # a column of its own, or every use would split the text again
    c = chunks.sentence_chunks(d, "text", 1000).withColumn("_words", words).withColumn("wanted", wanted_of(F.col("_words")))
    a = align.align(c, "text", "wanted", tok_offset="tok_start", char_offset="char_start").select("doc_id", "chunk_id", F.explode("aligned").alias("a"))
    return a.select("doc_id", "chunk_id", "a.ord", "a.status", "a.char_start", "a.char_end")


ALIGN_SQL = """WITH e AS (SELECT event_id, event_type AS t, CAST(user_id AS VARCHAR) AS u, event_id % 3 AS k FROM events), l AS (SELECT *, length(t) AS n, length(u) AS m FROM e)
SELECT event_id, 0 AS ord, 'match_exact' AS status, 4 AS char_start, 4 + n + 7 AS char_end FROM l
UNION ALL SELECT event_id, 1, CASE k WHEN 0 THEN 'match_exact' WHEN 1 THEN 'match_lesser' ELSE 'match_fuzzy' END, CASE WHEN k = 2 THEN 4 + n + 1 ELSE 4 + n + 11 END, CASE k WHEN 0 THEN 4 + n + 16 + m WHEN 1 THEN 4 + n + 15 ELSE 4 + n + 30 + m END FROM l
UNION ALL SELECT event_id, 2, NULL, NULL, NULL FROM l"""


@query(ALIGN_SQL)
def align_statuses(spark, sf):
    """The <type> signal of user <id> reached gates; wanted: two words as they are; the user, the user under a wrong number, or words with one between them missing; nothing that is there."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("u"))
    text = F.concat(F.lit("The "), "event_type", F.lit(" signal of user "), "u", F.lit(" reached gates"))
    k = F.col("event_id") % 3
    second = F.when(k == 0, F.concat(F.lit("User "), "u")).when(k == 1, "user nobody").otherwise("signals of reached gate")
    rows = e.select("event_id", text.alias("text"), F.array(F.concat("event_type", F.lit(" Signal")), second, F.lit("absent")).alias("wanted"))
    return align.align(rows, "text", "wanted").select("event_id", F.explode("aligned").alias("a")).select("event_id", "a.ord", "a.status", "a.char_start", "a.char_end")


@query("""WITH s AS (SELECT event_id, user_id, CAST(event_id % 1000 AS INT) * 10 AS a FROM events), f AS (SELECT * FROM s WHERE event_id % 2 = 0)
SELECT event_id, user_id, a AS start, a + 8 AS "end", 0 AS pass FROM f
UNION ALL SELECT event_id, user_id, a + 5, a + 9, 1 FROM s x WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = x.user_id AND x.a + 5 < f.a + 8 AND f.a < x.a + 9)""")
def overlap_merge_two_pass(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", ((F.col("event_id") % 1000).cast("int") * 10).alias("a"))
    shape = lambda df, lo, hi, p: df.select("event_id", "user_id", (F.col("a") + lo).alias("start"), (F.col("a") + hi).alias("end"), F.lit(p).alias("pass"))
    return align.merge_two_passes(shape(e.filter("event_id % 2 = 0"), 0, 8, 0), shape(e.filter("event_id % 2 = 1"), 5, 9, 1), "user_id", "start", "end")


@query("""WITH s AS (SELECT user_id, event_id, CAST(event_id % 50 AS INT) AS a, CAST(event_id % 50 + 1 + event_id % 7 AS INT) AS b FROM events),
e AS (SELECT user_id, event_id, a AS pos, 'start' AS kind, 1 AS r, a - b AS w FROM s UNION ALL SELECT user_id, event_id, b, 'end', 0, b - a FROM s)
SELECT user_id, event_id, pos, kind, CAST(row_number() OVER (PARTITION BY user_id ORDER BY pos, r, w, event_id) AS INT) AS place FROM e""")
def highlight_events(spark, sf):
    a = (F.col("event_id") % 50).cast("int")
    s = table(spark, sf, "events").select("user_id", "event_id", a.alias("a"), (a + 1 + (F.col("event_id") % 7).cast("int")).alias("b"))
    return align.boundary_events(s, ["user_id"], "a", "b").select("user_id", "event_id", "pos", "kind", "place")


@query("SELECT page_id, starts_with(url, 'http://') OR starts_with(url, 'https://') AS is_url, split_part(url, '/', 1) AS bucket, substr(url, strpos(url, '/') + 1) AS key FROM pages")
def url_and_bucket(spark, sf):
    at = readers.bucket_and_key(F.col("url"), "main")
    return table(spark, sf, "pages").select("page_id", readers.is_url(F.col("url")).alias("is_url"), at["bucket"].alias("bucket"), at["key"].alias("key"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN 'ff' WHEN 1 THEN '中文' ELSE lang END AS decoded FROM documents")
def decode_cascade(spark, sf):
    raw = F.when(F.col("doc_id") % 3 == 2, F.unhex(F.lit("ff"))).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("D6D0CEC4"))).otherwise(F.encode("lang", "utf-8"))
    return table(spark, sf, "documents").select("doc_id", readers.decode_cascade(raw).alias("decoded"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey * 700 < 1024 THEN (l_partkey * 700) || ' B' WHEN l_partkey * 700 < 1048576 THEN printf('%.1f KB', l_partkey * 700 / 1024.0) ELSE printf('%.1f MB', l_partkey * 700 / 1048576.0) END AS size FROM lineitem")
def file_sizes(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.size_text(F.col("l_partkey") * 700).alias("size"))


@query(f"SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, text, role) - 1 AS INTEGER) AS segment, text AS content FROM conversations QUALIFY regexp_matches(coalesce(text, ''), '[^{WS}]')")
def parsed_segments(spark, sf):
    c = table(spark, sf, "conversations")
    parsed = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))), lambda x: F.struct(x["text"].alias("content"))).alias("segments"))
    return remote.segments(parsed, "conv_id")


@query("SELECT count(event_type) AS asked, count(DISTINCT event_type) AS distinct, 1 - count(DISTINCT event_type) / count(event_type) AS hit_rate FROM events")
def prompt_repeats(spark, sf):
    return extract.repeat_stats(table(spark, sf, "events").select(F.col("event_type").alias("prompt")))


@query("SELECT 2 * count(*) AS entities, count(*) AS relations FROM nation JOIN region ON n_regionkey = r_regionkey")
def nested_counts(spark, sf):
    return extract.flattened_counts(_nested(spark, sf), "answer")


@query("""WITH s AS (SELECT doc_id, text, CAST(doc_id % 400 AS INTEGER) AS a, CAST(doc_id % 400 + 5 AS INTEGER) AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(substr(text, greatest(0, a - 150) + 1, a - greatest(0, a - 150))) AS before, substr(text, a + 1, 5) AS inside, md5(substr(text, b + 1, 150)) AS after FROM s""")
def extraction_context(spark, sf):
    a = (F.col("doc_id") % 400).cast("int")
    d = table(spark, sf, "documents").filter("text is not null").select("doc_id", "text", a.alias("a"), (a + 5).alias("b"))
    return align.shown(d, "text", "a", "b").select("doc_id", F.md5("before").alias("before"), "inside", F.md5("after").alias("after"))


NEAR_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL), q AS (SELECT v AS q FROM v WHERE vec_id = (SELECT min(vec_id) FROM v WHERE len(list_filter(v, lambda x: x <> 0)) > 0)),
s AS (SELECT vec_id, list_cosine_similarity(v, q) AS score FROM v, q WHERE len(v) = len(q)) SELECT vec_id, round(score, 6) AS score FROM s WHERE NOT isnan(score) ORDER BY s.score DESC, vec_id LIMIT 10"""


@query(NEAR_SQL)
def nearest_vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.filter(F.exists("embedding", lambda x: x != 0)).orderBy("vec_id").first()  # one vector
    found = remote.similar_vectors(e, list(q.embedding), 10, "vec_id", "embedding")
    return found.select("vec_id", F.round("score", 6).alias("score"))
