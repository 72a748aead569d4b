"""Readers of files, datasets and stored rows."""

from __future__ import annotations

import csv
import io
import json
import xml.etree.ElementTree as ET
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S


def text_directory(spark: SparkSession, path: str, glob: str = "*.{md,txt}") -> DataFrame:
    """file_name, text of the files of one directory (not below it)."""
    return spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(path).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def files(spark: SparkSession, path: str, *, content: bool = True, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length and, if asked for, content."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    r = r.option("pathGlobFilter", glob) if glob else r
    out = r.load(path)
    return out if content else out.drop("content")


def file_info(found: DataFrame) -> DataFrame:
    """path, file_name, extension, size, modified."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return found.select("path", name.alias("file_name"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("extension"), F.col("length").alias("size"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("modified"))


def storage_stats(found: DataFrame) -> DataFrame:
    """files, bytes, directories."""
    parent = F.regexp_replace("path", r"/[^/]*$", "")
    return found.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"), F.countDistinct(parent).alias("directories"))


def bucket_and_key(path: Column, default: str) -> Column:
    """struct(bucket, key): the part before the first slash, or the default bucket."""
    has = F.contains(path, F.lit("/"))
    return F.struct(F.when(has, F.substring_index(path, "/", 1)).otherwise(default).alias("bucket"), F.when(has, F.regexp_replace(path, "^[^/]*/", "")).otherwise(path).alias("key"))


def _decode(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    for encoding in ("utf-8", "gbk"):
        try:
            return bytes(raw).decode(encoding)
        except UnicodeDecodeError:
            pass
    return bytes(raw).hex()


@F.pandas_udf(T.StringType())
def _decode_rest(raw: pd.Series) -> pd.Series:
    return raw.map(_decode)


def decode_cascade(raw: Column) -> Column:
    """UTF-8, else GBK, else hexadecimal digits. Valid UTF-8 never leaves the JVM."""
    as_text = F.try_validate_utf8(raw.cast("string"))
    return F.coalesce(as_text, F.when(raw.isNotNull() & as_text.isNull(), _decode_rest(raw)))


def _plain(raw: bytes) -> str:
    for encoding in ("utf-8", "gbk", "latin-1"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            pass
    return raw.decode("utf-8", "replace")


def csv_dataset(spark: SparkSession, path: str, text_key: str, id_key: str, delimiter: str = ",") -> DataFrame:
    """document_id, text; both as text. Other file types are not read; an empty file is an error."""
    if not path.rstrip("/").lower().endswith(".csv"):
        raise NotImplementedError("only CSV datasets are read")
    rows = spark.read.option("header", True).option("sep", delimiter).option("multiLine", True).option("escape", '"').csv(path)
    if not {text_key, id_key} <= set(rows.columns):
        raise ValueError("the dataset is empty or lacks its text or id column")
    return rows.select(F.col(f"`{id_key}`").alias("document_id"), F.col(f"`{text_key}`").alias("text"))


def annotated(spark: SparkSession, path: str) -> DataFrame:
    """Annotated documents of JSON lines; blank lines do not count."""
    return spark.read.schema(S.ANNOTATED).json(path)


def graph_json(spark: SparkSession, path: str, tag: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graph files {"nodes": [...], "edges": [...]}."""
    node = "struct<node_id:string,node_name:string,node_type:string,description:string,filename:array<string>,properties:map<string,string>>"
    edge = "struct<source_id:string,target_id:string,relation_type:string,weight:double,bidirectional:boolean,properties:map<string,string>>"
    raw = spark.read.option("multiLine", True).schema(f"nodes array<{node}>, edges array<{edge}>").json(path)
    n = raw.select(F.posexplode("nodes").alias("ord", "n")).select(F.lit(tag).alias("graph_tag"), "n.node_id", "n.node_name", "n.node_type", "n.description", F.col("n.properties").alias("props"), "n.filename", F.array().cast("array<string>").alias("graph_level"), "ord")
    e = raw.select(F.posexplode("edges").alias("ord", "e")).select(F.lit(tag).alias("graph_tag"), "e.source_id", "e.relation_type", "e.target_id", F.coalesce("e.weight", F.lit(1.0)).alias("weight"), F.coalesce("e.bidirectional", F.lit(False)).alias("bidirectional"), F.col("e.properties").alias("props"), F.array().cast("array<string>").alias("filename"), F.array().cast("array<string>").alias("graph_level"), "ord")
    return n, e


def prompt_template(path: str) -> dict:
    """description and examples of a JSON or YAML file."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return yaml.safe_load(f)
        return json.load(f)


def is_url(text: Column) -> Column:
    return text.startswith("http://") | text.startswith("https://")


def fetched(rows: DataFrame, fetch: Callable[[str], bytes], url_col: str = "url") -> DataFrame:
    """Every row with ``content`` and ``error``; ``fetch`` runs on the executors."""

    def run(frames):
        for f in frames:
            got, problems = [], []
            for u in f[url_col]:
                try:
                    got.append(_plain(fetch(u)))
                    problems.append(None)
                except Exception as e:
                    got.append(None)
                    problems.append(str(e))
            yield f.assign(content=got, error=problems)

    return rows.mapInPandas(run, f"{rows.schema.simpleString()[7:-1]},content:string,error:string")


# file formats: content to text

Processor = Callable[[bytes], str]


def text_of_csv(raw: bytes, most: int = 101) -> str:
    """Header line, rule, and at most ``most`` rows, cells joined by bars."""
    text = _plain(raw)
    try:
        sniffed = csv.Sniffer().sniff(text[:1024])
    except csv.Error:
        return text
    rows = list(csv.reader(io.StringIO(text), sniffed))
    if not rows:
        return ""
    out = [f"CSV表头: {' | '.join(rows[0])}", "-" * 50, *(" | ".join(r) for r in rows[1 : most + 1])]
    return "\n".join(out + ["..."] * (len(rows) - 1 > most))


def text_of_json(raw: bytes) -> str:
    text = _plain(raw)
    try:
        data = json.loads(text)
    except ValueError as e:
        return f"JSON解析错误: {e}\n{text}"
    head = [f"JSON类型: {type(data).__name__}"]
    if isinstance(data, dict):
        head += [f"键数量: {len(data)}", f"键: {', '.join(list(map(str, data))[:10])}"]
    elif isinstance(data, list):
        head += [f"元素数量: {len(data)}"]
    return "\n".join([*head, json.dumps(data, ensure_ascii=False, indent=2)])


def text_of_xml(raw: bytes) -> str:
    root = ET.fromstring(raw)
    out = [f"XML根元素: {root.tag}"] + [f"属性: {root.attrib}"] * bool(root.attrib)
    stack = [(root, 0)]
    while stack:
        e, depth = stack.pop()
        text = (e.text or "").strip()
        if text:
            out.append(f"{'  ' * depth}{e.tag}: {text}")
        stack += [(c, depth + 1) for c in reversed(list(e))]
    return "\n".join(out)


def text_of_yaml(raw: bytes) -> str:
    import yaml

    data = yaml.safe_load(_plain(raw))
    return f"YAML类型: {type(data).__name__}\n{yaml.safe_dump(data, allow_unicode=True, sort_keys=False)}"


def text_of_word(raw: bytes) -> str:
    from docx import Document

    d = Document(io.BytesIO(raw))
    cells = [" | ".join(c.text.strip() for c in r.cells if c.text.strip()) for t in d.tables for r in t.rows]
    return "\n".join([p.text for p in d.paragraphs if p.text.strip()] + [c for c in cells if c])


def text_of_excel(raw: bytes) -> str:
    out = []
    for name, sheet in pd.read_excel(io.BytesIO(raw), sheet_name=None).items():
        head = " | ".join(map(str, sheet.columns))
        out += [f"工作表: {name}", head, "-" * len(head), *(" | ".join("" if pd.isna(x) else str(x) for x in r) for r in sheet.itertuples(index=False))]
    return "\n".join(out)


def text_of_slides(raw: bytes) -> str:
    from pptx import Presentation

    out = []
    for k, slide in enumerate(Presentation(io.BytesIO(raw)).slides, 1):
        out += [f"幻灯片 {k}:", *(s.text for s in slide.shapes if getattr(s, "text", "").strip())]
    return "\n".join(out)


def text_of_image(raw: bytes) -> str:
    from PIL import Image

    im = Image.open(io.BytesIO(raw))
    alpha = im.mode in ("RGBA", "LA") or "transparency" in im.info
    return f"图片: {im.format} {im.width}x{im.height} {im.mode} {len(raw)} bytes transparency={alpha}"


PROCESSORS: dict[str, Processor] = {
    **dict.fromkeys((".txt", ".md"), _plain),
    ".csv": text_of_csv,
    ".json": text_of_json,
    ".xml": text_of_xml,
    **dict.fromkeys((".yaml", ".yml"), text_of_yaml),
    **dict.fromkeys((".doc", ".docx"), text_of_word),
    **dict.fromkeys((".xls", ".xlsx"), text_of_excel),
    **dict.fromkeys((".ppt", ".pptx"), text_of_slides),
    **dict.fromkeys((".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff"), text_of_image),
}


def register(extension: str, processor: Processor) -> None:
    PROCESSORS[extension.lower()] = processor


def processors(spark: SparkSession) -> DataFrame:
    """processor, extensions of the registry."""
    return spark.createDataFrame([(e, p.__name__.strip("_")) for e, p in PROCESSORS.items()], "extension string, processor string").groupBy("processor").agg(F.sort_array(F.collect_list("extension")).alias("extensions"))


def processed(found: DataFrame) -> DataFrame:
    """A result row a file (path, content): its text, or why there is none. Files that fail do not stop others."""
    registry = dict(PROCESSORS)

    def run(frames):
        for f in frames:
            rows = []
            for path, raw in zip(f["path"], f["content"]):
                ext = "." + path.rpartition("/")[2].rpartition(".")[2].lower()
                problem, text = None, None
                if raw is None or not len(raw):
                    problem = "the file is empty"
                elif ext not in registry:
                    problem = f"no processor for {ext}"
                else:
                    try:
                        text = registry[ext](bytes(raw))
                    except Exception as e:
                        problem = f"{type(e).__name__}: {e}"
                rows.append((path, ext, problem is None, text, {"size": str(0 if raw is None else len(raw))}, problem))
            yield pd.DataFrame(rows, columns=["path", "file_type", "success", "extracted_text", "metadata", "error_message"])

    return found.select("path", "content").mapInPandas(run, S.PROCESSED)
