"""Prompts, models, and the parsing of what models answer."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import first_filled
from .client import wait_after

Model = Callable[[list[str]], list[str]]


# prompts


def example_answer(extractions: list[dict], fmt: str = "json", fence: bool = False, suffix: str = "_attributes") -> str:
    """One example's answer: {"extractions": [{class: text, class_attributes: {...}}]}, as JSON with escaped non-ASCII or YAML."""
    data = {"extractions": [{e["class"]: e["text"], e["class"] + suffix: e.get("attributes") or {}} for e in extractions]}
    if fmt == "yaml":
        import yaml

        body = yaml.safe_dump(data, sort_keys=False, default_flow_style=False).strip()
    else:
        body = json.dumps(data, indent=2)
    return f"```{fmt}\n{body}\n```" if fence else body


def usable_examples(examples: list[dict]) -> list[dict]:
    """Examples with a text and at least one extraction that has a class or a text."""
    out = []
    for x in examples or []:
        if isinstance(x, dict) and str(x.get("text") or "").strip():
            found = [e for e in x.get("extractions") or [] if isinstance(e, dict) and (str(e.get("class") or "").strip() or str(e.get("text") or "").strip())]
            if found:
                out.append({"text": x["text"], "extractions": found})
    return out


def prompt(text: Column, description: str, examples: list[dict] = (), context: Column | None = None, fmt: str = "json", fence: bool = False) -> Column:
    """Few-shot prompt: description, context, examples as Q/A blocks, question. The part that all rows share is built once."""
    head = description.rstrip("\n") + "\n"
    shots = "".join(f"Q: {x['text']}\nA: {example_answer(x['extractions'], fmt, fence)}\n\n" for x in usable_examples(list(examples)))
    shots = f"\nExamples\n{shots}" if shots else "\n"
    middle = F.when(context.isNotNull(), F.concat(F.lit("\n"), context, F.lit("\n"))).otherwise(F.lit("")) if context is not None else F.lit("")
    return F.concat(F.lit(head), middle, F.lit(shots + "Q: "), F.coalesce(text, F.lit("")), F.lit("\nA: "))


def route(text: Column, threshold: int = 3000) -> Column:
    """Long texts are extracted in one shot by chunks, short ones in two steps."""
    return F.when(F.length(text) > threshold, "oneshot").otherwise("twostep")


# models


def infer(rows: DataFrame, model: Model, prompt_col: str = "prompt", out_col: str = "answer", *, batch: int = 16, retries: int = 3, wait: float = 0.0) -> DataFrame:
    """Every row with the model's answer and ``error`` (null if none). Order and rows are kept; a batch that fails is tried again, then row by row; ``wait`` seconds before the second attempt, then twice as long each time, and longer if the service limits rates."""
    schema = f"{rows.select('*').schema.simpleString()[7:-1]},{out_col}:string,error:string"

    def answers(prompts: list[str]) -> list[tuple[str | None, str | None]]:
        for k in range(retries):
            try:
                return [(a, None) for a in model(prompts)]
            except Exception as e:
                problem = str(e)
                if wait and k + 1 < retries:
                    time.sleep(wait_after(k, problem, wait))
        if len(prompts) == 1:
            return [(None, problem)]
        return [answers([p])[0] for p in prompts]

    def run(frames: Iterator[pd.DataFrame]):
        for f in frames:
            found = []
            for k in range(0, len(f), batch):
                found += answers([str(p) for p in f[prompt_col].iloc[k : k + batch]])
            yield f.assign(**{out_col: [a for a, _ in found], "error": [e for _, e in found]})

    return rows.mapInPandas(run, schema)


class RuleModel:
    """A deterministic model for tests: capitalised words of the question are names, neighbours in a sentence are related."""

    def __init__(self, class_: str = "Name", relation: str = "near"):
        self.class_, self.relation = class_, relation

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            text = p.rpartition("Q: ")[2].removesuffix("\nA: ")
            items = []
            for sentence in re.split(r"[.?!\n]", text):
                names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]+", sentence)))
                items += [{self.class_: n, f"{self.class_}_attributes": {"length": str(len(n))}} for n in names]
                items += [{S.RELATION_CLASS: "", f"{S.RELATION_CLASS}_attributes": {S.SUBJECT_KEYS[0]: a, S.PREDICATE_KEYS[0]: self.relation, S.OBJECT_KEYS[0]: b}} for a, b in zip(names, names[1:])]
            out.append(json.dumps({"extractions": items}, ensure_ascii=False))
        return out


class TableModel:
    """Replays stored answers by prompt."""

    def __init__(self, answers: dict[str, str], default: str = '{"extractions": []}'):
        self.answers, self.default = answers, default

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self.answers.get(p, self.default) for p in prompts]


class FaultyModel:
    """Answers with every kind of malformed output in turn."""

    KINDS = ["not json", "[1]", '{"other": []}', '{"extractions": [1]}', '{"extractions": [{"a": "b", "a_attributes": "c"}]}']

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self.KINDS[k % len(self.KINDS)] for k in range(len(prompts))]


# answers


def unfence(answer: Column, fmt: str = "json") -> Column:
    """The part between the first fence that opens ``fmt`` and the last fence; the whole answer if there is none."""
    inner = F.regexp_extract(answer, f"(?s)```{fmt}(.*)```", 1)
    return F.when(inner != "", inner).otherwise(answer)


def _json_of_yaml(answer: str | None) -> str | None:
    import yaml

    try:
        return None if answer is None else json.dumps(yaml.safe_load(answer), ensure_ascii=False, default=str)
    except (yaml.YAMLError, ValueError, TypeError):
        return None


def as_json(answer: Column, fmt: str = "json") -> Column:
    """An answer as plain JSON: fences gone, YAML turned into JSON (null if it is not YAML)."""
    if fmt == "json":
        return unfence(answer)
    if fmt != "yaml":
        raise ValueError("answers are JSON or YAML")

    @F.pandas_udf("string")
    def turned(x: pd.Series) -> pd.Series:
        return pd.Series([_json_of_yaml(v) for v in x], dtype=object)

    return turned(unfence(answer, "yaml"))


def parse(answer: Column) -> Column:
    """array<map<string,string>> of the groups; null if the answer is not an object with a list of objects as ``extractions``."""
    return F.from_json(answer, "extractions array<map<string,string>>")["extractions"]


def fault(answer: Column, suffix: str = "_attributes") -> Column:
    """Why an answer is unusable, or null."""
    v = F.try_parse_json(answer)
    kind = lambda path: F.try_variant_get(v, path, "variant")
    top = F.schema_of_variant(v)
    items = F.schema_of_variant(kind("$.extractions"))
    groups = parse(answer)
    bad = F.exists(F.coalesce(groups, F.array().cast("array<map<string,string>>")), lambda m: F.exists(F.map_entries(m), lambda e: F.endswith(e["key"], F.lit(suffix)) & e["value"].isNotNull() & ~e["value"].rlike(r"^\s*\{")))
    return (
        F.when(answer.isNull() | v.isNull(), "not json")
        .when(~top.startswith("OBJECT"), "not an object")
        .when(items.isNull(), "no extractions")
        .when(~items.startswith("ARRAY"), "extractions is not a list")
        .when(~items.rlike(r"^ARRAY<(OBJECT|VOID)"), "an extraction is not an object")
        .when(bad, "attributes are not an object")
    )


def unnest(rows: DataFrame, answer_col: str, keys: list[str], *, suffix: str = "_attributes", index_suffix: str | None = None) -> DataFrame:
    """A row an extraction: keys, class, text, attributes (map), extraction_index, group_index.

    Without an index suffix the index counts from 1 in the order of the answer;
    with one, it is the class's index entry, and extractions without go.
    """
    groups = rows.select(*keys, F.posexplode(parse(F.col(answer_col))).alias("group_index", "m"))
    items = groups.select(*keys, "group_index", "m", F.posexplode(F.map_entries("m")).alias("pos", "e"))
    items = items.filter(~F.endswith("e.key", F.lit(suffix)))
    if index_suffix:
        items = items.filter(~F.endswith("e.key", F.lit(index_suffix)))
    text = F.coalesce(F.col("e.value"), F.lit("None"))
    text = F.when(F.col("e.value") == "true", "True").when(F.col("e.value") == "false", "False").otherwise(text)
    attributes = F.from_json(F.col("m")[F.concat(F.col("e.key"), F.lit(suffix))], "map<string,string>")
    out = items.select(*keys, "group_index", "pos", F.col("e.key").alias("class"), text.alias("text"), attributes.alias("attributes"), *([F.col("m")[F.concat(F.col("e.key"), F.lit(index_suffix))].try_cast("int").alias("extraction_index")] if index_suffix else []))
    if index_suffix:
        return out.filter("extraction_index is not null").drop("pos")
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy(*keys).orderBy("group_index", "pos"))
    return out.withColumn("extraction_index", number).drop("pos")


def entities(extractions: DataFrame, *, allow_blank: bool = True) -> DataFrame:
    """Extractions that name an entity; blank texts count only where relations are extracted along."""
    keep = (F.col("class") != S.RELATION_CLASS) & (F.coalesce("class", F.lit("")) != "")
    return extractions.filter(keep if allow_blank else keep & (F.coalesce("text", F.lit("")) != ""))


def relations(extractions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source, type, target of the relation extractions, with fallback keys; incomplete ones go."""
    a = F.col("attributes")
    found = extractions.filter(F.col("class") == S.RELATION_CLASS).select(*keys, first_filled(a, S.SUBJECT_KEYS).alias("source"), first_filled(a, S.PREDICATE_KEYS).alias("type"), first_filled(a, S.OBJECT_KEYS).alias("target"))
    return found.dropna(subset=["source", "type", "target"])


def normalised_example(props: Column) -> Column:
    """struct(subject, predicate, object) of an example's attributes, with the wider fallbacks."""
    return F.struct(first_filled(props, S.EXAMPLE_SUBJECT_KEYS).alias("subject"), first_filled(props, S.EXAMPLE_PREDICATE_KEYS).alias("predicate"), first_filled(props, S.EXAMPLE_OBJECT_KEYS).alias("object"))


NESTED = "entities map<string,map<string,map<string,string>>>, relations map<string,array<struct<subject:map<string,string>,object:map<string,string>>>>"


def strip_markdown(answer: Column) -> Column:
    return F.regexp_replace(answer, r"(?m)^```(json)?\s*$\n?", "")


def nested_entities(rows: DataFrame, answer_col: str, keys: list[str]) -> DataFrame:
    """keys, type, name, props of answers that nest entities by type and name."""
    e = rows.select(*keys, F.from_json(strip_markdown(F.col(answer_col)), NESTED)["entities"].alias("e"))
    by_type = e.select(*keys, F.explode("e").alias("type", "named"))
    return by_type.select(*keys, "type", F.explode("named").alias("name", "props"))


def nested_relations(rows: DataFrame, answer_col: str, keys: list[str]) -> DataFrame:
    """keys, type, and the subject's and object's type and name."""
    r = rows.select(*keys, F.from_json(strip_markdown(F.col(answer_col)), NESTED)["relations"].alias("r"))
    each = r.select(*keys, F.explode("r").alias("type", "list")).select(*keys, "type", F.explode("list").alias("x"))
    kind = lambda side: F.coalesce(F.nullif(F.col(f"x.{side}")["type"], F.lit("")), F.nullif(F.col(f"x.{side}")["label"], F.lit("")))
    name = lambda side: F.nullif(F.col(f"x.{side}")["name"], F.lit(""))
    return each.select(*keys, "type", kind("subject").alias("subject_type"), name("subject").alias("subject_name"), kind("object").alias("object_type"), name("object").alias("object_name"))


def flattened_counts(rows: DataFrame, answer_col: str) -> DataFrame:
    """entities, relations: what nested answers hold of all types together."""
    r = rows.select(F.from_json(strip_markdown(F.col(answer_col)), NESTED).alias("r"))
    total = lambda c: F.coalesce(F.aggregate(F.transform(F.map_values(f"r.{c}"), F.size), F.lit(0), lambda acc, n: acc + n), F.lit(0))
    return r.agg(F.coalesce(F.sum(total("entities")), F.lit(0)).alias("entities"), F.coalesce(F.sum(total("relations")), F.lit(0)).alias("relations"))


def remembered(rows: DataFrame, model: Model, prompt_col: str = "prompt", **options) -> DataFrame:
    """As :func:`infer`, but equal prompts are asked once."""
    asked = infer(rows.select(prompt_col).distinct(), model, prompt_col, **options)
    return rows.join(asked, prompt_col)


def repeat_stats(rows: DataFrame, prompt_col: str = "prompt") -> DataFrame:
    """asked, distinct, hit_rate: how many prompts need no call of their own."""
    out = rows.agg(F.count(prompt_col).alias("asked"), F.countDistinct(prompt_col).alias("distinct"))
    return out.withColumn("hit_rate", F.when(F.col("asked") > 0, 1 - F.col("distinct") / F.col("asked")).otherwise(0.0))


def inferred_schema(attributes: DataFrame) -> DataFrame:
    """class, attribute, is_list: what examples (class, attributes map<string,string>) say of each class."""
    each = attributes.select("class", F.explode("attributes").alias("attribute", "value"))
    return each.groupBy("class", "attribute").agg(F.max(F.col("value").rlike(r"^\s*\[")).alias("is_list"))
