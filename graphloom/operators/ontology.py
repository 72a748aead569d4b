"""Ontologies as prompt text, validation of inputs, noise and samples for tests."""

from __future__ import annotations

import hashlib
import json
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Worked examples of an extraction, for prompts that bring none.
EXAMPLES = [
    {"text": "Acme opened a plant in Lyon.", "extractions": [{"class": "Company", "text": "Acme", "attributes": {}}, {"class": "City", "text": "Lyon", "attributes": {"role": "site"}}]},
    {"text": "Dr. Weiss heads the clinic in Graz.", "extractions": [{"class": "Person", "text": "Dr. Weiss", "attributes": {"role": "head"}}, {"class": "City", "text": "Graz", "attributes": {}}]},
]

_templates: dict[str, str] = {}


def template(ontology: dict) -> tuple[str, str]:
    """(key, text) of an ontology {nodes: [{label, attr: [{label, type, description}]}], edges: [{label, source, target}]}; the key is a digest, and a text is built once."""
    key = hashlib.md5(json.dumps(ontology, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:8]
    if key not in _templates:
        ids = {n.get("id"): n.get("label", "") for n in ontology.get("nodes", [])}
        out = ["Entity types:"]
        for n in ontology.get("nodes", []):
            fields = [f"{a['label']} ({a.get('type', 'STRING')}): {a.get('description') or ''}".rstrip(": ") for a in n.get("attr", []) if a.get("label") not in ("nodeId", "nodeName")]
            out.append(f"- {n.get('label', '')}" + (f" [{'; '.join(fields)}]" if fields else ""))
        out.append("Relation types:")
        out += [f"- {e['label']}: {ids.get(e.get('source'), '')} -> {ids.get(e.get('target'), '')}" for e in ontology.get("edges", [])]
        _templates[key] = "\n".join(out)
    return key, _templates[key]


RULES = """Answer with JSON: {"entities": {type: {name: {attribute: value}}}, "relations": {type: [{"subject": {"name", "type"}, "object": {"name", "type"}}]}}.
Use only the types above. Give dates as YYYY-MM-DD. Leave out what the text does not say."""


#: Task descriptions where none is given; what a schema allows is put after them.
ENTITY_PROMPT = """Find the entities that the text names. Give each the most specific type, its name as the text has it, and the attributes that the text states. Do not guess, and do not name an entity twice."""
RELATION_PROMPT = """Find the relations between the entities that are listed. Give each as subject, predicate and object, all as the text has them. Leave out what the text does not state, and entities that are not listed."""
COMBINED_PROMPT = ENTITY_PROMPT + "\nThen find the relations between them: subject, predicate and object, as the text states them."
_DEFAULTS = {"entities": ENTITY_PROMPT, "relations": RELATION_PROMPT, "combined": COMBINED_PROMPT}


def description(kind: str, own: str | None = None, node_schema: str | None = None, edge_schema: str | None = None) -> str:
    """What a model is asked to do: the given words or the default ones, and the schema that its answer must keep to."""
    if kind not in _DEFAULTS:
        raise ValueError(f"kind must be one of {', '.join(_DEFAULTS)}")
    out = [(own or "").strip() or _DEFAULTS[kind]]
    if node_schema and kind != "relations":
        out.append(f"Entity types:\n{node_schema.strip()}")
    if edge_schema and kind != "entities":
        out.append(f"Relation types:\n{edge_schema.strip()}")
    return "\n\n".join(out)


def question(text: Column, ontology: dict, rules: str = RULES) -> Column:
    """A text with its ontology and the rules of the answer."""
    return F.concat(F.lit(template(ontology)[1] + "\n\n" + rules + "\n\nText:\n"), F.coalesce(text, F.lit("")))


def checked(rows: DataFrame, path_col: str, size_col: str, supported: list[str]) -> DataFrame:
    """Every row with ``success`` and ``error_message``: a path, a file that is not empty, a known extension."""
    ext = F.lower(F.regexp_extract(path_col, r"(\.[^.]*)$", 1))
    why = F.when(F.coalesce(path_col, F.lit("")) == "", "no path").when(F.col(size_col).isNull(), "no such file").when(F.col(size_col) == 0, "the file is empty").when(~ext.isin(supported), F.concat(F.lit("unsupported: "), ext))
    return rows.withColumn("error_message", why).withColumn("success", F.col("error_message").isNull())


def envelope(code: int, data=None, msg: str = "") -> dict:
    return {"code": code, "data": data, "msg": msg}


def perturbed(name: str, seed: int, edits: int = 1) -> str:
    """A name with characters replaced, dropped or added, for tests of matching."""
    rng = random.Random(f"{seed}:{name}")
    out = list(name)
    for _ in range(edits):
        k, how = rng.randrange(len(out) + 1), rng.choice(["replace", "drop", "add"])
        if how == "add" or not out:
            out.insert(k, rng.choice("abcdefghij"))
        elif how == "drop":
            out.pop(k % len(out))
        else:
            out[k % len(out)] = rng.choice("abcdefghij")
    return "".join(out)


def drawn(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, the same for the same seed."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
