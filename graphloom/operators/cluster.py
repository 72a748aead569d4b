"""Fuzzy matching of names, and clustering and fusing of entities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import fused_id
from ..functions.similarity import length_bound, name_similarity, ratio_udf
from ..functions.text import entity_name
from ..session import materialise

#: Properties that tell entities of one name apart, by type; fixed values.
DISAMBIGUATORS = {
    "人": ["单位", "公司", "组织", "职位", "部门", "地区", "团队"],
    "组织": ["地区", "地址", "上级机构", "类型", "行业", "总部"],
    "公司": ["地区", "地址", "总部地址", "注册地", "行业"],
    "产品": ["型号", "制造商", "版本", "系列", "规格"],
    "设备": ["型号", "制造商", "所属生产线", "编号", "序列号"],
    "生产线": ["所属工厂", "车间", "地点", "编号"],
}
OTHER_DISAMBIGUATORS = ["类型", "分类", "类别"]


def _without_one(name: str) -> Column:
    """A name, and the name less each of its characters."""
    c = F.col(name)
    return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda k: F.concat(F.substring(c, F.lit(1), k - 1), F.substring(c, k + 1, F.length(c))))))


def _best(pairs: DataFrame, threshold: float) -> DataFrame:
    """target, name, score of the best of each target's pairs (target, name, ord)."""
    spread = pairs.repartition(F.xxhash64("target", "name"))  # a few targets may have most of the pairs
    scored = spread.withColumn("score", ratio_udf("target", "name")).filter(F.col("score") >= threshold)
    return scored.groupBy("target").agg(F.min_by(F.struct("name", "score"), F.struct(-F.col("score"), F.col("ord"))).alias("b")).select("target", "b.*")


def best_match(targets: DataFrame, candidates: DataFrame, threshold: float = 0.9) -> DataFrame:
    """target, name, score: each target's most similar candidate (the first on ties) from ``threshold`` on.

    A target that is a candidate itself is its own best match and meets no
    other. Others first meet the candidates from which they differ by one
    character at most on either side, by an equality join of names less one
    character. A target of n characters whose best score there is over
    n / (n + 1) is settled, since no other candidate can reach that. Only the
    rest meet all candidates of a length that can reach the threshold, less
    those that the edit distance, an exact bound, rules out.
    """
    every = targets.select("target").distinct()
    known = candidates.select(F.col("name").alias("target")).distinct()
    same = every.join(known, "target", "left_semi").select("target", F.col("target").alias("name"), F.lit(1.0).alias("score"))
    t = every.join(known, "target", "left_anti")
    c = candidates.groupBy("name").agg(F.min("ord").alias("ord"))
    short = t.select("target", F.explode(_without_one("target")).alias("_v")).join(c.select("name", "ord", F.explode(_without_one("name")).alias("_v")), "_v")
    close = materialise(_best(short.select("target", "name", "ord").distinct(), threshold), "fuzzy-close")
    n = F.length("target")
    settled = close.filter(F.col("score") > n / (n + 1))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    span = F.sequence(F.floor(n * low).cast("int"), F.ceil(n * high).cast("int"))
    open_ = t.join(settled.select("target"), "target", "left_anti").withColumn("_n", F.explode(span))
    near = open_.join(c.withColumn("_n", F.length("name")), "_n").filter(length_bound(F.col("target"), F.col("name")) >= threshold)
    # matching blocks leave (1 - ratio) of the characters unmatched, and these edits turn one name into the other
    near = near.filter(F.levenshtein("target", "name") <= (1 - threshold) * (F.length("target") + F.length("name")) + 1e-9)
    return same.unionByName(settled).unionByName(_best(near.select("target", "name", "ord"), threshold))


def disambiguator(type_: Column, props: Column) -> Column:
    """The first property that tells entities of this type apart, at most 30 characters; '' if there is none."""

    def pick(fields):
        return F.coalesce(*[F.nullif(F.regexp_replace(props[k], r"(?U)^\s+|\s+$", ""), F.lit("")) for k in fields], F.lit(""))

    out = pick(OTHER_DISAMBIGUATORS)
    for kind, fields in DISAMBIGUATORS.items():
        out = F.when(type_ == kind, pick(fields)).otherwise(out)
    return F.substring(out, 1, 30)


def should_merge(name_a: str, name_b: str, dis_a: str, dis_b: str) -> bool:
    """Whether two entities are one: names alike and neither told apart, or told alike."""
    s = name_similarity(name_a, name_b)
    if s < 0.90 or bool(dis_a) != bool(dis_b):
        return False
    return dis_a == dis_b or (s >= 0.95 and name_similarity(dis_a, dis_b) >= 0.80)


def clusters(entities: DataFrame) -> DataFrame:
    """Entities (type, name, props, ord) with ``cluster``, the ord of their leader: the first entity that no earlier one has taken, compared with leaders only.

    The rule depends on the order of all entities of a type. Equal normal names
    with equal disambiguators always merge, so they are reduced to their first
    before a type's names meet in one task.
    """
    rows = entities.withColumn("_norm", entity_name(F.col("name"), F.col("type"))).withColumn("_dis", disambiguator(F.col("type"), F.col("props")))
    small = rows.groupBy("type", "_norm", "_dis").agg(F.min("ord").alias("ord"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("ord")
        leaders: list[tuple[str, str, int]] = []
        out = []
        for norm, dis, o in zip(f["_norm"], f["_dis"], f["ord"]):
            found = next((k for n, d, k in leaders if should_merge(n, norm, d, dis)), None)
            if found is None:
                leaders.append((norm, dis, o))
                found = o
            out.append(found)
        return f.assign(cluster=out)

    named = small.groupBy("type").applyInPandas(run, "type string, _norm string, _dis string, ord long, cluster long").drop("ord")
    return rows.join(named, ["type", "_norm", "_dis"]).drop("_norm", "_dis")


def fuse(clustered: DataFrame) -> DataFrame:
    """type, name, id, source_count, cluster: the longest name (the first on ties) of each cluster."""
    name = F.min_by("name", F.struct(-F.length("name"), F.col("ord")))
    return clustered.groupBy("type", "cluster").agg(name.alias("name"), F.count("*").alias("source_count")).withColumn("id", fused_id(F.col("type"), F.col("name")))


def fuse_properties(clustered: DataFrame) -> DataFrame:
    """type, cluster, key, value: the most frequent value of each property, the first seen on ties; empty values do not count."""
    each = clustered.select("type", "cluster", "ord", F.explode("props").alias("key", "value")).filter("value is not null and value <> ''")
    n = each.groupBy("type", "cluster", "key", "value").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    w = Window.partitionBy("type", "cluster", "key").orderBy(F.desc("n"), "first")
    return n.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select("type", "cluster", "key", "value")


def entity_mapping(clustered: DataFrame) -> DataFrame:
    """type, name, id of the fused entity; if a name is in several clusters, the last one's."""
    ids = fuse(clustered).select("type", "cluster", "id")
    return clustered.join(ids, ["type", "cluster"]).groupBy("type", "name").agg(F.max_by("id", "cluster").alias("id"))
