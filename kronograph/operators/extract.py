"""Extraction and entity resolution (E1-E21, J6-J12, U5): rules as column expressions, pairs as keyed joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kronograph.functions.text import end_trimmed, first_match, similarity, words
from kronograph.sources.shared import written

#: Stop words of capitalised entities, relation keywords in order, and synonyms of relations.
STOP = ("The", "This", "That", "These", "Those", "And", "But", "For", "With", "From", "They", "When", "Where")
RELATIONS = ((("met",), "MEETS"), (("work",), "WORKS_WITH"), (("friend", "know"), "KNOWS"), (("manage", "lead"), "MANAGES"))
SYNONYMS = {
    "works_at": "employment", "employed_by": "employment", "works_for": "employment", "knows": "acquaintance", "friend_of": "acquaintance", "acquainted_with": "acquaintance",
    "located_in": "location", "based_in": "location", "lives_in": "location", "owns": "ownership", "has": "ownership", "possesses": "ownership",
}
#: Rules of the rule-based recogniser.
NER = {
    "Person": r"\b([A-Z][a-z]+ [A-Z][a-z]+)\b",
    "Organization": r"\b([A-Z][A-Za-z]* (?:Inc|Corp|LLC|Ltd|Company|University))\b",
    "Location": r"\b((?:San|New|Los) [A-Z][a-z]+)\b",
}
#: Surnames, endings of organisations and places of the rules for Han text.
SURNAMES = "张王李赵刘陈杨黄周吴徐孙马朱胡郭何罗高林郑梁谢唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃河汤滕殷毕詹关鲁"
HAN_ORGANISATIONS = ("公司", "集团", "机构", "组织", "协会", "委员会", "部门", "中心", "研究院", "大学", "学院", "医院", "银行", "酒店", "商场", "超市", "餐厅", "工厂", "企业", "政府", "局", "厅", "处", "科", "股份", "有限", "责任", "国际")
HAN_PLACES = (
    "北京", "上海", "广州", "深圳", "天津", "重庆", "成都", "杭州", "武汉", "西安", "苏州", "南京", "郑州", "长沙", "东莞", "沈阳", "青岛", "合肥", "佛山", "山东", "江苏", "广东", "浙江", "河南", "河北", "湖南", "湖北",
    "福建", "安徽", "辽宁", "陕西", "内蒙古", "新疆", "广西", "宁夏", "西藏", "香港", "澳门", "台湾", "中国", "美国", "日本", "韩国", "英国", "法国", "德国", "俄罗斯", "加拿大", "澳大利亚",
)
HAN = {"Person": f"([{SURNAMES}][\u4e00-\u9fa5])", "Organization": f"([\u4e00-\u9fa5]+(?:{'|'.join(HAN_ORGANISATIONS)}))", "Location": f"({'|'.join(HAN_PLACES)})"}
RULES = [*NER.items(), *HAN.items()]
#: What may be an entity before it is classified.
CANDIDATES = (
    r"\b([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)\b", "([\u4e00-\u9fff]{2,4})", r'"([^"]+)"', "'([^']+)'", r"\b((?:Mr|Mrs|Ms|Dr|Prof)\.?\s+[A-Z][a-z]+)",
)


def capitalised(text: Column) -> Column:
    """Distinct capitalised words of more than two bytes, without stop words, ascending."""
    w = F.transform(words(text), end_trimmed)
    return F.array_sort(F.array_distinct(F.filter(w, lambda x: x.rlike("^[A-Z]") & (F.octet_length(x) > 2) & ~x.isin(*STOP))))


def relation_of(text: Column) -> Column:
    """Relation between entities of one text by ordered keywords."""
    t = F.lower(text)
    rules = []
    for keys, name in RELATIONS:
        hit = t.contains(keys[0])
        for k in keys[1:]:
            hit = hit | t.contains(k)
        rules.append((hit, name))
    return first_match(rules, "RELATED_TO")


def mention_pairs(names: Column) -> Column:
    """All pairs i < j of an array."""
    n = F.size(names)
    return F.flatten(F.transform(names, lambda a, i: F.transform(F.slice(names, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def ner(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, label, score) of each rule's matches (E1); words end where Unicode says so, as in spans()."""
    def found(label, rule):
        return F.transform(F.regexp_extract_all(text_col, F.lit("(?U)" + rule), 1), lambda m: F.struct(m.alias("text"), F.lit(label).alias("label")))

    rows = F.flatten(F.array(*(found(label, rule) for label, rule in RULES)))
    return df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(rows)).alias("e")).select("id", "e.text", "e.label", F.lit(0.8).alias("score"))


def spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, label, score, start, end) with character spans, overlaps merged greedily (E1, E3): an Arrow map, as Catalyst has no match offsets."""
    import re

    rules = [(label, re.compile(rule)) for label, rule in RULES]

    def run(batches):
        for pdf in batches:
            out = []
            for key, text in zip(pdf[id_col], pdf[text_col]):
                found = sorted({(m.start(1), m.end(1), m[1], label) for label, rule in rules for m in rule.finditer(text or "")})
                kept: list[tuple] = []
                for s in found:
                    if not any(min(s[1], k[1]) - max(s[0], k[0]) > 0.7 * min(s[1] - s[0], k[1] - k[0]) for k in kept):
                        kept.append(s)
                out += [(key, t, label, 0.8, a, b) for a, b, t, label in kept]
            yield pd.DataFrame(out, columns=["id", "text", "label", "score", "start", "end"])

    return df.select(id_col, text_col).mapInPandas(run, "id bigint, text string, label string, score double, start bigint, end bigint")


def candidates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): distinct phrases that may be entities: capitalised words, Han words, quoted text, titles."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text_col, F.lit("(?U)" + rule), 1) for rule in CANDIDATES)))
    return df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(found)).alias("text"))


def classified(phrases: DataFrame, prototypes: DataFrame, least: float = 0.6) -> DataFrame:
    """(id, text, label, score) of phrases by the nearest prototype, from a cosine of least on.

    phrases: id, text, embedding; prototypes: label, embedding, a row or a few for each label.
    """
    from kronograph.functions.vectors import cosine

    p = F.broadcast(prototypes.select("label", F.col("embedding").alias("_to")))  # a constant set of labels
    scored = phrases.crossJoin(p).withColumn("score", cosine(F.col("embedding"), F.col("_to")))
    best = scored.groupBy("id", "text").agg(F.min_by(F.struct("label", "score"), F.struct(-F.col("score"), "label")).alias("b"))
    return best.select("id", "text", "b.label", "b.score").filter(F.col("score") >= least)


def entity_similarity(name: Column, same_type: Column, semantic: Column | None = None) -> Column:
    """0.5 name + 0.2 same type + 0.3 semantic similarity; the name stands in where there is none (E5)."""
    return 0.5 * name + 0.2 * same_type.cast("double") + 0.3 * (F.coalesce(semantic, name) if semantic is not None else name)


def merge_relations(df: DataFrame) -> DataFrame:
    """Relations with one normalised key become one: first names, highest confidence, distinct descriptions in order.

    df: ord, source, target, relation, confidence, description.
    """
    key = [F.lower(F.trim(c)).alias(f"_{c}") for c in ("source", "target", "relation")]
    g = df.select("*", *key).groupBy("_source", "_target", "_relation")
    texts = F.array_sort(F.collect_list(F.struct("ord", "description")))
    joined = F.aggregate(texts, F.lit(""), lambda acc, t: F.when(acc == "", t["description"]).when(acc.contains(t["description"]), acc).otherwise(F.concat(acc, F.lit("; "), t["description"])))
    return g.agg(*(F.min_by(c, "ord").alias(c) for c in ("source", "target", "relation")), F.max("confidence").alias("confidence"), joined.alias("description")).drop("_source", "_target", "_relation")


def resolve_endpoints(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Names of relations replaced by ids of entities (J6): two equi-joins on the folded name; unknown names drop out."""
    ids = entities.groupBy(F.lower(F.trim("name")).alias("_n")).agg(F.min("id").alias("_id"))
    out = relations
    for c in ("source", "target"):
        out = out.join(ids.withColumnsRenamed({"_n": f"_n{c}", "_id": f"{c}_id"}), F.lower(F.trim(c)) == F.col(f"_n{c}")).drop(f"_n{c}")
    return out


def similar_pairs(df: DataFrame, id_col: str, name_col: str, least: float) -> DataFrame:
    """(a, b, similarity) of names at least that similar (J7, E5), a < b; no pair is lost.

    An edit changes two of a padded name's pairs of letters at most, so from 0.5
    on similar names share one, and one among the first of each by any fixed
    order. Only such names meet, and only if their lengths differ by no more
    than the distance allows. Names that are not ASCII (the similarity counts
    bytes, the distance letters) and lower thresholds meet by length alone.
    Equal names meet once, by their least id.
    """
    return _near(_distinct_names(df, id_col, name_col), least)


def _distinct_names(df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    return df.groupBy(F.lower(name_col).alias("name")).agg(F.min(id_col).alias("id"))


def _near(names: DataFrame, least: float) -> DataFrame:
    sized = names.select("id", "name", F.length("name").alias("n"), F.octet_length("name").alias("bytes"))
    most = F.floor((1 - least) * F.greatest("a.bytes", "b.bytes") + F.lit(1e-9))
    in_band = F.abs(F.col("a.n") - F.col("b.n")) <= most
    pair = [F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "ab" for c in ("id", "name")]
    plain = F.col("n") == F.col("bytes") if least >= 0.5 else F.lit(False)

    padded = F.concat(F.lit("^"), "name", F.lit("$"))
    grams = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("n") + 1), lambda k: F.xxhash64(F.substring(padded, k, F.lit(2))))))
    # of n + 1 pairs of letters at least 1 + (2 least - 1) n are shared; a letter pair that occurs again counts once, which only lengthens what is kept
    kept = F.slice(grams, 1, F.greatest(F.lit(1), F.col("n") + 2 - F.ceil(1 + (2 * least - 1) * F.col("n") - F.lit(1e-6))).cast("int"))
    keyed = sized.filter(plain & (F.col("n") > 0)).select("*", F.explode(kept).alias("gram"))
    met = keyed.alias("a").join(keyed.alias("b"), (F.col("a.gram") == F.col("b.gram")) & (F.col("a.id") < F.col("b.id")) & in_band).select(*pair).distinct()

    odd = sized.filter(~plain)
    either = odd.alias("a").join(sized.alias("b"), (F.col("a.id") != F.col("b.id")) & in_band)
    first = F.col("a.id") < F.col("b.id")
    swapped = [F.when(first, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")).alias(f"{x}_{c}") for x, y in ("ab", "ba") for c in ("id", "name")]
    pairs = met.unionByName(either.select(*swapped).distinct())
    return pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), similarity(F.col("a_name"), F.col("b_name")).alias("similarity")).filter(F.col("similarity") >= least)


def merged_entities(df: DataFrame, id_col: str, name_col: str, type_col: str, confidence_col: str, least: float = 0.75) -> DataFrame:
    """(id, leader, entity_type, confidence): entities that the full score of E5 makes one, by greedy leaders.

    Names of one type need a similarity of (least - 0.2) / 0.8, others of least /
    0.8, so only such pairs are scored. A cluster has its leader's type and the
    mean confidence of its entities, 0.5 where unknown, 1 at most.
    """
    rows = written(df.select(F.col(id_col).alias("id"), F.lower(name_col).alias("name"), F.col(type_col).alias("type"), F.col(confidence_col).cast("double").alias("confidence")), "entities")
    firsts = written(rows.groupBy("name", "type").agg(F.min("id").alias("id")), "firsts")
    names = firsts.groupBy("name").agg(F.min("id").alias("id"))
    near = _near(names, max(0.0, (least - 0.2) / 0.8)).join(names.select(F.col("id").alias("a"), F.col("name").alias("a_name")), "a").join(names.select(F.col("id").alias("b"), F.col("name").alias("b_name")), "b")
    met = near.select("a_name", "b_name", "similarity").unionByName(near.select(F.col("b_name").alias("a_name"), F.col("a_name").alias("b_name"), "similarity")).unionByName(names.select(F.col("name").alias("a_name"), F.col("name").alias("b_name"), F.lit(1.0).alias("similarity")))
    a, b = (firsts.select(*(F.col(c).alias(f"{s}_{c}") for c in ("id", "name", "type"))) for s in "ab")
    scored = met.join(a, "a_name").join(b, "b_name").filter("a_id < b_id").withColumn("score", entity_similarity(F.col("similarity"), F.col("a_type") == F.col("b_type")))
    lead = _lead(firsts.select("id"), written(scored.filter(F.col("score") > least).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), "similar"))
    own = rows.join(firsts.withColumnRenamed("id", "first"), ["name", "type"]).join(lead.withColumnRenamed("id", "first"), "first").select("id", "leader", "confidence")
    sums = own.groupBy("leader").agg(F.least(F.lit(1.0), F.avg(F.coalesce("confidence", F.lit(0.5)))).alias("confidence"))
    kind = firsts.select(F.col("id").alias("leader"), F.col("type").alias("entity_type"))
    return own.select("id", "leader").join(sums, "leader").join(kind, "leader").select("id", "leader", "entity_type", "confidence")


def leaders(df: DataFrame, id_col: str, name_col: str, least: float) -> DataFrame:
    """(id, leader): greedy leader clustering of distinct names in the order of their ids (E5).

    A name joins the first leader that is similar, else it leads. Each round
    settles the names that no open name comes before, and those similar to them.
    """
    names = written(_distinct_names(df, id_col, name_col), "names")
    return _lead(names.select("id"), written(_near(names, least).select("a", "b"), "similar"))


def _lead(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, leader) of all names; pairs (a, b) of similar names have a before b."""
    open_pairs, joined = pairs, None
    while not open_pairs.isEmpty():
        heads = open_pairs.select("a").distinct().join(open_pairs.select(F.col("b").alias("a")), "a", "left_anti")
        out = written(open_pairs.join(heads, "a", "left_semi").select(F.col("b").alias("id")).distinct(), "joined")
        joined = out if joined is None else joined.unionByName(out)
        rest = open_pairs.join(out.withColumnRenamed("id", "b"), "b", "left_anti").join(out.withColumnRenamed("id", "a"), "a", "left_anti")
        open_pairs = written(rest.select("a", "b"), "open")
    if joined is None:
        return names.select("id", F.col("id").alias("leader"))
    first = pairs.join(joined.withColumnRenamed("id", "a"), "a", "left_anti").join(joined.withColumnRenamed("id", "b"), "b", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
    return names.join(first, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))


def relation_group(relation: Column) -> Column:
    """Synonym group of a relation, else itself."""
    groups = F.create_map(*(F.lit(x) for kv in SYNONYMS.items() for x in kv))
    return F.coalesce(F.try_element_at(groups, F.lower(relation)), F.lower(relation))


def json_of(text: Column) -> Column:
    """From the first { to the last } of a noisy reply."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)
