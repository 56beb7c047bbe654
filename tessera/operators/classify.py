"""Rules over texts: tags, domain scores, primary domains, domain tags and their distribution.

Rule tables are parameters: a tag rule is (dimension, rule_order, value, keywords), a
domain rule (domain, keywords) in canonical order, with ties by another order.
The keywords of a table stand in the plan, so a text is read and lower-cased once
and no row is multiplied.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import once

#: Points of a label that names a domain in a direct field, and of a keyword in the other fields; the least
#: score of a domain's tag; method, version and kinds of sources of the contract: fixed values.
DIRECT_POINTS, POINTS, LEAST_SCORE = 10, {"structured": 4, "source": 2, "text": 1}, 4
METHOD, VERSION, SOURCE_KINDS = "规则匹配", "2026-07-16", ["培训资料", "绩优案例"]
#: Labels that stand for a domain, beside its name where they are listed: fixed values.
ALIASES = {
    "产品知识": ["产品知识", "产品类别"],
    "合规与风控": ["合规与风控", "法律合规", "合规风险"],
    "销售技能": ["销售技能", "销售阶段"],
    "客户经营": ["客户经营", "客户画像", "客户需求"],
    "行业与公司": ["行业与公司", "公司品牌"],
}


def occurs(low: Column, keywords: list[str]) -> Column:
    """Whether some keyword occurs in a text that is lower-cased already."""
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(k.lower())) for k in keywords), F.lit(False))


def rule_tags(text: Column, rules: list[tuple[str, str, list[str]]]) -> Column:
    """An array of dimension/value of the rules of which some keyword occurs, in their order."""
    return once(F.lower(text), lambda low: F.array_compact(F.array(*(F.when(occurs(low, keys), F.lit(f"{d}/{v}")) for d, v, keys in rules))))


def keyword_hits(text: Column, rules: dict[str, list[str]]) -> Column:
    """For each domain, in the order of the rules, how many of its distinct keywords occur."""
    count = lambda low, keys: sum((F.contains(low, F.lit(k.lower())).cast("int") for k in dict.fromkeys(keys)), F.lit(0))
    return once(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.array(*(count(low, keys) for keys in rules.values())))


def label_hits(fields: dict[str, Column], rules: dict[str, list[str]], aliases: dict[str, list[str]] = ALIASES) -> Column:
    """For each domain, in how many of the fields (arrays of labels) some label names it."""
    own = lambda x, d: reduce(lambda a, b: a | b, (label_fits(x, F.lit(a)) for a in aliases.get(d, [d])))
    named = lambda c, d: F.coalesce(F.exists(c, lambda x: own(x, d)), F.lit(False)).cast("int")
    return F.array(*(sum((named(c, d) for c in fields.values()), F.lit(0)) for d in rules))


def structured_text(values: Column, rules: dict[str, list[str]], aliases: dict[str, list[str]] = ALIASES) -> Column:
    """The values (an array) that don't name a domain, a line each."""
    names = [a for d in rules for a in aliases.get(d, [d])]
    return F.array_join(F.filter(values, lambda x: ~reduce(lambda a, b: a | b, (label_fits(x, F.lit(n)) for n in names))), "\n")


def domain_scores(rules: dict[str, list[str]], direct: dict[str, Column] | None = None, texts: dict[str, Column] | None = None, aliases: dict[str, list[str]] = ALIASES, points: dict[str, int] = POINTS) -> Column:
    """A map of each domain with a score: DIRECT_POINTS for each direct field with a label
    that names it, and points of each text (structured, source, text) for each keyword in it."""
    parts = [(DIRECT_POINTS, label_hits(direct, rules, aliases))] if direct else []
    parts += [(points[f], keyword_hits(c, rules)) for f, c in (texts or {}).items()]
    fields = F.struct(*(c.alias(f"f{i}") for i, (_, c) in enumerate(parts)))
    def scored(x: Column) -> Column:
        score = lambda j: sum((F.get(x[f"f{i}"], F.lit(j)) * n for i, (n, _) in enumerate(parts)), F.lit(0))
        return F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(d).alias("key"), score(j).alias("value")) for j, d in enumerate(rules))), lambda e: e["value"] > 0))
    return once(fields, scored)


def primary_domain(scores: Column, tie_order: list[str], least: int = LEAST_SCORE) -> Column:
    """The domain of the highest score, at least so high; ties by the order."""
    ranked = F.array(*(F.struct(F.coalesce(F.try_element_at(scores, F.lit(d)), F.lit(0)).alias("s"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(tie_order)))
    return once(F.array_max(ranked), lambda best: F.when(best["s"] >= least, best["d"]))


def domain_tags(scores: Column, tie_order: list[str], least: int = LEAST_SCORE) -> Column:
    """The primary domain, then all others with so high a score in tie order; null without any."""
    held = F.filter(F.array(*map(F.lit, tie_order)), lambda d: F.coalesce(F.try_element_at(scores, d), F.lit(0)) >= least)
    return once(primary_domain(scores, tie_order, least), lambda p: F.when(p.isNotNull(), F.concat(F.array(p), F.array_remove(held, p))))


def query_domains(text: Column, rules: dict[str, list[str]], tie_order: list[str]) -> Column:
    """All domains of which some keyword occurs, in tie order."""
    return once(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.array_compact(F.array(*(F.when(occurs(low, rules[d]), F.lit(d)) for d in tie_order))))


def label_fits(value: Column, alias: Column) -> Column:
    return (value == alias) | F.startswith(value, F.concat(alias, F.lit("/")))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def samples(rows: DataFrame, by: str, order: list[str], n: int = 3) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("k") <= n)
