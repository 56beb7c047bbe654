"""Whole-directory normalisation: keep-first, conflicts, duplicates, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.classify import METHOD, SOURCE_KINDS, VERSION

#: Chunk types, and bytes that a stored field may have: fixed values.
CHUNK_TYPES = ["customer_journey", "strategy", "script", "objection_handling", "training_course", "knowledge_entry"]
FIELD_BYTES = {"chunk_id": 256, "source_file": 1024, "text": 65535}


def keep_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in a stable order."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("k = 1").drop("k")


def conflicts(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """Keys that come from more than one kind of source, which is an error."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(kind)).alias("kinds")).where(F.size("kinds") > 1)


def duplicate_groups(rows: DataFrame, text: str, path: str) -> DataFrame:
    """(text_hash, n, first) of the texts that several paths hold. Only digests are shuffled."""
    return rows.groupBy(F.sha2(text, 256).alias("text_hash")).agg(F.count("*").alias("n"), F.min(path).alias("first")).where("n > 1")


def preferred(rows: DataFrame, hash_by: list[Column], name: Column, empty: Column, tie: str) -> DataFrame:
    """Of equal sources the one whose name has no copy mark before its ending, that isn't empty, and whose name is least."""
    rank = [name.rlike(r"\([0-9]+\)\.[^.]+$").cast("int"), empty.cast("int"), name, F.col(tie)]
    w = Window.partitionBy(*hash_by).orderBy(*rank)
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def chunk_violations(chunks: DataFrame, types: list[str] = CHUNK_TYPES, caps: dict[str, int] = FIELD_BYTES) -> DataFrame:
    """(chunk_id, codes) of the rows that break the contract."""
    code = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"blank_{c}")) for c in ("chunk_id", "text", "source_file")]
    code += [F.when(F.octet_length(c) > n, F.lit(f"long_{c}")) for c, n in caps.items()]
    code.append(F.when(~F.coalesce(F.col("chunk_type").isin(*types), F.lit(False)), F.lit("chunk_type")))
    twice = chunks.groupBy("chunk_id").agg(F.count("*").alias("copies")).where("copies > 1")
    rows = chunks.join(twice, "chunk_id", "left")
    code.append(F.when(F.col("copies") > 1, F.lit("duplicate_chunk_id")))
    return rows.select("chunk_id", F.array_compact(F.array(*code)).alias("codes")).where(F.size("codes") > 0)


def domain_violations(rows: DataFrame, domains: list[str], ties: list[str], kinds: list[str] = SOURCE_KINDS, method: str = METHOD, version: str = VERSION) -> DataFrame:
    """(chunk_id, codes) of rows (source_kind, primary_domain, domain_tags, domain_tagging_method,
    domain_tagging_version): kinds, domains, method and version must be known; tags not empty, distinct,
    and the primary first, then by the order of ties."""
    known = F.array(*map(F.lit, ties))
    place = lambda x: F.array_position(known, x)
    tags, primary = F.coalesce("domain_tags", F.array().cast("array<string>")), F.coalesce("primary_domain", F.lit(""))
    ordered = F.transform(F.array_sort(F.transform(tags, lambda x: F.struct((x != primary).alias("other"), place(x).alias("p"), x.alias("x")))), lambda s: s["x"])
    unknown = F.exists(tags, lambda x: ~F.coalesce(x.isin(*domains), F.lit(False)))
    is_ = lambda c, *v: F.coalesce(F.col(c).isin(*v), F.lit(False))
    code = [
        F.when(~is_("source_kind", *kinds), F.lit("source_kind")),
        F.when(~is_("primary_domain", *domains), F.lit("primary_domain")),
        F.when(F.size(tags) == 0, F.lit("empty_tags")),
        F.when(F.size(F.array_distinct(tags)) < F.size(tags), F.lit("duplicate_tags")),
        F.when(unknown, F.lit("domain_tags")),
        F.when((F.size(tags) > 0) & ~unknown & (tags != ordered), F.lit("tag_order")),
        F.when(is_("primary_domain", *domains) & ~F.array_contains(tags, primary), F.lit("primary_not_tagged")),
        F.when(~is_("domain_tagging_method", method), F.lit("method")),
        F.when(~is_("domain_tagging_version", version), F.lit("version")),
    ]
    return rows.select("chunk_id", F.array_compact(F.array(*code)).alias("codes")).where(F.size("codes") > 0)


def vector_violations(vectors: DataFrame, dim: int) -> DataFrame:
    """(chunk_id, code) of vectors that are empty, of another dimension, or not finite."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    code = F.when(F.coalesce(F.size("vector"), F.lit(0)) <= 0, F.lit("empty")).when(F.size("vector") != dim, F.lit("dimension")).when(bad, F.lit("not_finite"))
    return vectors.select("chunk_id", code.alias("code")).where("code is not null")


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, key) of the keys that only one side has."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").select(F.lit("left").alias("side"), key).unionByName(y.join(x, key, "left_anti").select(F.lit("right").alias("side"), key))
