"""Evidence and citations of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import stripped

#: What is answered without evidence, and why a question was not searched: fixed values.
NO_EVIDENCE, NOT_SEARCHED = "当前检索结果不足以确认。", "query 不属于可检索范围"


def flattened(evidences: DataFrame, key: str, order: str, citations: str) -> DataFrame:
    """(key, evidence_index, citation_index, citation): citations of all evidences
    of a key, with one running number over them."""
    w = Window.partitionBy(key)
    rows = evidences.withColumn("evidence_index", F.row_number().over(w.orderBy(order)))
    rows = rows.select(key, "evidence_index", F.posexplode(citations).alias("pos", "citation"))
    return rows.withColumn("citation_index", F.row_number().over(w.orderBy("evidence_index", "pos"))).drop("pos")


def selected(flat: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """The citations whose running numbers an answer names; chosen (key, indexes).
    Repeated and impossible numbers are ignored, the answer's order is kept."""
    wanted = chosen.select(key, F.posexplode(F.array_distinct("indexes")).alias("place", "citation_index"))
    return flat.join(wanted, [key, "citation_index"])


def compliance_risks(results: DataFrame, key: str, order: str, risks: str) -> DataFrame:
    """Distinct risks of a key's results, in the order in which they first come."""
    rows = results.select(key, F.col(order).alias("o"), F.posexplode(risks).alias("pos", "risk"))
    first = rows.groupBy(key, "risk").agg(F.min(F.struct("o", "pos")).alias("first"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "risk"))), lambda x: x["risk"]).alias("risks"))


def merged_references(refs: DataFrame, key: str, order: str) -> DataFrame:
    """References of a key, one for each (anchor, quote, source_id), the first kept."""
    w = Window.partitionBy(key, "anchor_id", "quote", "source_id").orderBy(order)
    return refs.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def catalog(drafts: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts (draft_id, evidence_ids) joined to entries (evidence_id, ...) by
    normalised ids, and the ids that no entry has."""
    norm = lambda c: F.upper(F.regexp_replace(c, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))
    ids = drafts.select("draft_id", F.posexplode("evidence_ids").alias("pos", "raw")).withColumn("evidence_id", norm(F.col("raw")))
    return ids.join(entries, "evidence_id"), ids.join(entries.select("evidence_id"), "evidence_id", "left_anti").select("draft_id", "raw")


def evidence_texts(hits: DataFrame, key: str, order: str) -> DataFrame:
    """(key, evidence): what an answer's prompt shows of hits (key, order, chunk_id, chunk_type, text, citations
    array<struct<filename, section_name, location, source_excerpt, quote>>): numbered evidence, and citations with one
    running number over all evidence of a key, a line each, a blank line between."""
    w = Window.partitionBy(key).orderBy(order)
    rows = hits.withColumn("n", F.row_number().over(w)).withColumn("before", F.coalesce(F.sum(F.size("citations")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    some = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    def cited(c, i):
        quote = F.when(some(c["source_excerpt"]) != "", c["source_excerpt"]).otherwise(some(c["quote"]))
        return F.concat(F.lit("[引用"), (F.col("before") + i + 1).cast("int").cast("string"), F.lit("] 文件："), some(c["filename"]), F.lit("；章节："), some(c["section_name"]), F.lit("；位置："), some(c["location"]), F.lit("；原文："), quote)
    head = [F.concat(F.lit("[证据"), F.col("n").cast("string"), F.lit("]")), *(F.concat(F.lit(f"{label}："), some(F.col(c))) for label, c in (("chunk_id", "chunk_id"), ("知识类型", "chunk_type"), ("内容", "text")))]
    rows = rows.withColumn("lines", F.array_join(F.concat(F.array(*head), F.transform("citations", cited)), "\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "lines"))), lambda x: x["lines"])
    return rows.groupBy(key).agg(stripped(F.array_join(parts, "\n\n")).alias("evidence"))


def answered(questions: DataFrame, evidence: DataFrame, key: str, answer) -> DataFrame:
    """questions (key, query) with answer and reason: what the hook ``answer`` (a function of a table with key, query and
    evidence that gives (key, answer)) says where there is evidence, else the fixed text."""
    rows = questions.join(evidence, key, "left")
    told = answer(rows.where(F.col("evidence").isNotNull()).select(key, "query", "evidence")).select(key, F.col("answer").alias("told"))
    out = rows.join(told, key, "left")
    return out.select(key, "query", F.coalesce("told", F.lit(NO_EVIDENCE)).alias("answer"), F.when(F.col("evidence").isNull(), F.lit("检索结果为空")).otherwise(F.lit("")).alias("reason"))
