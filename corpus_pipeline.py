"""A training corpus from documents: one operator a stage, each stage written and read again.

Quality rules drop what they reject; of each component of near copies the document
with the smallest id stays; personal data get pseudonyms; sources, languages and topics are
sampled to their targets; what is left is packed into sequences by tokens. Verdicts belong to rows: they
meet them by id, language and text, nulls included. An id names a document, so of repeated rows with one id
one stays; a row without an id has its text for one, behind all ids.

Null and empty texts have too few words and go in the first stage; texts are worked on whole, whatever their
length; ties go to smaller ids, then to a digest of the text. Other columns than those of documents pass up to the last
stage, also if they are called as the columns that stages use inside. An empty table gives an empty one.

With ``work``, a folder that the cluster shares, each stage's table stays there by name, and a run that was broken off
goes on behind the last stage that was written whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.mixing import drawn
from tessera.llm.ngram_join import ngram_components
from tessera.llm.packing import packed
from tessera.llm.pii import key_of, pseudonymised
from tessera.llm.quality_rules import judged
from tessera.llm.shared import fresh, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keys = {fresh(docs, "id_"): F.col("doc_id"), fresh(docs, "lang_"): F.col("lang"), fresh(docs, "digest_"): F.md5("text")}
    rows = docs.withColumns(keys)
    rejected = judged(rows.select("doc_id", "text", "lang", *keys), carry=tuple(keys)).where(~F.col("kept")).select(*keys).distinct()
    same = [rows[k].eqNullSafe(rejected[k]) for k in keys]
    return rows.join(rejected, same, "left_anti").select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row, place = fresh(docs, "row_"), fresh(docs, "k_")
    behind = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    rows = docs.withColumn(row, F.coalesce(F.col("doc_id").cast("long"), behind))
    copies = ngram_components(rows.select(row, "text"), id_col=row).where("component_id <> doc_id").select(F.col("doc_id").alias(row)).distinct()
    first = Window.partitionBy(row).orderBy(F.md5("text"))
    return rows.join(copies, row, "left_anti").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonymised(docs, key_of(spark)).withColumn("n_chars", F.length("text").cast("long"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drawn(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("pii", pii),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: The stages' signatures, raking and packing are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def done(spark: SparkSession, path: str) -> bool:
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def run(spark: SparkSession, sf_dir: str, work: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = work or f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{work}/{name}"
        if not done(spark, path):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
