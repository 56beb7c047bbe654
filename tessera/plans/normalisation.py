"""Whole-directory normalisation: chunks of a folder with their domains, or a report of what stands in the way."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import classify
from tessera.sources.chunks import source_kind

#: Codes of issues; those of ERRORS stop publication: fixed values.
ERRORS = ["unsupported_path", "duplicate_chunk_id_source_conflict", "unclassified", "invalid_json", "unknown_field", "missing_field"]
WARNINGS = ["deduplicated_chunk_id"]


def judged(chunks: DataFrame, scores, ties: list[str]) -> DataFrame:
    """chunks (relative, line_no, chunk_id, ...) with source_kind, domain columns and issue: a path of
    neither kind, an id that another kind of source has first, an id that came before, or no domain. In the order of path and line."""
    rows = chunks.withColumn("source_kind", source_kind(F.col("relative"))).withColumn("domain_tags", classify.domain_tags(scores, ties)).withColumn("primary_domain", F.get("domain_tags", F.lit(0)))
    supported = F.col("source_kind").isNotNull()
    first = Window.partitionBy("chunk_id", supported).orderBy("relative", "line_no")
    rows = rows.withColumn("first_kind", F.first("source_kind").over(first)).withColumn("place", F.row_number().over(first))
    issue = F.when(~supported, "unsupported_path").when((F.col("place") > 1) & (F.col("first_kind") != F.col("source_kind")), "duplicate_chunk_id_source_conflict")
    issue = issue.when(F.col("place") > 1, "deduplicated_chunk_id").when(F.col("domain_tags").isNull(), "unclassified")
    method = {"domain_tagging_method": F.lit(classify.METHOD), "domain_tagging_version": F.lit(classify.VERSION)}
    return rows.withColumn("issue", issue).withColumns(method).drop("first_kind", "place")


def report(rows: DataFrame) -> DataFrame:
    """(section, value, n) of judged rows: totals, kinds of sources, primary domains, domain tags, and issues."""
    good = rows.where("issue is null")
    count = lambda df, section, column: df.groupBy(F.lit(section).alias("section"), F.col(column).alias("value")).agg(F.count("*").alias("n"))
    totals = rows.agg(F.count_if(~F.col("issue").eqNullSafe("unsupported_path")).alias("input_chunks"), F.count_if(F.col("issue").isNull()).alias("chunks"), F.count_if(F.col("issue").isNull() & (F.size("domain_tags") > 1)).alias("multi_domain_chunks"))
    totals = totals.select(F.explode(F.array(*(F.struct(F.lit(c).alias("value"), F.col(c).alias("n")) for c in totals.columns))).alias("x")).select(F.lit("total").alias("section"), "x.value", "x.n")
    parts = [count(good, "source_kind", "source_kind"), count(good, "primary_domain", "primary_domain"), count(good.select(F.explode("domain_tags").alias("domain")), "domain", "domain"), count(rows.where("issue is not null"), "issue", "issue")]
    for part in parts:
        totals = totals.unionByName(part)
    return totals


def published(spark: SparkSession, rows: DataFrame, out: str, columns: list[str]) -> bool:
    """Writes judged rows as JSON lines by file into the folder out, with a report beside them; or, where there
    are errors, the report alone as ``<out>.classification_report.json``. The folder is made under another name, read
    back and moved, so it is there whole or not at all; an older one is kept until then."""
    def fs(name: str):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    found = [r.asDict() for r in report(rows).orderBy("section", "value").collect()]  # a row for each section and value
    errors = sum(r["n"] for r in found if r["section"] == "issue" and r["value"] in ERRORS)
    none = not any(r["n"] for r in found if r["value"] == "input_chunks")

    def write(path: str) -> None:
        files, where = fs(path)
        stream = files.create(where, True)
        stream.write(bytearray(json.dumps({"published": not (errors or none), "counts": found, "issues_stop": ERRORS}, ensure_ascii=False).encode()))
        stream.close()

    failure = f"{out}.classification_report.json"
    if errors or none:
        write(failure)
        return False
    staging = f"{out}.tmp-{uuid.uuid4().hex}"
    good = rows.where("issue is null").select(*columns, F.col("relative").alias("file"))
    good.repartition("file").sortWithinPartitions("file", "line_no" if "line_no" in columns else "file").write.partitionBy("file").json(staging)
    n = sum(r["n"] for r in found if r["value"] == "chunks")
    if spark.read.json(staging).count() != n:
        raise OSError("what was written is not what was counted")
    write(f"{staging}/classification_report.json")
    files, new = fs(staging)
    _, path = fs(out)
    _, old = fs(f"{out}.old-{uuid.uuid4().hex}")
    if files.exists(path):
        files.rename(path, old)
    if not files.rename(new, path):
        if files.exists(old):
            files.rename(old, path)
        raise OSError("the folder could not be published")
    files.delete(old, True)
    files.delete(fs(failure)[1], False)
    return True
