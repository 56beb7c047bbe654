"""Evaluation data: items with grouped gold evidence, known chunk ids, resumable checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An evaluation set has this many items, in these rows of its sheet: fixed values.
ITEMS, FIRST_ROW = 50, 2
GOLD = "array<struct<chunk_id: string, source_path: string, location: string, excerpt: string, support: string>>"
RECORD = "item_id string, fingerprint string, status string, total_score double, payload string"


def items(main: DataFrame, details: DataFrame) -> DataFrame:
    """Items (item_id row-N, excel_row, question, reference, trace_status, primary_id)
    of the main sheet with their gold evidence, in the order of the details sheet (excel_row, pos, chunk_id, ...)."""
    gold = F.struct("chunk_id", "source_path", "location", "excerpt", "support")
    grouped = details.groupBy("excel_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", gold.alias("gold")))), lambda x: x["gold"]).alias("gold"))
    out = main.join(grouped, "excel_row", "left").withColumn("gold", F.coalesce("gold", F.array().cast(GOLD)))
    ids = F.array_distinct(F.filter(F.transform("gold", lambda g: F.trim(g["chunk_id"])), lambda x: x != ""))
    return out.withColumn("item_id", F.concat(F.lit("row-"), F.col("excel_row").cast("string"))).withColumn("gold_ids", ids)


def checked(rows: DataFrame, n: int = ITEMS, first: int = FIRST_ROW) -> DataFrame:
    """rows, if they are n items in n rows from the first on."""
    got = rows.agg(F.count("*").alias("n"), F.count_distinct("excel_row").alias("rows"), F.min("excel_row").alias("lo"), F.max("excel_row").alias("hi")).head()
    if (got.n, got.rows, got.lo, got.hi) != (n, n, first, first + n - 1):
        raise ValueError(f"{n} items in rows {first}..{first + n - 1} are needed, not {got.asDict()}")
    return rows


def chosen(rows: DataFrame, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The items with the given ids, all of which must be there, up to a limit in sheet order."""
    if ids:
        missing = set(ids) - {r[0] for r in rows.where(F.col("item_id").isin(ids)).select("item_id").collect()}
        if missing:
            raise ValueError(f"unknown items: {sorted(missing)}")
        rows = rows.where(F.col("item_id").isin(ids))
    return rows.orderBy("excel_row").limit(limit) if limit else rows


def chunk_ids(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.trim("chunk_id").alias("chunk_id")).where("chunk_id <> ''").distinct()


def checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each item of an append-only JSON-lines checkpoint; a line
    that isn't a record fails."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "raw")).where(F.trim("raw") != "")
    rows = lines.select("line_no", F.from_json("raw", RECORD, {"mode": "FAILFAST"}).alias("r"))
    return rows.select("line_no", "r.*").groupBy("item_id").agg(F.max_by(F.struct("fingerprint", "status", "total_score", "payload"), "line_no").alias("r")).select("item_id", "r.*")


def routes(rows: DataFrame, records: DataFrame, fingerprint: str) -> DataFrame:
    """rows with what is left to do: answer, only judge, or nothing. Records of other runs don't count."""
    own = records.where(F.col("fingerprint") == fingerprint).select("item_id", F.col("status").alias("done"))
    todo = F.when(F.col("done").isNull() | (F.col("done") == "answer_failed"), "answer").when(F.col("done") == "judge_failed", "judge").otherwise("nothing")
    return rows.join(own, "item_id", "left").withColumn("todo", todo).drop("done")
