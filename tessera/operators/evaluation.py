"""Evaluation of answers: per-item scores, grades, summary, strata, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.storage import written

#: Fixed values of the scoring scheme: half of the retrieval points are for the primary chunk, or for any
#: evidence; half of the citation points for valid numbers.
RETRIEVAL_POINTS, CITATION_POINTS = 10.0, 5.0
EXCELLENT, PASSED = 85, 75
STATUSES = ["完整支持", "部分支持", "未定位"]
UNTRACED = STATUSES[2]
ANSWER_FAILED, JUDGE_FAILED, FINISHED = "问答失败", "评测失败", "已完成"
ANSWER_TAG, JUDGE_TAG = "问答执行失败", "裁判执行失败"


def item_scores(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """items (item_id, trace_status, gold, primary_id, evidences array<chunk_id>, citations
    array<struct<evidence_index: string, source_path, locator>>), catalog (chunk_id): hits, recall and points.
    A traced item gets its retrieval points for the primary chunk and the recall of gold chunks, and its
    citation points for valid evidence numbers and for any that names gold; an untraced one for any
    evidence and the share of it that the catalog has, and for valid numbers and locatable citations."""
    ids = F.transform("evidences", lambda x: F.trim(F.coalesce(x, F.lit(""))))
    rows = items.withColumn("by_index", F.coalesce(ids, F.array().cast("array<string>"))).withColumn("got", F.filter("by_index", lambda x: x != ""))
    known = catalog.select(F.trim("chunk_id").alias("id")).distinct()
    held = rows.where(F.col("trace_status") == UNTRACED).select("item_id", F.explode("got").alias("id")).join(known, "id").groupBy("item_id").agg(F.count("*").alias("known"))
    rows = rows.join(held, "item_id", "left")
    share = lambda a, n: F.coalesce(F.try_divide(a, n), F.lit(0.0))
    untraced = F.col("trace_status") == UNTRACED
    gold = F.array_distinct("gold")
    primary = ~untraced & (F.col("primary_id") != "") & F.array_contains("got", F.col("primary_id"))
    recall = F.when(untraced, 0.0).otherwise(share(F.size(F.array_intersect("got", gold)), F.size(gold)))
    rows = rows.withColumn("primary_hit", F.coalesce(primary, F.lit(False))).withColumn("recall", recall)
    half = RETRIEVAL_POINTS / 2
    found = half * F.when(untraced, (F.size("got") > 0).cast("double")).otherwise(F.col("primary_hit").cast("double"))
    rest = half * F.when(untraced, share(F.coalesce("known", F.lit(0)), F.size("got"))).otherwise(F.col("recall"))
    cited = F.coalesce("citations", F.expr("cast(array() AS array<struct<evidence_index: string, source_path: string, locator: string>>)"))
    number = F.transform(cited, lambda c: F.when(c["evidence_index"].cast("string").rlike("^[0-9]+$"), c["evidence_index"].cast("string").try_cast("int")))
    rows = rows.withColumn("valid", F.filter(number, lambda i: (i >= 1) & (i <= F.size("by_index"))))
    some = lambda c: F.coalesce(c.cast("string"), F.lit("")) != ""
    locatable = share(F.size(F.filter(cited, lambda c: some(c["source_path"]) & some(c["locator"]))), F.size(cited))
    names_gold = F.size(F.array_intersect(F.transform("valid", lambda i: F.get("by_index", i - 1)), gold)) > 0
    citation = CITATION_POINTS / 2 * (share(F.size("valid"), F.size(cited)) + F.when(untraced, locatable).otherwise(names_gold.cast("double")))
    rows = rows.withColumn("retrieval", found + rest).withColumn("citation", citation)
    return rows.select("item_id", "trace_status", "primary_hit", F.round("recall", 6).alias("recall"), F.round("retrieval", 2).alias("retrieval_points"), F.round("citation", 2).alias("citation_points"), F.round(F.col("retrieval") + F.col("citation"), 2).alias("deterministic_points"))


def totals(items: DataFrame) -> DataFrame:
    """items (item_id, trace_status, answer_error, judge_error, deterministic_points, the judge's
    points correctness, keypoints, groundedness, relevance, and error_tags) with total_score, status and
    tags: a failed answer scores 0, a failed judge nothing."""
    told = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    status = F.when(told("answer_error"), ANSWER_FAILED).when(told("judge_error"), JUDGE_FAILED).otherwise(FINISHED)
    parts = ["correctness", "keypoints", "groundedness", "relevance", "deterministic_points"]
    total = F.when(told("answer_error"), 0.0).when(~told("judge_error"), F.round(sum((F.col(c) for c in parts[1:]), F.col(parts[0])), 2))
    tags = F.when(told("answer_error"), F.array(F.lit(ANSWER_TAG))).when(told("judge_error"), F.array(F.lit(JUDGE_TAG))).otherwise(F.coalesce("error_tags", F.array().cast("array<string>")))
    return items.withColumn("status", status).withColumn("total_score", total).withColumn("error_tags", tags)


def valid_indexes(indexes: Column, evidences: Column) -> Column:
    """Distinct 1-based indexes within range, in order."""
    return F.array_distinct(F.filter(indexes, lambda i: (i >= 1) & (i <= F.size(evidences))))


def grade(score: Column) -> Column:
    return F.when(score >= EXCELLENT, "excellent").when(score >= PASSED, "qualified").when(score.isNotNull(), "failed")


def summary(results: DataFrame) -> DataFrame:
    """One row of results (status, trace_status, total_score; primary_hit, recall, deterministic_points where
    there): counts, rates, mean and percentiles. Answers that failed have the score 0 and count; items whose judge
    failed have none and leave the denominator of the effective rate only."""
    for c, kind in (("trace_status", "string"), ("primary_hit", "boolean"), ("recall", "double"), ("deterministic_points", "double")):
        results = results if c in results.columns else results.withColumn(c, F.lit(None).cast(kind))
    n, unjudged, unanswered = F.count("*"), F.count_if(F.col("status") == JUDGE_FAILED), F.count_if(F.col("status") == ANSWER_FAILED)
    passed = F.count_if(F.col("total_score") >= PASSED)
    p = lambda q: F.coalesce(F.round(F.percentile("total_score", q), 6), F.lit(0.0))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    mean = lambda c: F.coalesce(F.round(F.avg(c), 6), F.lit(0.0))
    traced = ~F.col("trace_status").eqNullSafe(UNTRACED) & F.col("deterministic_points").isNotNull()
    return results.agg(
        n.alias("n_items"), unjudged.alias("n_judge_failed"), unanswered.alias("n_answer_failed"), F.count("total_score").alias("n_scored"),
        ratio(passed, n).alias("conservative_rate"), ratio(passed, n - unjudged).alias("effective_rate"), ratio(F.count_if(F.col("total_score") >= EXCELLENT), n).alias("excellent_rate"), ratio(n - unanswered, n).alias("answer_rate"),
        mean("total_score").alias("mean_score"), p(0.5).alias("p50"), p(0.95).alias("p95"),
        mean(F.when(traced, F.col("primary_hit").cast("double"))).alias("primary_hit_rate"), mean(F.when(traced, F.col("recall"))).alias("mean_recall"), mean("deterministic_points").alias("mean_deterministic"),
    )


def percentiles(rows: DataFrame, column: str, wanted: dict[str, float]) -> DataFrame:
    """One row of exact percentiles of a column of any number of distinct values, by name, interpolated as F.percentile does; null without
    values. Values are counted, then dealt by range, so no task sees more than a range; of the ranges only their counts come together."""
    counts = rows.select(F.col(column).cast("double").alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    held = written(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "counts")
    ranges, before = held.groupBy("part").agg(F.sum("n").alias("m")), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy()).alias("total"))
    ends = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    placed = held.join(F.broadcast(ranges), "part").withColumn("end", ends).withColumn("start", F.col("end") - F.col("n"))
    place = {name: (F.col("total") - 1) * F.lit(float(q)) for name, q in wanted.items()}
    at = lambda rank: F.max(F.when((F.col("start") <= rank) & (rank < F.col("end")), F.col("value")))
    found = placed.agg(*(F.struct(at(F.floor(p)).alias("low"), at(F.ceil(p)).alias("high"), F.max(p).alias("place")).alias(name) for name, p in place.items()))

    def between(x: Column) -> Column:
        low, high = F.floor(x["place"]), F.ceil(x["place"])
        return F.when((low == high) | (x["low"] == x["high"]), x["low"]).otherwise((high - x["place"]) * x["low"] + (x["place"] - low) * x["high"])

    return found.select(*(between(F.col(name)).alias(name) for name in wanted))


def strata(results: DataFrame, statuses: DataFrame) -> DataFrame:
    """Count, mean and pass rate of each listed stratum, also of those without rows. Items without
    a score don't pass."""
    own = results.groupBy("stratum").agg(F.count("*").alias("n"), F.avg("total_score").alias("mean"), (F.count_if(F.col("total_score") >= PASSED) / F.count("*")).alias("rate"))
    return statuses.join(own, "stratum", "left").select("stratum", F.coalesce("n", F.lit(0)).alias("n_items"), F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean_score"), F.round(F.coalesce("rate", F.lit(0.0)), 6).alias("pass_rate"))


def tag_frequency(results: DataFrame, column: str = "error_tags") -> DataFrame:
    return results.select(F.explode(column).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def bottom(results: DataFrame, n: int = 5) -> DataFrame:
    return results.orderBy(F.col("total_score").asc_nulls_last(), "item_id").limit(n)
