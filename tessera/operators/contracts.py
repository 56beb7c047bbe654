"""Contracts of requests and results: violations as codes, and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import once, preview, stripped

#: Fixed limits of the interfaces.
MOST_ROWS, MOST_CELL, MOST_QUESTIONS, MOST_QUERY = 1000, 20_000, 100, 2000
MOST_KB, MOST_TOP_N, MOST_TOP_K, PREVIEW = 50, 100, 20, 240
DOMAINS = ["产品知识", "合规与风控", "销售技能", "客户经营", "行业与公司", "个人成长", "组织发展"]
DOMAIN_TIES = ["合规与风控", "组织发展", "产品知识", "客户经营", "销售技能", "行业与公司", "个人成长"]
CASE_INTENTS = ["journey_search", "objection_handling"]
CASE_TYPES, COURSE_TYPES = ["customer_journey", "strategy", "script", "objection_handling"], ["training_course", "knowledge_entry"]
NO_LOCATION = "未提供精确位置"
ERRORS = {"ValueError": "10004", "TimeoutError": "504", "ConnectionError": "503"}


def feedback_codes(retrieval: Column, usage: Column, reason: Column) -> Column:
    """What is wrong with a judgement of evidence: accurate evidence is used correctly or
    not; inaccurate evidence isn't used; a negative judgement needs a reason."""
    bad = (retrieval == "inaccurate") | (usage == "incorrect")
    return F.array_compact(F.array(
        F.when(~F.coalesce(retrieval.isin("accurate", "inaccurate"), F.lit(False)), F.lit("retrieval")),
        F.when(~F.coalesce(usage.isin("correct", "incorrect", "not_applicable"), F.lit(False)), F.lit("usage")),
        F.when((retrieval == "accurate") & ~usage.isin("correct", "incorrect"), F.lit("combination")),
        F.when((retrieval == "inaccurate") & (usage != "not_applicable"), F.lit("combination")),
        F.when(bad & (F.trim(F.coalesce(reason, F.lit(""))) == ""), F.lit("reason")),
    ))


def request_violations(cells: DataFrame, key: str, row: str, text: str) -> DataFrame:
    """(key, codes) of batch requests given as rows of text."""
    own = cells.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(row).alias("rows"), F.max(F.length(text)).alias("longest"), F.count_if(F.trim(text) == "").alias("blank"))
    codes = F.array(F.when(F.col("n") > MOST_ROWS, "rows"), F.when(F.col("n") > MOST_QUESTIONS, "questions"), F.when(F.col("rows") < F.col("n"), "row_index"), F.when(F.col("longest") > MOST_CELL, "cell"), F.when(F.col("longest") > MOST_QUERY, "query"), F.when(F.col("blank") > 0, "blank"))
    return own.select(key, F.array_compact(codes).alias("codes")).where(F.size("codes") > 0)


def result_codes(total: Column, parts: list[Column], grade: Column, graded: Column) -> Column:
    """A stored total must be its parts' sum, null if some part is, and the grade must follow."""
    whole = sum(parts[1:], parts[0])
    return F.array_compact(F.array(F.when(total.isNull() != whole.isNull(), F.lit("null")), F.when(F.abs(total - whole) > 0.005, F.lit("total")), F.when(~grade.eqNullSafe(graded), F.lit("grade"))))


def domains_checked(domains: list[str]) -> list[str]:
    """Distinct known domains in order."""
    out = list(dict.fromkeys(d.strip() for d in domains))
    if len(domains) > len(DOMAINS) or not set(out) <= set(DOMAINS):
        raise ValueError("primaryDomains")
    return out


def limits_checked(top_n: int, top_k: int) -> tuple[int, int]:
    if isinstance(top_n, bool) or isinstance(top_k, bool) or not 1 <= top_n <= MOST_TOP_N or not 1 <= top_k <= min(MOST_TOP_K, top_n):
        raise ValueError("top_n, top_k")
    return top_n, top_k


def kb_limits(top_k: int) -> tuple[int, int]:
    """(top_n, top_k) of a knowledge-base search."""
    if isinstance(top_k, bool) or not 1 <= top_k <= MOST_KB:
        raise ValueError("topK")
    return max(20, top_k), top_k


def source_kinds(targets: Column) -> Column:
    """What collection targets mean for the filter: one kind, or none for both."""
    has = lambda x: F.array_contains(targets, x)
    return F.when(has("case") & ~has("course"), F.array(F.lit("绩优案例"))).when(has("course") & ~has("case"), F.array(F.lit("培训资料"))).otherwise(F.array().cast("array<string>"))


def targets_kept(targets: Column) -> Column:
    """The known targets, each once, or both."""
    own = F.array_distinct(F.filter(F.coalesce(targets, F.array().cast("array<string>")), lambda x: x.isin("case", "course")))
    return once(own, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit("case"), F.lit("course"))))


def targets_repaired(intent: Column, targets: Column, chunk_types: Column | None = None, needs_retrieval: Column | None = None) -> Column:
    """Both targets where the intent or the chunk types need cases or courses that aren't among them;
    a plan that retrieves nothing, or is out of scope, stays."""
    types = F.coalesce(chunk_types, F.array().cast("array<string>")) if chunk_types is not None else F.array().cast("array<string>")
    some = lambda kinds: F.arrays_overlap(types, F.array(*map(F.lit, kinds)))
    idle = F.coalesce(intent == "out_of_scope", F.lit(False)) | (~F.coalesce(needs_retrieval, F.lit(True)) if needs_retrieval is not None else F.lit(False))
    def repaired(own: Column) -> Column:
        lacks = (F.coalesce(intent.isin(CASE_INTENTS), F.lit(False)) | some(CASE_TYPES)) & ~F.array_contains(own, "case") | some(COURSE_TYPES) & ~F.array_contains(own, "course")
        return F.when(~idle & lacks, F.array(F.lit("case"), F.lit("course"))).otherwise(own)
    return once(targets_kept(targets), repaired)


def kb_results(hits: DataFrame, full: bool = False) -> DataFrame:
    """Hits (query_id, rank, chunk_id, text, citations) as results of the interface."""
    doc = F.coalesce(F.get("citations", F.lit(0))["source_id"], F.lit(""))
    text = preview(F.col("text"), PREVIEW) if full else F.col("text")
    return hits.select("query_id", "rank", doc.alias("docId"), F.lit("SLICE").alias("knowledgeType"), F.lit("切片").alias("knowledgeTypeName"), text.alias("content"))


def display_location(page: Column, slide: Column, line_start: Column, line_end: Column, headings: Column) -> Column:
    """``p3 · slide2 · L2-L4 · A / B`` of what a locator (numbers, array of headings) has, or a fixed text."""
    some = lambda c: F.coalesce(c.cast("string"), F.lit("")).isin("", "0") == F.lit(False)
    span = F.when(some(line_start) & some(line_end) & (line_start.cast("string") != line_end.cast("string")), F.concat(F.lit("L"), line_start.cast("string"), F.lit("-L"), line_end.cast("string"))).when(some(line_start), F.concat(F.lit("L"), line_start.cast("string")))
    path = F.array_join(F.filter(F.transform(headings, stripped), lambda x: x != ""), " / ")
    parts = F.array(F.when(some(page), F.concat(F.lit("p"), page.cast("string"))), F.when(some(slide), F.concat(F.lit("slide"), slide.cast("string"))), span, F.when(path != "", path))
    return once(F.array_join(F.array_compact(parts), " · "), lambda x: F.when(x != "", x).otherwise(F.lit(NO_LOCATION)))


def display_excerpt(source_excerpt: Column, quote: Column) -> Column:
    """The stored excerpt, or else the quote."""
    own = lambda c: stripped(F.coalesce(c, F.lit("")))
    return once(own(source_excerpt), lambda x: F.when(x != "", x).otherwise(own(quote)))


def error_code(name: Column, codes: dict[str, str] = ERRORS, other: str = "500") -> Column:
    out = F.lit(other)
    for k, v in codes.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out


def secret_keys(json: Column) -> Column:
    """Whether a JSON object's keys, at any depth, name a secret, or a url holds credentials."""
    return json.rlike(r'(?i)"[^"]*(api[_-]?key|secret|password|token|authorization)[^"]*"\s*:') | json.rlike(r"://[^/\s:@\"]+:[^/\s@\"]+@")


def search_plans(plans: DataFrame) -> DataFrame:
    """plans (query_id, intent, needs_retrieval, rewritten_query, chunk_types, stage, collection_targets) with state (search, skip, or
    error where there is nothing to search for) and the filters of the search: chunk types but for general questions, the
    stage, and the kind of source of a single target."""
    skipped = ~F.coalesce("needs_retrieval", F.lit(True)) | (F.col("intent") == "out_of_scope")
    state = F.when(skipped, "skip").when(stripped(F.coalesce("rewritten_query", F.lit(""))) == "", "error").otherwise("search")
    none = F.array().cast("array<string>")
    types = F.when(F.col("intent") == "general_sales_qa", none).otherwise(F.coalesce("chunk_types", none))
    targets = targets_repaired(F.col("intent"), F.col("collection_targets"), F.col("chunk_types"), F.col("needs_retrieval"))
    plans = plans.withColumn("_kinds", source_kinds(targets))  # before names are taken anew
    return plans.select("query_id", state.alias("state"), stripped(F.coalesce("rewritten_query", F.lit(""))).alias("query"), types.alias("chunk_types"), F.coalesce("stage", F.lit("")).alias("stage"), F.col("_kinds").alias("source_kinds"))


def kb_request(query: str, domains: list[str] | None = None, types: list[str] | None = None, mode: str = "HYBRID", weights=None, top_k: int | None = None) -> dict:
    """The parameters of a knowledge-base search, or its error: query, domains, top_n, top_k, and whether there is anything to search."""
    try:
        if not str(query or "").strip():
            raise ValueError("query 不能为空")
        own = domains_checked(list(domains or []))
        top_n, k = kb_limits(10 if top_k is None else int(top_k))
        if str(mode or "").strip().upper() != "HYBRID":
            raise ValueError("retrievalMode 暂时仅支持 HYBRID")
        if weights is not None and not isinstance(weights, dict):
            raise ValueError("hybridWeights 必须为对象")
    except (TypeError, ValueError) as e:
        return {"code": "10004", "message": f"参数错误: {e}"}
    kinds = ["SLICE"] if types is None else [str(t).strip().upper() for t in types if str(t).strip()]
    return {"code": "0", "query": str(query).strip(), "domains": own, "top_n": top_n, "top_k": k, "searched": "SLICE" in kinds}
