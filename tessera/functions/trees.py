"""JSON objects of unknown depth: keys renamed there and back, canonical text, fingerprints.

A key is a JSON string with a colon behind it, at whatever depth, so keys are found in the text's tokens in one pass and no level is walked. Texts become
variants first, which puts keys in order, drops white space and escapes that need not be, and refuses what isn't JSON or has a key twice. Nulls stay null; an
object that can't be renamed has the reason, not a text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import once, stripped

#: Keys of answers and the names that they bear outside, in groups: fixed values.
ANSWER_KEYS = {
    # an answer
    "original_query": "原始问题", "rewritten_query": "改写问题", "intent": "意图", "filters": "过滤条件", "answer": "智能体回答", "reasoning": "思考过程", "citations": "引用", "evidence_count": "证据数量",
    "retrieval_evidences": "检索证据", "chunk_type": "chunk类型", "text": "证据正文", "metadata": "元数据", "score": "检索得分", "evidence_index": "证据序号", "source_path": "来源路径", "locator": "来源定位",
    "source_excerpt": "原文摘录", "quote": "引用原文", "display_location": "展示定位", "display_excerpt": "展示摘录", "can_reveal": "可查看源文件", "selected": "模型选中",
    # filters
    "chunk_types": "知识类型过滤", "stage": "销售阶段", "scenario": "场景", "objection": "客户异议", "strategy_names": "策略名称列表",
    # hits
    "rerank_score": "重排得分", "matched_tag_paths": "命中标签路径", "tag_boost_factor": "标签加权系数",
    # references
    "section_name": "章节名称", "source_id": "来源ID", "filename": "文件名", "source_type": "来源类型", "context": "上下文", "locator_confidence": "定位置信度", "locator_error": "定位错误", "anchor_id": "锚点ID",
    # cases
    "case_name": "案例名称", "customer_state": "客户状态", "strategy_name": "策略名称", "aliases": "别名", "applicable_stages": "适用阶段", "confidence": "置信度", "inferred": "模型归纳", "script_id": "话术ID",
    "customer_trigger": "客户触发点", "related_strategy_names": "关联策略名称列表", "related_script_ids": "关联话术ID列表", "related_script_details": "关联话术详情", "goal": "目标", "source_quote": "原始话术",
    "coach_wording": "教练推荐话术", "follow_up_questions": "追问建议", "compliance_notes": "合规提醒",
    # tags
    "knowledge_type": "知识类型", "tag_paths": "标签路径", "business_domains": "业务领域", "business_categories": "业务分类", "business_tags": "业务标签", "sales_stages": "销售阶段列表", "customer_segments": "客户分群",
    "customer_needs": "客户需求", "product_categories": "产品类别", "objection_types": "异议类型", "compliance_risks": "合规风险", "tagging_method": "打标方法", "tagging_version": "打标版本",
    # courses
    "course_name": "课程名称", "course_series": "课程体系", "audience": "适用对象", "summary": "摘要", "slide_start": "幻灯片起始页", "slide_end": "幻灯片结束页", "page_start": "页码起始", "page_end": "页码结束",
    "heading": "标题", "teaching_goals": "教学目标",
    # locators
    "container": "容器路径", "page": "页码", "slide": "幻灯片页码", "line_start": "起始行", "line_end": "结束行", "char_start": "起始字符位置", "char_end": "结束字符位置", "heading_path": "标题路径",
}
TECHNICAL = ["chunk_id"]
#: A string, with the colon behind it if it is a key, or what stands between strings.
TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?|[^"]++'


def canonical(c: Column) -> Column:
    """JSON with keys in order at every depth and no white space, numbers in one form; null for what isn't JSON, or has a key twice."""
    # the parser stops behind the first value; a value with something behind it can't stand both in an array and in an object
    in_array, in_object = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"x":'), c, F.lit("}")))
    out = F.to_json(in_array)
    return F.when(in_object.isNotNull(), F.substr(out, F.lit(2), F.length(out) - 2))


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def _is_key(token: Column) -> Column:
    return F.endswith(token, F.lit('":'))


def keys(c: Column) -> Column:
    """All keys of a canonical text, at every depth, each time that they stand there."""
    return F.transform(F.filter(_tokens(c), _is_key), lambda t: F.substr(t, F.lit(2), F.length(t) - 3))


def with_keys(c: Column, names: dict[str, str]) -> Column:
    """A canonical text with other names for the keys that names has; values that read like these keys stay."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    # tried with quotes and colon on, so that other tokens go through as they are
    named = lambda t: F.when(_is_key(t), F.coalesce(F.concat(F.lit('"'), F.try_element_at(table, F.substr(t, F.lit(2), F.length(t) - 3)), F.lit('":')), t)).otherwise(t)
    return F.array_join(F.transform(_tokens(c), named), "")


def english_keys(c: Column, allowed: list[str] = TECHNICAL) -> Column:
    """The keys of a canonical text, in order, that must not go outside: of ASCII characters with a letter among them."""
    return F.array_sort(F.array_distinct(F.filter(keys(c), lambda k: k.rlike(r"^[\x00-\x7f]*[A-Za-z][\x00-\x7f]*$") & ~k.isin(allowed))))


def _checked(c: Column, bad: list[tuple[Column, str]], out: Column) -> Column:
    reason = F.when(c.isNull(), F.lit(None).cast("string"))
    for test, code in bad:
        reason = reason.when(test, F.lit(code))
    return F.struct(F.when(reason.isNull(), out).alias("json"), reason.alias("refused"))


def _changed(c: Column, names: dict[str, str], tests) -> Column:
    """(json, refused) of an object with other names for its keys. tests(text, named): what stands against it besides what isn't JSON or has a key
    twice. Texts are parsed and written once each for a row, whatever asks for them."""
    made = lambda text: once(with_keys(text, names), lambda named: once(canonical(named), lambda out: _checked(c, [(text.isNull(), "invalid_json"), *tests(text, named), (out.isNull(), "duplicate_key")], out)))
    return once(canonical(c), made)


def renamed(c: Column, names: dict[str, str] = ANSWER_KEYS, allowed: list[str] = TECHNICAL) -> Column:
    """(json, refused): an object with its keys' outside names. Refused are invalid_json (also a key twice), duplicate_key (two keys with one
    name) and english_key (a key without an outside name)."""
    return _changed(c, names, lambda text, named: [(F.size(english_keys(named, allowed)) > 0, "english_key")])


def restored(c: Column, names: dict[str, str] = ANSWER_KEYS, allowed: list[str] = TECHNICAL) -> Column:
    """(json, refused): what renamed() was made from. Refused are invalid_json, not_an_object, english_key (a key that bears its inside name already) and
    duplicate_key. Of two keys with one outside name the last comes back."""
    return _changed(c, {v: k for k, v in names.items()}, lambda text, named: [(~F.startswith(text, F.lit("{")), "not_an_object"), (F.size(english_keys(text, allowed)) > 0, "english_key")])


def spaced(c: Column) -> Column:
    """A canonical text with a blank behind each comma and colon that is not in a string."""
    own = lambda t: F.when(_is_key(t), F.concat(t, F.lit(" "))).when(F.startswith(t, F.lit('"')), t).otherwise(F.replace(t, F.lit(","), F.lit(", ")))
    return F.array_join(F.transform(_tokens(c), own), "")


def fingerprint(c: Column, blanks: bool = False) -> Column:
    """SHA-256 of the canonical text: equal objects have equal fingerprints, however they were written."""
    text = canonical(c)
    return F.sha2(spaced(text) if blanks else text, 256)


#: The address that a run may name, the largest numbers of candidates and hits, and the names of a run's settings: fixed values.
LOCAL_INDEX, MOST_CANDIDATES, MOST_HITS = "http://127.0.0.1:19530", 100, 20
SETTINGS = ["输入SHA256", "评分版本", "初检候选数", "最终证据数", "问答模型名", "裁判模型名", "同模型裁判", "Milvus地址", "知识集合统计"]
EXISTS, ROWS = "存在", "数据量"


def run_fingerprint(input_sha256: Column, scoring_version: Column, top_n: Column, top_k: Column, answer_model: Column, judge_model: Column, same_model: Column, address: Column, collections: Column, allowed_address: str = LOCAL_INDEX) -> Column:
    """(fingerprint, refused) of a run's settings; collections: map<string, struct<exists boolean, n_rows long>>. Texts are stripped, digests
    lower-cased and addresses without slashes at their end first. Refused, by code, are settings that a run may not have, nulls included."""
    text = lambda c: F.nullif(stripped(c.cast("string")), F.lit(""))
    where = F.regexp_replace(text(address), "/++$", "")
    names = F.transform(F.map_keys(collections), stripped)
    bad_stats = F.exists(F.map_values(collections), lambda s: s.isNull() | s["exists"].isNull() | s["n_rows"].isNull() | (s["n_rows"] < 0))
    tests = [
        (~F.coalesce(input_sha256.rlike(r"\A[0-9a-fA-F]{64}\z"), F.lit(False)), "input_sha256"),
        (text(scoring_version).isNull() | text(answer_model).isNull() | text(judge_model).isNull(), "blank_text"),
        (~F.coalesce(top_n.between(1, MOST_CANDIDATES) & top_k.between(1, MOST_HITS), F.lit(False)), "limits"),
        (top_k > top_n, "more_hits_than_candidates"),
        (same_model.isNull(), "same_model"),
        (~F.coalesce(where == allowed_address, F.lit(False)), "address"),
        (~F.coalesce(F.size(collections) > 0, F.lit(False)) | F.coalesce(bad_stats, F.lit(True)), "collections"),
        (F.array_contains(names, "") | (F.size(F.array_distinct(names)) < F.size(names)), "collection_names"),
    ]
    stats = F.map_from_arrays(names, F.transform(F.map_values(collections), lambda s: F.struct(s["exists"].alias(EXISTS), s["n_rows"].cast("long").alias(ROWS))))
    values = [F.lower(input_sha256), text(scoring_version), top_n.cast("long"), top_k.cast("long"), text(answer_model), text(judge_model), same_model, where, stats]
    reason = F.lit(None).cast("string")
    for test, code in reversed(tests):
        reason = F.when(test, F.lit(code)).otherwise(reason)
    # a map with a name twice would raise, so it is made only where nothing stands against it
    whole = F.when(reason.isNull(), fingerprint(F.to_json(F.struct(*(v.alias(n) for v, n in zip(values, SETTINGS, strict=True))))))
    return F.struct(whole.alias("fingerprint"), reason.alias("refused"))
