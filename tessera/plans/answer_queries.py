"""Registered queries of answers' objects, evidence texts and sections' material."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import trees
from tessera.operators import materials, segments
from tessera.plans.search_queries import table


def _objects(spark, sf_dir):
    """A document as an answer; every fifth has a key without an outside name, every seventh isn't JSON."""
    hit = F.struct(F.col("doc_id").cast("string").alias("chunk_id"), F.struct("lang", F.col("n_chars").alias("score")).alias("metadata"))
    whole = F.to_json(F.struct(F.col("source").alias("original_query"), F.col("text").alias("answer"), F.array(hit).alias("citations"), F.when(F.col("doc_id") % 5 == 0, F.lit(1)).alias("zzz")))
    plain = F.regexp_replace(whole, '"lang":', '"filename":')
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(plain, F.lit("}"))).otherwise(plain).alias("object"))


def answer_keys_renamed(spark, sf_dir):
    out = _objects(spark, sf_dir).select("doc_id", trees.renamed(F.col("object")).alias("r"))
    return out.select("doc_id", F.md5("r.json").alias("digest"), "r.refused")


def answer_keys_restored(spark, sf_dir):
    """Renamed and back again; a third of the objects bear inside names from the start."""
    there = F.when(F.col("doc_id") % 3 == 0, F.col("object")).otherwise(trees.renamed(F.col("object"))["json"])
    out = _objects(spark, sf_dir).select("doc_id", there.alias("object")).where("object IS NOT NULL").select("doc_id", trees.restored(F.col("object")).alias("r"))
    return out.select("doc_id", F.md5("r.json").alias("digest"), "r.refused")


def object_fingerprints(spark, sf_dir):
    """Objects written in two orders, with and without blanks, have one fingerprint."""
    one = F.to_json(F.struct("source", F.struct("text", "lang").alias("body"), "n_chars"))
    two = F.concat(F.lit('{ "n_chars" : '), "n_chars", F.lit(', "body":{"lang":'), F.to_json(F.array("lang")).substr(F.lit(2), F.length("lang") + 2), F.lit(","), F.regexp_replace(F.to_json(F.struct("text")), r"^\{", ""), F.lit(","), F.regexp_replace(F.to_json(F.struct("source")), r"^\{", ""))
    both = table(spark, sf_dir, "documents").select("doc_id", trees.fingerprint(one).alias("fingerprint"), trees.fingerprint(two).alias("other"))
    return both.select("doc_id", "fingerprint", (F.col("fingerprint") == F.col("other")).alias("same"))


def run_fingerprints(spark, sf_dir):
    """Orders as runs: settings by their columns, of which some may not be."""
    stats = F.create_map(F.lit(" script "), F.struct((F.col("o_custkey") % 2 == 0).alias("exists"), F.col("o_custkey").cast("long").alias("n_rows")), F.lit("case"), F.struct(F.lit(True).alias("exists"), (F.col("o_orderkey") % 50 - 1).cast("long").alias("n_rows")))
    out = trees.run_fingerprint(F.upper(F.sha2(F.col("o_orderkey").cast("string"), 256)), F.col("o_orderpriority"), F.col("o_custkey") % 120, F.col("o_custkey") % 23, F.lit("answer"), F.when(F.col("o_orderstatus") == "P", F.lit(" ")).otherwise(F.lit("judge")), F.lit(False), F.lit(trees.LOCAL_INDEX + "//"), stats)
    return table(spark, sf_dir, "orders").select("o_orderkey", out.alias("r")).select("o_orderkey", "r.fingerprint", "r.refused")


#: A line's place, shifted by the document, says what stands before it.
_KINDS = ["案例：", "来源原文：\n- ", "- ", "", "- ", "关键要点：\n", "", "标签："]


def _evidence(spark, sf_dir):
    lead = F.array(*map(F.lit, _KINDS))
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.element_at(lead, ((i + F.col("doc_id")) % len(_KINDS) + 1).cast("int")), line))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


def evidence_segments(spark, sf_dir):
    out = segments.segments(_evidence(spark, sf_dir), "doc_id")
    return out.select("doc_id", "pos", "kind", "label", "origin", F.md5("value").alias("value"), F.size("items").alias("n_items"), F.md5(F.array_join("items", "|")).alias("items"))


def evidence_structured(spark, sf_dir):
    return segments.structured(segments.segments(_evidence(spark, sf_dir), "doc_id"), "doc_id")




def section_materials(spark, sf_dir):
    """A source and language as a section, documents as its sources."""
    names = {"case_name": F.col("source"), "section_name": F.col("lang"), "source_type": F.lit("text"), "filename": F.concat("lang", F.lit(".txt")), "source_id": F.col("doc_id").cast("string")}
    out = materials.section_materials(table(spark, sf_dir, "documents").withColumns(names), ["source", "lang"], ["doc_id"])
    return out.select("source", "lang", F.length("material").alias("n_chars"), F.md5("material").alias("digest"))


_OBJECTS = """o AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'invalid_json' WHEN doc_id % 5 = 0 THEN 'english_key' END AS refused,
'{"answer":' || to_json(text) || ',"citations":[{"chunk_id":"' || doc_id || '","metadata":{"filename":"' || lang || '","score":' || n_chars || '}}],"original_query":"' || source || '"' || CASE WHEN doc_id % 5 = 0 THEN ',"zzz":1' ELSE '' END || '}' AS inside,
'{"原始问题":"' || source || '","引用":[{"chunk_id":"' || doc_id || '","元数据":{"文件名":"' || lang || '","检索得分":' || n_chars || '}}],"智能体回答":' || to_json(text) || '}' AS outside FROM documents)"""
_LEADS = "[" + ", ".join("'" + k.replace("\n", "' || chr(10) || '") + "'" for k in _KINDS) + "]"
_SEGMENTS = f"""d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, array_to_string(list_transform(range(len(ls)), lambda i: {_LEADS}[(i + doc_id) % {len(_KINDS)} + 1] || ls[i + 1]), chr(10)) AS t FROM d),
x AS (SELECT doc_id, trim(unnest(string_split(t, chr(10)))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM e),
y AS (SELECT *, CASE WHEN starts_with(line, '案例：') OR starts_with(line, '来源原文：') OR starts_with(line, '关键要点：') OR starts_with(line, '标签：') THEN split_part(line, '：', 1) END AS label FROM x WHERE line <> ''),
z AS (SELECT *, sum((label IS NOT NULL)::INT) OVER w AS g, lead(line) OVER w AS next, lead(label) OVER w AS next_label, CASE WHEN label IS NOT NULL THEN substr(line, length(label) + 2) END AS value FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
v AS (SELECT *, coalesce(max((label IS NOT NULL AND value = '' AND next_label IS NULL AND starts_with(next, '- '))::INT) OVER (PARTITION BY doc_id, g), 0) = 1 AS inside FROM z),
u AS (SELECT *, sum((label IS NOT NULL OR NOT inside)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS pos, sum((inside AND label IS NULL AND starts_with(line, '- '))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS item FROM v),
items AS (SELECT doc_id, pos, item, string_agg(CASE WHEN starts_with(line, '- ') THEN substr(line, 3) ELSE line END, chr(10) ORDER BY i) AS t FROM u WHERE inside AND label IS NULL GROUP BY ALL),
lists AS (SELECT doc_id, pos, count(*) AS n, string_agg(t, '|' ORDER BY item) AS t FROM items GROUP BY ALL),
s AS (SELECT doc_id, pos, CASE WHEN label IS NULL THEN 'plain' WHEN value = '' THEN 'block' ELSE 'field' END AS kind, label, CASE WHEN label = '来源原文' THEN 'source' WHEN label IS NOT NULL THEN 'generated' END AS origin, CASE WHEN label IS NULL THEN line WHEN value <> '' THEN value END AS value FROM u WHERE label IS NOT NULL OR NOT inside)"""

QUERIES = {
    "answer_keys_renamed": (answer_keys_renamed, f"WITH {_OBJECTS} SELECT doc_id, CASE WHEN refused IS NULL THEN md5(outside) END AS digest, refused FROM o"),
    "answer_keys_restored": (answer_keys_restored, f"WITH {_OBJECTS} SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN md5(inside) END AS digest, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN refused = 'invalid_json' THEN refused ELSE 'english_key' END END AS refused FROM o WHERE doc_id % 3 = 0 OR refused IS NULL"),
    "object_fingerprints": (object_fingerprints, """SELECT doc_id, sha256('{"body":{"lang":"' || lang || '","text":' || to_json(text) || '},"n_chars":' || n_chars || ',"source":"' || source || '"}') AS fingerprint, true AS same FROM documents"""),
    "run_fingerprints": (run_fingerprints, f"""WITH o AS (SELECT *, o_custkey % 120 AS n, o_custkey % 23 AS k, CASE WHEN o_orderstatus = 'P' THEN 'blank_text' WHEN o_custkey % 120 NOT BETWEEN 1 AND 100 OR o_custkey % 23 NOT BETWEEN 1 AND 20 THEN 'limits' WHEN o_custkey % 23 > o_custkey % 120 THEN 'more_hits_than_candidates' WHEN o_orderkey % 50 = 0 THEN 'collections' END AS refused FROM orders)
SELECT o_orderkey, refused, CASE WHEN refused IS NULL THEN sha256('{{"Milvus地址":"{trees.LOCAL_INDEX}","初检候选数":' || n || ',"同模型裁判":false,"最终证据数":' || k || ',"知识集合统计":{{"case":{{"存在":true,"数据量":' || (o_orderkey % 50 - 1) || '}},"script":{{"存在":' || (o_custkey % 2 = 0) || ',"数据量":' || o_custkey || '}}}},"裁判模型名":"judge","评分版本":"' || o_orderpriority || '","输入SHA256":"' || sha256(o_orderkey::VARCHAR) || '","问答模型名":"answer"}}') END AS fingerprint FROM o"""),
    "evidence_segments": (evidence_segments, f"WITH {_SEGMENTS} SELECT doc_id, pos::INT AS pos, kind, label, origin, md5(value) AS value, CASE WHEN kind = 'block' THEN coalesce(n, 0)::INT END AS n_items, CASE WHEN kind = 'block' THEN md5(coalesce(t, '')) END AS items FROM s LEFT JOIN lists USING (doc_id, pos)"),
    "evidence_structured": (evidence_structured, f"WITH {_SEGMENTS} SELECT doc_id, bool_or(kind <> 'plain') AS structured FROM s GROUP BY doc_id"),
    "section_materials": (section_materials, f"""WITH RECURSIVE d AS (SELECT source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS i, '===== 来源：text ｜ 文件：' || lang || '.txt ｜ source_id：' || doc_id || ' =====' AS head, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents WHERE trim(text) <> ''),
n AS (SELECT source, lang, i, head, array_to_string(list_transform(range(1, len(ls) + 1), lambda k: 'L' || printf('%03d', k) || ': ' || ls[k]), chr(10)) AS t FROM d),
fold(source, lang, i, m, over) AS (SELECT source, lang, 0::BIGINT, '案例：' || source || chr(10) || chr(10) || '章节：' || lang || chr(10) || chr(10) || '请基于以下原始素材采集销售证据。' || chr(10) || chr(10) || '引用定位要求：素材正文带 L 行号，source_refs.locator 必须填写 line_start/line_end。', false FROM (SELECT DISTINCT source, lang FROM documents)
UNION ALL SELECT f.source, f.lang, n.i, m || chr(10) || chr(10) || CASE WHEN {materials.MAX_CHARS} - length(m) - length(head) - 4 <= 8 THEN '[后续素材因上下文长度限制省略]' || chr(10) || '[内容已截断]' ELSE head || chr(10) || CASE WHEN length(t) > {materials.MAX_CHARS} - length(m) - length(head) - 4 THEN rtrim(left(t, {materials.MAX_CHARS} - length(m) - length(head) - 12), chr(10) || ' ') || chr(10) || '[内容已截断]' ELSE t END END, {materials.MAX_CHARS} - length(m) - length(head) - 4 <= 8
FROM fold f JOIN n ON n.source = f.source AND n.lang = f.lang AND n.i = f.i + 1 WHERE NOT over)
SELECT source, lang, length(m) AS n_chars, md5(m) AS digest FROM (SELECT source, lang, arg_max(m, i) AS m FROM fold GROUP BY ALL)"""),
}
