"""Cases, contracts and streams on inline tables."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.operators import cases, chunking, contracts
from tessera.plans.index import IndexTable
from tessera.streaming.incremental import chunk_stream, upsert_stream

from .test_operators import value


def test_case_ids(spark):
    assert value(spark, cases.case_id(F.col("text")), " Ａ客户 / Case ") .startswith("a客户_case_")
    assert value(spark, cases.case_id(F.col("text")), "///").startswith("case_")


def test_chunk_text_keeps_empty_labels(spark):
    got = value(spark, cases.chunk_text("话术", [("阶段", F.lit(""))], [("要点", F.split("text", ",")), ("空", F.array().cast("array<string>"))]), "a, b,,")
    assert got == "知识类型：话术\n阶段：\n要点：\n- a\n- b"


def plain_deltas(answer, size=18):
    out, buffer = [], ""
    for c in answer:
        buffer += c
        if c in "。！？；\n" or len(buffer) >= size:
            out, buffer = [*out, buffer], ""
    return [*out, buffer] if buffer else out


@pytest.mark.parametrize("answer", ["", "短。", "x" * 40, "一二三。四五六！" + "七" * 30 + "\n" + "八" * 17 + "。", "\n\n。"])
def test_deltas_match_a_loop(spark, answer):
    assert value(spark, cases.deltas(F.col("text")), answer) == plain_deltas(answer)


def test_numbers_are_not_cut(spark):
    lines = value(spark, cases.numbered(F.col("text")), "\n".join("x" * 2345)[: 2 * 2345 - 1]).split("\n")
    assert [lines[i] for i in (0, 998, 999, 1000, 2344)] == ["L001: x", "L999: x", "L1000: x", "L1001: x", "L2345: x"]
    assert value(spark, cases.numbered(F.col("text")), "a\r\nb\x0bc\n\n") == "L001: a\nL002: b\nL003: c\nL004: " and value(spark, cases.numbered(F.col("text")), "") == ""
    ids = {r.i: r.chunk_id for r in chunking.segment_ids(spark.range(1, 10012).select(F.lit(7).alias("doc_id"), F.col("id").alias("i")), "doc_id", ["i"], "course").collect()}
    assert len(set(ids.values())) == 10011 and [ids[i] for i in (1, 9999, 10000, 10001)] == ["course__7__0001", "course__7__9999", "course__7__10000", "course__7__10001"]


def test_numbered_lines_are_those_of_the_sql(spark, tmp_path):
    texts = [None, "", "\n", "\n\n", "a", "\na\n", "a\r\nb\r\n", "a\rb\r", "a\x0bb\x0c", "a\x1cb\x1e", "a\x85b", "a\u2028b\u2029", "a\n\r", "\n".join("x" * 1001)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = {i: t.removesuffix("\n").split("\n") for i, t in enumerate(texts) if t is not None}
    expected = {i: hashlib.md5("\n".join(f"L{n:03d}: {x}" for n, x in enumerate(own, 1)).encode()).hexdigest() for i, own in lines.items()}
    assert dict(__spark_entry__.queries()["numbered_lines"](spark, str(tmp_path)).collect()) == {0: None, **expected}


def test_notes(spark):
    notes = "intro\n教学时间：5分钟\n教学目标：理解需求\n第二行\n【教学方式】：讲授"
    assert value(spark, cases.notes_kept(F.col("text")), notes) == "intro\n教学目标：理解需求\n第二行"
    assert value(spark, cases.notes_kept(F.col("text")), "no fields") == "no fields"
    assert value(spark, cases.audience(F.col("text"), [("新人", "新人"), ("主管", "主管")]), "课/主管培训") == "主管"
    assert value(spark, cases.audience(F.col("text"), []), "x") == "通用"


def greedy(rows):
    entries = []
    for kind, text, refs in rows:
        match = "".join(text.split())
        hit = next((e for e in entries if e["kind"] == kind and e["match"] == match), None)
        if hit is None:
            for r in refs:
                hit = next((e for e in entries if e["kind"] == kind and r in e["seen"] and e["seen"][r]), None)
                if hit:
                    break
        if hit is None:
            hit = {"kind": kind, "match": match, "refs": {}, "seen": {}}
            entries.append(hit)
        for r in refs:
            hit["refs"][r] = True
            hit["seen"].setdefault(r, not any(r in e["seen"] and e["seen"][r] for e in entries if e is not hit and e["kind"] == kind))
    return [(f"E{i:03d}", e["kind"], len(e["refs"])) for i, e in enumerate(entries, 1)]


def test_catalog_matches_a_greedy_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice(["x y", "xy", "z", "w", "v"]), [(f"#{rng.randint(0, 5)}", "q") for _ in range(rng.randint(0, 2))]) for _ in range(40)]
    df = spark.createDataFrame([(1, i, k, t, [{"anchor_id": a, "quote": q} for a, q in r]) for i, (k, t, r) in enumerate(rows)], "case_id long, pos int, kind string, text string, refs array<struct<anchor_id: string, quote: string>>")
    got = cases.evidence_catalog(df.repartition(3)).orderBy("evidence_id").collect()
    assert [(r.evidence_id, r.kind, r.n_refs) for r in got] == greedy(rows)


def test_contracts(spark):
    code = lambda r, u, why: value(spark, contracts.feedback_codes(F.lit(r), F.lit(u), F.lit(why)))
    assert code("accurate", "correct", "") == [] and code("accurate", "not_applicable", "") == ["combination"]
    assert code("inaccurate", "not_applicable", " ") == ["reason"] and code("x", "correct", "") == ["retrieval"]
    assert contracts.kb_limits(50) == (50, 50) and contracts.kb_limits(3) == (20, 3)
    for bad in (lambda: contracts.kb_limits(0), lambda: contracts.limits_checked(5, 6), lambda: contracts.limits_checked(True, 1), lambda: contracts.domains_checked(["x"])):
        with pytest.raises(ValueError):
            bad()
    assert contracts.domains_checked([" 产品知识", "产品知识"]) == ["产品知识"]
    kinds = lambda *t: value(spark, contracts.source_kinds(F.array(*map(F.lit, t)).cast("array<string>")))
    assert (kinds("case"), kinds("course"), kinds("case", "course"), kinds()) == (["绩优案例"], ["培训资料"], [], [])
    assert value(spark, contracts.targets_repaired(F.lit("journey_search"), F.array(F.lit("course")))) == ["case", "course"]
    fix = lambda intent, targets, types=(), needs=True: value(spark, contracts.targets_repaired(F.lit(intent), F.array(*map(F.lit, targets)).cast("array<string>"), F.array(*map(F.lit, types)).cast("array<string>"), F.lit(needs)))
    assert fix("any", ["course"], ["script"]) == fix("any", ["case"], ["knowledge_entry"]) == fix("any", []) == fix("any", ["odd"]) == ["case", "course"]
    assert fix("any", ["course", "course"]) == fix("out_of_scope", ["course"], ["script"]) == fix("journey_search", ["course"], [], False) == ["course"]
    where = lambda page=None, slide=None, first=None, last=None, path=(): value(spark, contracts.display_location(F.lit(page), F.lit(slide), F.lit(first), F.lit(last), F.array(*map(F.lit, path)).cast("array<string>")))
    assert where(first=2, last=4) == "L2-L4" and where(3, 5, 9, 9, ["one", " two "]) == "p3 · slide5 · L9 · one / two"
    assert where() == where(path=[" ", ""]) == where(page=0) == "未提供精确位置"
    assert value(spark, contracts.display_excerpt(F.lit(" "), F.lit(" quote "))) == "quote" and value(spark, contracts.display_excerpt(F.lit("kept"), F.lit("quote"))) == "kept"
    assert value(spark, contracts.error_code(F.col("text")), "TimeoutError") == "504" and value(spark, contracts.error_code(F.col("text")), "Odd") == "500"
    assert value(spark, contracts.secret_keys(F.col("text")), '{"a":{"apiKey":"1"}}') and value(spark, contracts.secret_keys(F.col("text")), '{"u":"http://a:b@c"}') and not value(spark, contracts.secret_keys(F.col("text")), '{"u":"http://c"}')


def test_stream_upserts_once(spark, tmp_path):
    schema = "chunk_id string, text string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = IndexTable(spark, f"file://{tmp_path}/table")
    for rows in ([("a", "1"), ("b", "1")], [("b", "2"), ("c", "2")]):
        write(rows)
        upsert_stream(chunk_stream(spark, f"{tmp_path}/in", schema), table, f"{tmp_path}/check", "text").awaitTermination()
    assert {(r.chunk_id, r.text) for r in table.read().collect()} == {("a", "1"), ("b", "2"), ("c", "2")}
    assert table.manifest()["streams"] == {f"{tmp_path}/check": 1}


def test_registry():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and "hybrid_boosted" in queries


def test_tag_lines(spark):
    from tessera.operators import tagging

    text = "case: a\n知识类型：x\n 标签：p/q/r； ；s \nbody\n标签：s；t\n"
    assert value(spark, tagging.tag_paths(F.array(F.lit(" s "), F.lit("")), F.col("text")), text) == ["s", "p/q/r", "t"]
    assert value(spark, tagging.without_tag_lines(F.col("text")), text) == "case: a\n知识类型：x\nbody"
    put = lambda t: value(spark, tagging.with_tag_line(F.col("text"), F.lit("标签：z")), t)
    assert put("a\n知识类型：x\nb\n知识类型：y") == "a\n知识类型：x\n标签：z\nb\n知识类型：y" and put("a\nb") == "a\n标签：z\nb" and put("") == "标签：z" and put("a") == "a\n标签：z"
    assert value(spark, tagging.tag_line(F.array(F.lit("a"), F.lit(" "), F.lit("b")))) == "标签：a；b" and value(spark, tagging.tag_line(F.lit(None).cast("array<string>"))) == ""
    parts = value(spark, tagging.path_parts(F.array(*map(F.lit, ("销售技能/c/t/more", "客户经营/c/u", "客户经营/d", "其他/c/t")))))
    assert (parts.business_domains, parts.business_categories, parts.business_tags) == (["销售技能", "客户经营"], ["c"], ["t", "u"])
    cited = F.array(F.struct(F.lit("Quote").alias("quote"), F.lit("").alias("context"), F.lit(None).cast("string").alias("source_excerpt")))
    assert value(spark, tagging.haystack(F.col("text"), [F.lit("Stage"), F.lit("")], cited), "Body") == "body\nstage\nquote"


def test_rows_of_an_index(spark):
    from tessera.operators import records
    from tessera.sources.chunks import CHUNK

    cite = lambda n: {"quote": "q", "context": "long", "source_excerpt": "e" * n, "locator": {"page": "3"}}
    chunks = spark.createDataFrame([("1", "script", " t ", {"stage": "s", "x": "y"}, [cite(900), cite(5)], "f"), ("2", "script", "", None, None, "f"), ("3", "script", "t", {}, [cite(600)] * 200, "f")], CHUNK)
    rows = {r.chunk_id: r for r in records.flattened(chunks).collect()}
    assert (rows["1"].stage, rows["1"].case_name, rows["1"].text_hash) == ("s", "", hashlib.sha256(b"t").hexdigest())
    cited = json.loads(rows["1"].citations_json)
    assert [len(c["source_excerpt"]) for c in cited] == [600, 5] and "context" not in cited[0] and rows["2"].citations_json == "[]"
    most = json.loads(rows["3"].citations_json)
    size = len(rows["3"].citations_json.encode())
    assert size <= records.MOST_CITATIONS < size + len(json.dumps(most[0], separators=(",", ":"))) + 2
    back = {r.chunk_id: r for r in records.restored(records.flattened(chunks)).collect()}
    assert back["1"].metadata == {"stage": "s", "x": "y"} and back["1"].citations[0].locator == {"page": "3"} and back["1"].text == " t " and back["2"].citations == []


def test_answers_with_evidence_and_without(spark):
    from tessera.operators import answer

    kind = "id string, rank int, chunk_id string, chunk_type string, text string, citations array<struct<filename: string, section_name: string, location: string, source_excerpt: string, quote: string>>"
    hits = spark.createDataFrame([("a", 2, "c2", "script", "two", [("g", None, "", "", "q3")]), ("a", 1, "c1", "script", "one", [("f", "s", "L2", "e1", "q1"), ("f", "s", "", None, "q2")]), ("b", 1, "c3", "t", "three", [])], kind)
    texts = {r.id: r.evidence for r in answer.evidence_texts(hits, "id", "rank").collect()}
    assert texts["a"] == "[证据1]\nchunk_id：c1\n知识类型：script\n内容：one\n[引用1] 文件：f；章节：s；位置：L2；原文：e1\n[引用2] 文件：f；章节：s；位置：；原文：q2\n\n[证据2]\nchunk_id：c2\n知识类型：script\n内容：two\n[引用3] 文件：g；章节：；位置：；原文：q3"
    assert texts["b"].endswith("内容：three")
    asked = spark.createDataFrame([("a", "?"), ("z", "??")], "id string, query string")
    out = {r.id: (r.answer, r.reason) for r in answer.answered(asked, answer.evidence_texts(hits, "id", "rank"), "id", lambda t: t.select("id", F.concat("query", F.lit("!")).alias("answer"))).collect()}
    assert out == {"a": ("?!", ""), "z": (answer.NO_EVIDENCE, "检索结果为空")}


def test_requests_of_the_knowledge_base(spark):
    ok = contracts.kb_request(" q ", ["产品知识"], None, "hybrid", {}, 30)
    assert (ok["code"], ok["query"], ok["domains"], ok["top_n"], ok["top_k"], ok["searched"]) == ("0", "q", ["产品知识"], 30, 30, True)
    assert contracts.kb_request("q", types=["qa"])["searched"] is False and contracts.kb_request("q")["top_k"] == 10
    for bad in ({"query": " "}, {"query": "q", "domains": ["x"]}, {"query": "q", "mode": "VECTOR"}, {"query": "q", "weights": 1}, {"query": "q", "top_k": 51}, {"query": "q", "top_k": 0}):
        assert contracts.kb_request(**bad)["code"] == "10004"


def test_a_folder_is_normalised_whole_or_not(spark, tmp_path):
    from tessera.operators import classify
    from tessera.plans.normalisation import judged, published, report

    rules, ties = {"a": ["alpha"], "b": ["beta"]}, ["b", "a"]
    rows = [("chunk/x.chunks.jsonl", 1, "1", ["a", "b"]), ("chunk/x.chunks.jsonl", 2, "1", ["a"]), ("case/chunks.jsonl", 1, "2", ["b"])]
    def run(rows):
        df = spark.createDataFrame(rows, "relative string, line_no int, chunk_id string, labels array<string>")
        return judged(df, classify.domain_scores(rules, {"labels": F.col("labels")}), ties)
    out = f"file://{tmp_path}/out"
    good = run(rows)
    assert {(r.relative, r.line_no): r.issue for r in good.collect()} == {("chunk/x.chunks.jsonl", 1): None, ("chunk/x.chunks.jsonl", 2): "deduplicated_chunk_id", ("case/chunks.jsonl", 1): None}
    assert {(r.section, r.value): r.n for r in report(good).collect()} == {("total", "input_chunks"): 3, ("total", "chunks"): 2, ("total", "multi_domain_chunks"): 1, ("source_kind", "培训资料"): 1, ("source_kind", "绩优案例"): 1, ("primary_domain", "b"): 2, ("domain", "b"): 2, ("domain", "a"): 1, ("issue", "deduplicated_chunk_id"): 1}
    columns = ["chunk_id", "domain_tags", "source_kind", "line_no"]
    assert published(spark, good, out, columns) and spark.read.option("pathGlobFilter", "part-*").json(out).count() == 2
    bad = run([*rows, ("x/y/z.jsonl", 1, "3", ["a"]), ("case/chunks.jsonl", 2, "1", ["a"]), ("chunk/x.chunks.jsonl", 3, "4", [])])
    assert {r.issue for r in bad.collect()} == {None, "unsupported_path", "duplicate_chunk_id_source_conflict", "unclassified"}
    assert not published(spark, bad, out, columns) and spark.read.option("pathGlobFilter", "part-*").json(out).count() == 2
    assert json.loads((tmp_path / "out.classification_report.json").read_text())["published"] is False
    assert published(spark, good, out, columns) and not (tmp_path / "out.classification_report.json").exists() and not published(spark, run([]), out, columns)
