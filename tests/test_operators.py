"""Expected values of the operators on inline tables."""

import hashlib
import math
import random
import re
import time
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import redaction
from tessera.functions import text as tx
from tessera.operators import answer, chunking, classify, evaluation, locate, normalize, operations, retrieval
from tessera.plans.index import IndexTable
from tessera.sources import chunks as src


def value(spark, column, text="x"):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("v")).head().v


def test_tokens_are_ngrams_of_cjk_runs_and_latin_words(spark):
    assert value(spark, tx.tokens(F.col("text")), "客户ABC 80万保费") == ["客", "户", "客户", "abc", "80", "万", "保", "费", "万保", "保费", "万保费"]
    assert value(spark, tx.tokens(F.col("text")), "") == []


def test_bm25_finds_the_budget_script(spark):
    chunks = spark.createDataFrame([(1, "客户可以通过保单整理发现家庭保障缺口", "strategy"), (2, "客户提出每年交费不能超过80万时，可以使用预算释放与置换法", "script")], "chunk_id long, text string, chunk_type string")
    queries = spark.createDataFrame([("q", "预算释放 80万")], "query_id string, query string")
    hits = retrieval.bm25(chunks.where(retrieval.matching(chunk_types=["script"])), queries, 1).collect()
    assert [h.chunk_id for h in hits] == [2] and hits[0].score > 0
    assert retrieval.bm25(chunks.limit(0), queries, 1).count() == 0


def test_bm25_deals_its_pairs_to_tasks(spark):
    chunks = spark.range(400).select(F.col("id").alias("chunk_id"), F.concat(F.lit("alpha beta w"), F.col("id").cast("string")).alias("text"))
    queries = spark.range(30).select(F.col("id").alias("query_id"), F.lit("alpha beta").alias("query"))
    # 400 * 30 * 2 pairs, narrow enough for one task by bytes
    scores = retrieval.bm25_scores(chunks, queries, tx.latin_tokens, most=1000)
    rows = scores.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in rows) == 12_000 and len(rows) > 12 and max(r["count"] for r in rows) < 2000
    assert len({r.score for r in scores.collect()}) == 1


def test_percentiles_are_exact_and_gather_no_values(spark):
    rng, wanted = random.Random(3), {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}
    for values in ([rng.choice([rng.uniform(-9, 9), float(rng.randrange(4))]) for _ in range(301)], [2.0] * 50 + [None], [1.0, 4.0], [None]):
        rows = spark.createDataFrame([(v,) for v in values], "x double")
        expected = rows.agg(*(F.percentile("x", q).alias(n) for n, q in wanted.items())).head()
        assert evaluation.percentiles(rows, "x", wanted).head() == expected


def test_postings_are_counted_within_their_row(spark):
    texts = [(1, "b a b c a b"), (2, None), (3, ""), (4, "zz"), (5, "A"), (1, "a a a b c c")]
    chunks, words = spark.createDataFrame(texts, "chunk_id long, text string"), spark.createDataFrame([("a", 2), ("b", 1)], "token string, queries long")
    rows = retrieval.postings(chunks, F.broadcast(words), tx.latin_tokens)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange hash" not in plan  # no task keeps the tokens of more than a text
    known = sorted(tuple(r) for r in rows.where("token is not null").select("chunk_id", "dl", "token", "tf", "queries").collect())
    assert known == [(1, 6, "a", 2, 2), (1, 6, "a", 3, 2), (1, 6, "b", 1, 1), (1, 6, "b", 3, 1), (5, 1, "a", 1, 2)]
    assert sorted((r.chunk_id, r.dl) for r in rows.where("first").collect() if r.dl is not None) == [(1, 6), (1, 6), (3, 0), (4, 1), (5, 1)]
    assert rows.where("first").count() == len(texts)


@pytest.mark.parametrize("most", [200_000, 1])
def test_bm25_scores_odd_chunks_as_the_formula(spark, monkeypatch, most):
    monkeypatch.setattr(retrieval, "few", lambda df: df.limit(most + 1).count() <= most)
    texts = [(1, "b a b c a b"), (2, None), (3, ""), (4, "zz"), (5, "A"), (1, "a a a b c c")]  # chunk 1 has two rows of one length
    chunks = spark.createDataFrame(texts, "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, "none"), (4, None)], "query_id long, query string")
    n, avgdl, tf, df = 6, (6 + 0 + 1 + 1 + 6) / 5, {(1, "a"): 5, (1, "b"): 4, (5, "a"): 1}, {"a": 2, "b": 1}
    part = lambda c, t, dl: math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[c, t] * 2.2 / (tf[c, t] + 1.2 * (0.25 + 0.75 * dl / avgdl))
    wanted = {(1, 1): 2 * part(1, "a", 6) + part(1, "b", 6), (1, 5): 2 * part(5, "a", 1), (2, 1): part(1, "b", 6)}
    got = {(r.query_id, r.chunk_id): r.score for r in retrieval.bm25_scores(chunks, queries, tx.latin_tokens).collect()}
    assert got == pytest.approx(wanted, abs=2e-6)


@pytest.mark.parametrize(("few", "again"), [(200_000, 0), (1, 1)])
def test_postings_go_to_many_partitions_by_way_of_few(spark, monkeypatch, few, again):
    """A task that writes more than 200 partitions keeps the rows it has read in memory."""
    monkeypatch.setattr(retrieval, "few", lambda df: df.limit(few + 1).count() <= few)
    texts = [(i, " ".join(w for j, w in enumerate("abcdefg") if (i + j) % 3) + " x" * (i % 5)) for i in range(80)]
    chunks = spark.createDataFrame(texts + texts[:again], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "a b c d a"), (2, "e f g x"), (3, "b none")], "query_id long, query string")
    scored = lambda most: retrieval.bm25_scores(chunks, queries, tx.latin_tokens, most)
    dealt = [int(x) for x in re.findall(r"hashpartitioning\(chunk_id#\d+L, (\d+)\)", scored(2)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1])]
    assert min(dealt[::2]) > 200 and {*dealt[1::2]} == {200}  # from the last to the first
    got, wanted = ({(r.query_id, r.chunk_id): r.score for r in scored(most).collect()} for most in (2, 10_000))
    assert len(got) > 100 and got == pytest.approx(wanted, abs=2e-6)


def test_vector_search_orders_by_cosine(spark):
    vectors = retrieval.normalised(spark.createDataFrame([("case-1", [1.0, 0.0, 0.0]), ("course-1", [0.9, 0.1, 0.0])], "chunk_id string, vector array<double>"))
    hits = retrieval.vector_search(vectors, spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, vector array<double>"), 2)
    assert [h.chunk_id for h in hits.orderBy("rank").collect()] == ["case-1", "course-1"]


def test_fusion_and_boost(spark):
    arm = lambda ids: spark.createDataFrame([("q", c, i + 1) for i, c in enumerate(ids)], "query_id string, chunk_id string, rank int")
    fused = retrieval.fused([arm(["vector"]), arm(["keyword", "vector"])])
    assert [r.chunk_id for r in fused.orderBy("rank").collect()] == ["vector", "keyword"]
    fused = retrieval.fused([arm(["a", "b"]), arm(["a", "c"])])
    tags = spark.createDataFrame([("a", ["销售技能", "客户经营"]), ("b", []), ("c", ["客户经营"])], "chunk_id string, domain_tags array<string>")
    asked = spark.createDataFrame([("q", ["客户经营", "销售技能"])], "query_id string, domains array<string>")
    out = retrieval.boosted(fused, tags, asked, 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.factor) for r in out] == [("a", 1.2), ("c", 1.1)]


def test_search_checks_its_limits(spark):
    with pytest.raises(ValueError):
        retrieval.search(None, None, None, None, top_n=3, top_k_=5)


def test_rules(spark):
    rules = [("objection", "claim", ["理赔难"]), ("risk", "return", ["收益一定"]), ("risk", "claim", ["保证理赔"])]
    assert value(spark, classify.rule_tags(F.col("text"), rules), "客户担心理赔难，不能承诺保证理赔，也不能说收益一定高。") == ["objection/claim", "risk/return", "risk/claim"]
    assert value(spark, classify.query_domains(F.lit("今天天气怎么样"), {"合规": ["风险"]}, ["合规"])) == []


RULES = {"产品知识": ["保障责任"], "合规与风控": ["保险法", "监管", "反洗钱", "销售误导", "合规"], "销售技能": ["促成", "促成", "异议"], "客户经营": ["客户关系", "转介绍"]}
TIES = ["合规与风控", "产品知识", "客户经营", "销售技能"]


def test_domains(spark):
    def scored(direct=None, **texts):
        return classify.domain_scores(RULES, {k: F.array(*map(F.lit, v)) for k, v in (direct or {}).items()}, {k: F.lit(v) for k, v in texts.items()})

    tags = lambda scores: value(spark, classify.domain_tags(scores, TIES))
    for d in RULES:  # a label is enough
        assert tags(scored({"tags": [d]})) == [d] and value(spark, scored({"tags": [d]}))[d] == 10
    assert tags(scored({"tags": ["产品知识", "合规与风控"]})) == ["合规与风控", "产品知识"]
    assert value(spark, scored({"tags": ["法律合规/条款", "合规与风控"], "category": ["合规风险"]})) == {"合规与风控": 20}
    weighed = scored(structured="客户关系维护与转介绍", text="保险法、监管、反洗钱和销售误导是正文里的风险内容。")
    assert value(spark, weighed) == {"客户经营": 8, "合规与风控": 4} and tags(weighed) == ["客户经营", "合规与风控"]
    assert value(spark, classify.primary_domain(weighed, TIES)) == "客户经营"
    weak = scored(text="这里只提到一次合规")
    assert value(spark, weak) == {"合规与风控": 1} and tags(weak) is None and value(spark, classify.primary_domain(weak, TIES)) is None
    assert value(spark, scored(source="促成.docx", text="促成")) == {"销售技能": 3}  # a keyword that is listed twice counts once
    values = F.array(*map(F.lit, ("产品类别/重疾", "转介绍", "销售阶段")))
    assert value(spark, classify.structured_text(values, RULES)) == "转介绍"


def test_normalisation(spark):
    rows = spark.createDataFrame([("a", "p1", 1, "case"), ("a", "p2", 1, "training"), ("b", "p1", 2, "case")], "id string, path string, line int, kind string")
    assert {(r.id, r.path) for r in normalize.keep_first(rows, "id", ["path", "line"]).collect()} == {("a", "p1"), ("b", "p1")}
    assert [r.id for r in normalize.conflicts(rows, "id", "kind").collect()] == ["a"]
    files = spark.createDataFrame([("h", "a(1).docx", False, 1), ("h", "x.docx", False, 2), ("g", "", True, 3), ("i", "b(2)", False, 4), ("i", "c.txt", False, 5), ("j", "a.txt", True, 6), ("j", "b.txt", False, 7)], "hash string, name string, empty boolean, n int")
    assert {r.n for r in normalize.preferred(files, [F.col("hash")], F.col("name"), F.col("empty"), "n").collect()} == {2, 3, 4, 7}
    chunks = spark.createDataFrame([("1", "script", "t", "f"), ("1", "other", " ", "f")], "chunk_id string, chunk_type string, text string, source_file string")
    assert sorted(r.codes for r in normalize.chunk_violations(chunks).collect()) == [["blank_text", "chunk_type", "duplicate_chunk_id"], ["duplicate_chunk_id"]]
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [float("nan"), 1.0]), ("c", [1.0]), ("d", None)], "chunk_id string, vector array<double>")
    assert {(r.chunk_id, r.code) for r in normalize.vector_violations(vectors, 2).collect()} == {("b", "not_finite"), ("c", "dimension"), ("d", "empty")}
    good = (classify.SOURCE_KINDS[0], classify.METHOD, classify.VERSION)
    tagged = [("a", "y", ["y", "x"], *good), ("b", "x", ["y", "x"], *good), ("c", "z", ["x"], *good), ("d", "x", [], *good), ("e", "y", ["x"], "other", "m", None), ("f", "x", ["x", "x", "w"], *good)]
    tagged = spark.createDataFrame(tagged, "chunk_id string, primary_domain string, domain_tags array<string>, source_kind string, domain_tagging_method string, domain_tagging_version string")
    assert {r.chunk_id: r.codes for r in normalize.domain_violations(tagged, ["y", "x"], ["x", "y"]).collect()} == {"b": ["tag_order"], "c": ["primary_domain"], "d": ["empty_tags", "primary_not_tagged"], "e": ["source_kind", "primary_not_tagged", "method", "version"], "f": ["duplicate_tags", "domain_tags"]}


def test_location(spark):
    text = "\n".join(f"line {i}" for i in range(1, 11))
    assert value(spark, locate.context(F.col("text"), F.lit(5), F.lit(5)), text) == "\n".join(f"line {i}" for i in range(2, 9))
    hit = value(spark, locate.located(F.col("text"), F.lit("line 2")), text)
    assert (hit.confidence, hit.char_start, hit.char_end) == ("exact", 7, 13)
    hit = value(spark, locate.located(F.col("text"), F.lit("zz...line 3")), text)
    assert (hit.confidence, hit.char_start) == ("approximate", 14)
    assert value(spark, locate.located(F.col("text"), F.lit("nowhere")), text).confidence == "unmatched"
    hit = value(spark, locate.located(F.col("text"), F.lit("a long part that is absent ... line 7…line 10… line 3")), text)
    assert (hit.confidence, hit.char_start, hit.char_end) == ("approximate", text.index("line 10"), text.index("line 10") + 7)
    hit = value(spark, locate.located(F.col("text"), F.lit("absent...line 9...line 4")), text)
    assert hit.char_start == text.index("line 9")  # the first of equally long parts
    docs = spark.createDataFrame([(1, "# A\nx\n## B\ny\n# C\nz")], "doc_id long, text string")
    paths = {r.line_no: r.heading_path for r in locate.heading_path(locate.lines(docs)).collect()}
    assert paths[2] == ["A"] and paths[4] == ["A", "B"] and paths[6] == ["C"]
    wanted = spark.createDataFrame([("r", "c", "p2", "f", "")], "ref_id string, case_id string, source_path string, filename string, source_id string")
    sources = spark.createDataFrame([("c", "p1", "f", "s1"), ("c", "p2", "f", "s2")], "case_id string, source_path string, filename string, source_id string")
    assert [(r.source_id, r.level) for r in locate.candidate_sources(wanted, sources).collect()] == [("s2", 0)]


def fold(items, least):
    out, buffer = [], ""
    for p in items:
        buffer = f"{buffer}\n\n{p}" if buffer else p
        if len(buffer) >= least:
            out, buffer = [*out, buffer], ""
    if buffer:
        out = [*out[:-1], f"{out[-1]}\n\n{buffer}"] if out else [buffer]
    return out


def test_only_lengths_of_pages_reach_python():
    ends = chunking._gathered.func(pd.Series([[60, 38, 5], [99], [100, 1], [], None]), pd.Series([100] * 5))
    assert ends.tolist() == [[3], [1], [2], [], None]


def pack(text, most):
    if len(text) <= most:
        return [text]
    out, buffer, size = [], [], 0
    for p in filter(str.strip, re.split(r"\n+", text)):
        if buffer and size + len(p) > most:
            out.append("\n".join(buffer))
            buffer, size = [], 0
        buffer.append(p)
        size += len(p)
    return [*out, "\n".join(buffer)] if buffer else out


@pytest.mark.parametrize("sizes", [[], [5], [60, 60, 10], [300, 5], [1999, 1, 1], [2500, 10, 2500], [50] * 90, [3] * 20_000])
def test_folds_match_loops(spark, sizes):
    items = [chr(97 + i % 26) * n for i, n in enumerate(sizes)]
    column = F.split(F.col("text"), ",") if items else F.array().cast("array<string>")
    assert value(spark, chunking.short_merged(column), ",".join(items)) == fold(items, 100)
    for text in ("\n".join(items), "\n\n".join(items) + "\n \n"):
        assert value(spark, chunking.long_split(F.col("text")), text) == pack(text, 2000)


def test_pages_and_sections(spark):
    pages = value(spark, chunking.pages_of(F.col("text")), "## 第 1 页\n目录\n## 第 2 页\nbody\nmore")
    assert [(p.page, p.text) for p in pages] == [(1, "目录"), (2, "body\nmore")]
    assert value(spark, chunking.labelled_text([("阶段", F.lit("")), ("", F.lit("")), ("", F.lit("x"))])) == "阶段：\nx"


def test_evaluation(spark):
    item = lambda name, status, gold, primary, got, cited: (name, status, gold, primary, got, cited)
    rows = [
        item("traced", "完整支持", ["c1", "c2"], "c1", ["c1", "c3"], [("1", "case/a.txt", "L2")]),
        item("untraced", "未定位", [], "", ["known"], []),
        item("half", "未定位", [], "", ["known", "other", ""], [("1", "p", "L1"), ("9", "", "L1")]),
        item("order", "部分支持", ["c1", "c2"], "c1", ["c2", "c2", "c1"], [("1", None, None), ("3", None, None), ("odd", None, None)]),
        item("bad", "完整支持", ["c1", "c2"], "c1", [None, " "], [("true", None, None), ("1.0", None, None), ("-1", None, None), ("999", None, None), ("99999999999999999999", None, None)]),
        item("none", "完整支持", ["c1"], "", None, None),
    ]
    schema = "item_id string, trace_status string, gold array<string>, primary_id string, evidences array<string>, citations array<struct<evidence_index: string, source_path: string, locator: string>>"
    known = spark.createDataFrame([("known",), ("c1",), ("c2",), ("known",)], "chunk_id string")
    out = {r.item_id: r for r in evaluation.item_scores(spark.createDataFrame(rows, schema), known).collect()}
    points = lambda n: (out[n].primary_hit, out[n].recall, out[n].retrieval_points, out[n].citation_points, out[n].deterministic_points)
    assert points("traced") == (True, 0.5, 7.5, 5.0, 12.5) and points("untraced") == (False, 0.0, 10.0, 0.0, 10.0)
    assert points("half") == (False, 0.0, 7.5, 2.5, 10.0) and points("order") == (True, 1.0, 10.0, 4.17, 14.17)
    assert points("bad") == points("none") == (False, 0.0, 0.0, 0.0, 0.0)
    parts = "item_id string, trace_status string, answer_error string, judge_error string, correctness double, keypoints double, groundedness double, relevance double, deterministic_points double, error_tags array<string>"
    rows = [("a", "x", "", "", 40.0, 20.0, 15.0, 5.005, 10.0, ["t"]), ("b", "x", "broken", "", None, None, None, None, None, None), ("c", "x", None, "broken", 1.0, 1.0, 1.0, 1.0, 1.0, None)]
    done = {r.item_id: (r.status, r.total_score, r.error_tags) for r in evaluation.totals(spark.createDataFrame(rows, parts)).collect()}
    assert done == {"a": ("已完成", 90.01, ["t"]), "b": ("问答失败", 0.0, ["问答执行失败"]), "c": ("评测失败", None, ["裁判执行失败"])}
    rows = [("问答失败", 0.0)] + [("评测失败", None)] * 2 + [("已完成", 90.0)] * 5 + [("已完成", 80.0)] * 25 + [("已完成", 50.0)] * 17
    s = evaluation.summary(spark.createDataFrame(rows, "status string, total_score double")).head()
    assert (s.n_items, s.n_judge_failed, s.n_answer_failed, s.n_scored, s.conservative_rate, s.effective_rate, s.excellent_rate, s.answer_rate, s.p50) == (50, 2, 1, 48, 0.6, 0.625, 0.1, 0.98, 80.0)
    empty = evaluation.summary(spark.createDataFrame([], "status string, total_score double")).head()
    assert (empty.n_items, empty.mean_score, empty.primary_hit_rate) == (0, 0.0, 0.0)
    assert value(spark, evaluation.valid_indexes(F.array(*map(F.lit, (3, 1, 1, 0, 9))), F.array(*map(F.lit, "abc")))) == [3, 1]


def test_answers(spark):
    rows = spark.createDataFrame([("q", 1, ["a", "b"]), ("q", 2, ["c"])], "id string, rank int, citations array<string>")
    flat = answer.flattened(rows, "id", "rank", "citations")
    assert [(r.evidence_index, r.citation_index, r.citation) for r in flat.orderBy("citation_index").collect()] == [(1, 1, "a"), (1, 2, "b"), (2, 3, "c")]
    chosen = spark.createDataFrame([("q", [3, 1, 3, 7])], "id string, indexes array<int>")
    assert [r.citation for r in answer.selected(flat, chosen, "id").orderBy("place").collect()] == ["c", "a"]
    drafts = spark.createDataFrame([("d", ["[e001]", "E9"])], "draft_id string, evidence_ids array<string>")
    found, unknown = answer.catalog(drafts, spark.createDataFrame([("E001", "s")], "evidence_id string, summary string"))
    assert found.head().summary == "s" and unknown.head().raw == "E9"


def test_operations(spark):
    events = spark.createDataFrame([("r", 1, "pending"), ("r", 2, "running"), ("r", 3, "pending")], "run_id string, n int, status string")
    assert operations.latest(events, "run_id", ["n"]).head().status == "pending"
    assert [r.n for r in operations.violations(events, "run_id", ["n"]).collect()] == [3]


def plain_log(kinds, cap):
    """The log after each event in turn: [number, place of the event, type, merged, latest type]."""
    log, fits = [], ("item_running", "item_completed")
    for i, kind in enumerate(kinds):
        if len(log) >= cap and kind in fits:
            row = next((r for r in log if r[2] == "progress_compacted"), None) or next((r for r in reversed(log) if r[2] in fits), None)
            if row:
                row[2:] = ["progress_compacted", row[3] + 1, kind]
                continue
        if len(log) >= cap:
            row = next((r for r in log if r[2] in (*fits, "progress_compacted")), None)
            if row is None:
                continue
            log.remove(row)
        log.append([max((r[0] for r in log), default=0) + 1, i, kind, 1, kind])
    return log


def test_full_logs_give_up_progress_only(spark):
    rng = random.Random(5)
    keys = {k: [rng.choice(["item_running", "item_completed", *["state"] * (k % 4)]) for _ in range(rng.randint(0, 60))] for k in range(40)}
    keys[40] = ["state"] * 30
    rows = [(k, i, kind) for k, kinds in keys.items() for i, kind in enumerate(kinds)]
    rng.shuffle(rows)
    out = operations.compacted(spark.createDataFrame(rows, "job long, n int, event_type string"), ["job"], ["n"], 8).collect()
    assert sorted((r.job, r.sequence, r.n, r.event_type, r.merged, r.latest_type) for r in out) == sorted((k, *row) for k, kinds in keys.items() for row in plain_log(kinds, 8))
    assert operations.compacted(spark.createDataFrame([], "job long, n int, event_type string"), ["job"], ["n"], 8).count() == 0


def test_index_table(spark, tmp_path):
    table = IndexTable(spark, f"file://{tmp_path}/t", dim=2)
    rows = lambda *x: spark.createDataFrame(list(x), "chunk_id string, text string, vector array<double>")
    assert table.read() is None
    table.rebuild(rows(("a", "1", [1.0, 0.0]), ("b", "1", [0.0, 1.0])))
    assert table.upsert(rows(("b", "2", [0.0, 1.0]), ("c", "2", [1.0, 1.0])), "batch-1")
    assert not table.upsert(rows(("b", "3", [0.0, 1.0])), "batch-1")
    assert {(r.chunk_id, r.text) for r in table.read().collect()} == {("a", "1"), ("b", "2"), ("c", "2")}
    with pytest.raises(ValueError):
        table.upsert(rows(("d", "x", [1.0])))
    assert table.read().count() == 3
    table.delete(spark.createDataFrame([("a",)], "chunk_id string"))
    assert table.read().count() == 2
    assert table.rollback() and table.read().count() == 3
    table.upsert(rows(("e", "1", [0.0, 1.0])), "stream#4")
    assert not table.upsert(rows(("e", "2", [0.0, 1.0])), "stream#3") and not table.upsert(rows(("e", "2", [0.0, 1.0])), "stream#4")
    table.rollback()
    assert table.upsert(rows(("e", "2", [0.0, 1.0])), "stream#4") and {r.text for r in table.read().where("chunk_id = 'e'").collect()} == {"2"}
    gone = table.vacuum()
    assert gone and table.read().count() == 4 and len(table._numbers()) == 2
    table.rebuild(rows())
    assert table.read().count() == 0 and table.read().columns == ["chunk_id", "text", "vector"]


def test_index_rolls_back_after_vacuum(spark, tmp_path):
    table = IndexTable(spark, f"file://{tmp_path}/t")
    for i in range(4):
        table.upsert(spark.createDataFrame([(f"c{i}", "x")], "chunk_id string, text string"))
    assert table.rollback() and table.read().count() == 3
    table.vacuum()
    assert table.rollback() and table.read().count() == 2
    assert not table.rollback() and table.read().count() == 2  # what came before is deleted


def test_index_writers_do_not_lose_rows(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    rows = lambda *x: spark.createDataFrame(list(x), "chunk_id string, n int")
    one, other = IndexTable(spark, root), IndexTable(spark, root)
    one.rebuild(rows(*((f"k{i}", 0) for i in range(100))))
    commit, between = one._commit, [lambda: other.upsert(rows(("k1", 2), ("new", 2))), lambda: other.delete(spark.createDataFrame([("k2",)], "chunk_id string"))]

    def interrupted(*args):
        if between:
            between.pop()()
        return commit(*args)

    monkeypatch.setattr(one, "_commit", interrupted)
    assert one.upsert(rows(("k1", 1), ("mine", 1)), "b")  # the third try, on what the other writer left
    got = {r.chunk_id: r.n for r in one.read().collect()}
    assert len(got) == 101 and (got["k1"], got["mine"], got["new"]) == (1, 1, 2) and "k2" not in got
    before = {r.chunk_id: r.n for r in one.read().collect()}
    for step in ("_checked", "_publish"):  # a writer that dies at any step leaves the last version
        with monkeypatch.context() as m:
            m.setattr(one, step, lambda *a: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                one.upsert(rows(("k5", 9)))
        assert {r.chunk_id: r.n for r in other.read().collect()} == before
    touched = set(one.manifest()["parts"].items())
    one.upsert(rows(("k5", 9)))
    assert len(set(one.manifest()["parts"].items()) - touched) == 1  # one bucket is written anew


def test_vector_search_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    unit = lambda: (lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v])([rng.gauss(0, 1) for _ in range(5)])
    own, asked = [(f"c{i:03d}", unit()) for i in range(200)] + [("none", None)], [(i, unit()) for i in range(30)]
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    for most in (1000, 3):
        monkeypatch.setattr(retrieval, "MAX_QUERY_VECTORS", most)
        out = retrieval.vector_search(spark.createDataFrame(own, "chunk_id string, vector array<double>").repartition(3), spark.createDataFrame(asked, "query_id int, vector array<double>"), 4)
        got = {(r.query_id, r.rank): r.chunk_id for r in out.collect()}
        for q, v in asked:
            best = sorted((-round(sum(a * b for a, b in zip(v, w)), 6), c) for c, w in own if w)[:4]
            assert [got[q, k] for k in range(1, 5)] == [c for _, c in best]
        assert len(got) == 120
    assert retrieval.vector_search(spark.createDataFrame([], "chunk_id string, vector array<double>"), spark.createDataFrame(asked, "query_id int, vector array<double>"), 4).count() == 0


def test_messages_that_may_be_stored(spark):
    safe = lambda text: value(spark, redaction.safe_message(F.col("text")), text)
    assert safe("my_api_key = 'a b', token:x1; next") == "my_api_key=[已隐藏敏感信息], token=[已隐藏敏感信息]; next"
    assert safe("sent Bearer abc.def, done") == "sent Bearer [已隐藏敏感信息], done"
    assert safe("in /var/log/a b.log and C:\\temp\\x.txt, \\\\host\\share\\f; http://h") == "in [已隐藏路径] b.log and [已隐藏路径], [已隐藏路径]; http://h"
    for stack in ("Traceback (most recent call last)", 'x\n  File "a.py", line 3', "at a.b(C.java:1)", "stack trace follows"):
        assert safe(stack) == "内部处理信息已隐藏"
    assert safe("x" * 3000) == "x" * 2000
    assert value(spark, redaction.safe_message(F.lit(None).cast("string"))) is None and safe("") == ""
    began = time.monotonic()
    for long in ("a-" * 100_000, "/" * 200_000, "a/" * 100_000, "C:\\" * 70_000, "token " * 40_000, "='" * 100_000, "at x(" * 40_000):
        assert len(safe(long)) <= 2000
    assert time.monotonic() - began < 30


def test_sources(spark, tmp_path):
    (tmp_path / "chunk").mkdir()
    (tmp_path / "chunk" / "a.chunks.jsonl").write_text('{"chunk_id":"1","chunk_type":"script","text":"t"}\n\nnot json\n{"chunk_id":"2","zzz":1}\n')
    good, bad = src.chunks_and_errors(spark, str(tmp_path))
    assert [(r.chunk_id, r.line_no) for r in good.collect()] == [("1", 1)]
    assert sorted((r.line_no, r.code) for r in bad.collect()) == [(3, "invalid_json"), (4, "unknown_field")]
    assert value(spark, src.source_kind(F.col("text")), "chunk/a.chunks.jsonl") == "培训资料"
    assert value(spark, src.source_kind(F.col("text")), "x/y/chunks.jsonl") is None
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "g.txt").write_bytes("客户".encode("gbk"))
    texts = {r.path.rsplit("/", 1)[-1]: r.text for r in src.office_texts(spark, str(tmp_path)).collect()}
    assert texts["d.docx"] == "# Title\nBody" and texts["g.txt"] == "客户"
    with pytest.raises(ValueError, match="line 3: invalid_json"):
        src.strict_chunks(spark, str(tmp_path))
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    assert [(r.entry, r.code) for r in src.zip_violations(spark, str(tmp_path / "broken.zip")).collect()] == [("", "unreadable")]
    with zipfile.ZipFile(tmp_path / "u.zip", "w") as z:
        z.writestr("ok.txt", "x")
        z.writestr("../evil.txt", "x")
    assert [(r.entry, r.code) for r in src.zip_violations(spark, str(tmp_path / "u.zip")).collect()] == [("../evil.txt", "path")]
    (tmp_path / "q.csv").write_text('question,answer\n"a, ""b""",1\n,2\nc,\n')
    assert [(r.row_index, r.question, r.answer) for r in src.question_table(spark, str(tmp_path / "q.csv")).orderBy("row_index").collect()] == [(1, 'a, "b"', "1"), (2, "c", "")]


def test_slides_and_sections(spark, tmp_path):
    a, p, r = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    words = lambda *lines: "<p:txBody>" + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in lines) + "</p:txBody>"
    slide = lambda inner: f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>'
    rels = lambda *x: "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{r}/{k}" Target="{t}"/>' for i, k, t in x) + "</Relationships>"
    cell = lambda x: f"<a:tc><a:txBody><a:p><a:r><a:t>{x}</a:t></a:r></a:p></a:txBody></a:tc>"
    folder = tmp_path / "root" / "case" / "one"
    folder.mkdir(parents=True)
    with zipfile.ZipFile(folder / "d.pptx", "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation xmlns:p="{p}" xmlns:r="{r}"><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r3"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", rels(("r1", "slide", "slides/slide1.xml"), ("r2", "slide", "slides/slide2.xml"), ("r3", "slide", "/ppt/slides/slide3.xml")))
        z.writestr("ppt/slides/slide1.xml", slide(f"<p:sp>{words('last', 'line')}</p:sp>"))
        z.writestr("ppt/slides/slide2.xml", slide(f"<p:sp>{words('first')}</p:sp><p:graphicFrame><a:tbl><a:tr>{cell('x')}{cell('')}{cell('y')}</a:tr><a:tr>{cell('')}</a:tr></a:tbl></p:graphicFrame>"))
        z.writestr("ppt/slides/slide3.xml", slide("<p:sp/>"))
        z.writestr("ppt/slides/_rels/slide2.xml.rels", rels(("n", "notesSlide", "../notesSlides/notesSlide1.xml")))
        z.writestr("ppt/notesSlides/notesSlide1.xml", f'<p:notes xmlns:p="{p}" xmlns:a="{a}"><p:sp><p:nvSpPr><p:nvPr><p:ph type="sldNum"/></p:nvPr></p:nvSpPr>{words("7")}</p:sp><p:sp><p:nvSpPr><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr>{words("say this")}</p:sp></p:notes>')
        z.writestr("ppt/media/image1.png", b"png")
    for name, text in (("a.txt", "same"), ("a (1).txt", "same"), ("b(2).txt", "other"), ("c.bin", "x")):
        (folder / name).write_text(text)
    (folder.parent / "top.txt").write_text("top")
    texts = src.office_texts(spark, f"{tmp_path}/root")
    assert {r.path.rsplit("/", 1)[-1]: r.text for r in texts.collect()}["d.pptx"] == "## 第 1 页\nfirst\nx | y\n### 讲师备注\nsay this\n\n## 第 3 页\nlast\nline"
    found = {(r.case_name, r.section_name, r.filename) for r in src.case_sections(texts, f"{tmp_path}/root").collect()}
    assert found == {("case", "one", "d.pptx"), ("case", "one", "a.txt"), ("case", "one", "b(2).txt"), ("case", "case", "top.txt")}
    assert [(r.image, r.size, r.sha256) for r in src.office_images(spark, f"{tmp_path}/root").collect()] == [("ppt/media/image1.png", 3, hashlib.sha256(b"png").hexdigest())]


def test_streams_of_first_rows_and_rates(spark, tmp_path):
    from tessera.streaming.incremental import event_rates, first_come

    rows = spark.createDataFrame([("a", "x", "2024-01-01 00:01:00", 1), ("a", "x", "2024-01-01 00:02:00", 2), ("b", "y", "2024-01-01 00:11:00", 3)], "key string, kind string, at string, n int").withColumn("at", F.col("at").cast("timestamp"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name, out, mode in (("firsts", first_come(stream, "key", "at"), "append"), ("rates", event_rates(stream, "at", "kind"), "update")):
        out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.key for r in spark.table("firsts").collect()) == ["a", "b"]
    assert sorted((r.kind, r.n) for r in spark.table("rates").collect()) == [("x", 2), ("y", 1)]


def test_text_functions(spark):
    assert value(spark, tx.stripped(F.col("text")), "　 a b \n") == "a b"
    hide = lambda text, secret="": value(spark, redaction.redacted(F.col("text"), secret), text)
    assert hide("mail a.b+c@d-e.cn call 13812345678 key abc!", "abc") == "mail 【邮箱已隐藏】 call 【手机号已隐藏】 key 【API密钥已隐藏】!"
    for phone in ("13812345678", "138 1234-5678", "+86 138-0013-8000", "008613800138000", "86-1-3-8".replace("1-3-8", "138") + "00138000"):
        assert hide(f"tel {phone}.") == "tel 【手机号已隐藏】."
    for other in ("12812345678", "1381234567", "2138123456789", "138123456789"):
        assert hide(f"no {other}.") == f"no {other}."
    began = time.monotonic()
    for long in ("a" * 400_000, "a@" * 200_000, "a." * 200_000, "1-" * 200_000, "86" * 200_000):
        assert hide(long) == long
    assert time.monotonic() - began < 30
    assert hide("id 11010519491231002x, 110105194912310021") == "id 【身份证号已隐藏】, 【身份证号已隐藏】"
    for text, inner in (('```json\n{"a":1}\n```', '{"a":1}'), (' ```JSON {"a":1}``` ', '{"a":1}'), ('see ```json\n{}\n``` there', 'see ```json\n{}\n``` there'), (" {} ", "{}")):
        assert value(spark, tx.unfenced(F.col("text")), text) == inner
    assert value(spark, tx.bounded(F.col("text"), 15), "x" * 40) == "xxxxx\n...\nxxxxx"
