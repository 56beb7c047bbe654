"""Registered queries of normalisation, location, chunking, evaluation and operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import redaction
from tessera.functions import text as tx
from tessera.functions.text import latin_tokens
from tessera.operators import answer, chunking, evaluation, locate, normalize, operations, output, retrieval
from tessera.plans.index import IndexTable
from tessera.plans.search_queries import BM25, NEAR, RANKED, chunks, question_vectors, questions, table, vectors
from tessera.plans.storage import shared_dir
from tessera.streaming.incremental import chunk_stream, upsert_stream


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


# normalisation


def _hashed(spark, sf_dir):
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    return docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("text_hash"), "source", F.when(number % 2 == 1, "case").otherwise("training").alias("kind"))


def dedupe_keep_first(spark, sf_dir):
    return normalize.keep_first(_hashed(spark, sf_dir), "text_hash", ["doc_id"]).select("doc_id", "text_hash")


def dedupe_conflicts(spark, sf_dir):
    return normalize.conflicts(_hashed(spark, sf_dir), "text_hash", "kind").select("text_hash", F.array_join("kinds", ",").alias("kinds"))


def duplicate_text_groups(spark, sf_dir):
    return normalize.duplicate_groups(docs(spark, sf_dir), "text", "doc_id")


def _named(spark, sf_dir):
    """Documents with file names, some of them marked as copies."""
    name = F.concat("source", F.when(F.col("doc_id") % 2 == 0, F.lit(" (1).txt")).when(F.col("doc_id") % 3 == 0, F.lit(" (2)")).otherwise(F.lit(".txt")))
    return docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("text_hash"), name.alias("name"), (F.trim("text") == "").alias("empty"))


def source_preference_dedupe(spark, sf_dir):
    return normalize.preferred(_named(spark, sf_dir), [F.col("text_hash")], F.col("name"), F.col("empty"), "doc_id").select("doc_id", "name")


def id_set_difference(spark, sf_dir):
    return normalize.difference(docs(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id")


def _index(spark, sf_dir):
    """documents as an index table in the shared folder."""
    index = IndexTable(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", "doc_id")
    index.rebuild(docs(spark, sf_dir).select("doc_id", "source"))
    return index


def upsert_merge(spark, sf_dir):
    """Labelled documents are written again, with their quality as source."""
    index = _index(spark, sf_dir)
    index.upsert(table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("source")))
    return index.read()


def delete_by_ids(spark, sf_dir):
    index = _index(spark, sf_dir)
    index.delete(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"))
    return index.read()


def index_rollback(spark, sf_dir):
    """A deletion that is undone, and the versions that nothing names any more deleted."""
    index = _index(spark, sf_dir)
    index.delete(table(spark, sf_dir, "labels").select("doc_id"))
    index.rollback()
    index.vacuum()
    return index.read()


def chunk_contract_violations(spark, sf_dir):
    kind = F.when(F.col("lang") == "en", "script").when(F.col("lang") == "de", "strategy").otherwise(F.col("lang"))
    rows = docs(spark, sf_dir).select(F.sha2("text", 256).alias("chunk_id"), kind.alias("chunk_type"), "text", F.col("source").alias("source_file"))
    return normalize.chunk_violations(rows, caps={"text": 4096}).select("chunk_id", F.array_join("codes", ",").alias("codes"))


def vector_validation(spark, sf_dir):
    """Vectors of odd labels are cut short first."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.when(F.col("label") % 2 == 1, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("vector"))
    return normalize.vector_violations(rows, 64)


# location and chunks


def _lines(spark, sf_dir):
    return locate.lines(docs(spark, sf_dir))


def line_asof_heading(spark, sf_dir):
    """At each line, the last line before it, or itself, of 40 characters at most."""
    rows = locate.as_of(_lines(spark, sf_dir), "doc_id", "line_no", F.when(F.length("line") <= 40, F.col("line_no")), "heading_line")
    return rows.select("doc_id", "line_no", "heading_line")


def context_window(spark, sf_dir):
    """Around each document's middle line."""
    middle = (F.size(F.split("text", "\n")) + 1).cast("int") / 2
    return docs(spark, sf_dir).select("doc_id", locate.context(F.col("text"), F.floor(middle).cast("int"), F.floor(middle).cast("int")).alias("context"))


def quote_locate(spark, sf_dir):
    """Each document's second line as a quote: cut after 20 characters, with a longer part behind the ellipsis that
    no text has, and a shorter one that each has; of odd ids as it is."""
    second = F.coalesce(F.get(F.split("text", "\n"), F.lit(1)), F.lit(""))
    cut = F.concat(F.left(second, F.lit(20)), F.lit("...zzzz no text of the corpus holds this part zzzz…"), F.left(F.col("text"), F.lit(8)))
    quote = F.when((F.length(second) > 40) & (F.col("doc_id") % 2 == 0), cut).otherwise(second)
    rows = docs(spark, sf_dir).select("doc_id", locate.located(F.col("text"), quote).alias("x"), "text")
    return rows.select("doc_id", "x.confidence", "x.char_start", "x.char_end", F.when(F.col("x.char_start") >= 0, locate.line_of(F.col("text"), F.col("x.char_start"))).alias("line"))


ONE_WORD = r"^[^ ]+\.$"


def heading_sections(spark, sf_dir):
    """Lines of one word and a full stop count as headings."""
    return chunking.heading_sections(_lines(spark, sf_dir), heading=ONE_WORD)


def page_text_sections(spark, sf_dir):
    """Each line as a page of a paged text, and the pages read again."""
    paged = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("## 第 "), (i + 1).cast("string"), F.lit(" 页\n"), x)), "\n")
    rows = docs(spark, sf_dir).select("doc_id", F.explode(chunking.pages_of(paged)).alias("p"))
    return rows.select("doc_id", "p.page", F.length("p.text").alias("n_chars"), F.md5("p.text").alias("digest"))


def _blocks(spark, sf_dir, blocks):
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(blocks).alias("pos", "block"))
    return rows.select("doc_id", "pos", F.length("block").alias("n_chars"), F.md5("block").alias("digest"))


def paragraph_pack(spark, sf_dir):
    return _blocks(spark, sf_dir, chunking.long_split(F.col("text")))


def short_page_merge(spark, sf_dir):
    return _blocks(spark, sf_dir, chunking.short_merged(F.filter(F.split("text", "\n"), lambda x: x != "")))


def segment_numbering(spark, sf_dir):
    rows = chunking.segment_ids(_lines(spark, sf_dir), "doc_id", ["line_no"], "course")
    return rows.select("chunk_id", "doc_id", "line_no")


# answers and evaluation


def _evidences(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", "\n").alias("citations"), "text")


def evidence_flatten(spark, sf_dir):
    return answer.flattened(_evidences(spark, sf_dir), "conv_id", "turn", "citations")


def citation_select(spark, sf_dir):
    chosen = _evidences(spark, sf_dir).select("conv_id").distinct().withColumn("indexes", F.array(*map(F.lit, (3, 1, 3, 99999))))
    return answer.selected(answer.flattened(_evidences(spark, sf_dir), "conv_id", "turn", "citations"), chosen, "conv_id")


RISKS = [("promise", "ment"), ("return", "ung"), ("claim", "tion"), ("doubt", "que")]


def compliance_collect(spark, sf_dir):
    risks = F.array_compact(F.array(*(F.when(F.contains(F.lower("text"), F.lit(k)), F.lit(r)) for r, k in RISKS)))
    rows = _evidences(spark, sf_dir).withColumn("found", risks)
    return answer.compliance_risks(rows, "conv_id", "turn", "found").select("conv_id", F.array_join("risks", ",").alias("risks"))


def _items(spark, sf_dir):
    """Gold: the three nearest vectors; evidences: the ten best by words; citations: of numbers 1, 2, 99 and a word,
    two of them without a path. Every fourth item is untraced."""
    near = retrieval.vector_search(vectors(spark, sf_dir), question_vectors(spark, sf_dir), 3)
    words = retrieval.bm25(chunks(spark, sf_dir), questions(spark, sf_dir), 10, latin_tokens)
    gold = near.groupBy("query_id").agg(F.collect_list(F.col("chunk_id").cast("string")).alias("gold"), F.min_by(F.col("chunk_id").cast("string"), "rank").alias("primary_id"))
    got = words.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("id")))), lambda x: x["id"]).alias("evidences"))
    cited = F.array(*(F.struct(F.lit(n).alias("evidence_index"), F.lit(p).alias("source_path"), F.lit("L1").alias("locator")) for n, p in (("1", "a"), ("2", ""), ("99", "b"), ("x", ""))))
    status = F.when(F.col("query_id") % 4 == 0, F.lit(evaluation.UNTRACED)).otherwise(F.lit(evaluation.STATUSES[0]))
    return gold.join(got, "query_id").select(F.col("query_id").alias("item_id"), status.alias("trace_status"), "gold", "primary_id", "evidences", cited.alias("citations"))


def eval_retrieval_scores(spark, sf_dir):
    """The catalog of known chunks is the English documents."""
    known = docs(spark, sf_dir).where("lang = 'en'").select(F.col("doc_id").cast("string").alias("chunk_id"))
    return evaluation.item_scores(_items(spark, sf_dir), known)


def _results(spark, sf_dir):
    """Labels as results: parts by quality and id; of toxic ones the answer failed, of some junk the judge."""
    rows = table(spark, sf_dir, "labels").join(docs(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    toxic, unjudged = F.col("toxic") == 1, (F.col("quality") == 0) & (F.col("doc_id") % 5 == 0)
    tags = F.array_compact(F.array(F.when(F.col("quality") == 0, F.lit("junk")), F.when(F.col("doc_id") % 7 == 0, F.lit("short"))))
    number = lambda c: c.cast("double")
    items = rows.select(
        F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 3 == 0, F.lit(evaluation.UNTRACED)).otherwise(F.lit(evaluation.STATUSES[0])).alias("trace_status"), F.col("lang").alias("stratum"),
        F.when(toxic, F.lit("no answer")).alias("answer_error"), F.when(unjudged, F.lit("no verdict")).alias("judge_error"), number(F.col("quality") * 35).alias("correctness"), F.lit(25.0).alias("keypoints"), F.lit(15.0).alias("groundedness"), F.lit(0.0).alias("relevance"),
        F.when(~toxic, number(F.col("doc_id") % 16)).alias("deterministic_points"), (F.col("doc_id") % 2 == 0).alias("primary_hit"), (F.col("doc_id") % 4 / 4).alias("recall"), tags.alias("error_tags"),
    )
    return evaluation.totals(items)


def eval_totals(spark, sf_dir):
    return _results(spark, sf_dir).select("item_id", "status", "total_score", F.array_join("error_tags", ",").alias("tags"))


def eval_summary(spark, sf_dir):
    return evaluation.summary(_results(spark, sf_dir))


def eval_strata(spark, sf_dir):
    listed = spark.createDataFrame([(x,) for x in ("en", "de", "fr", "es", "it")], "stratum string")
    return evaluation.strata(_results(spark, sf_dir), listed)


def error_tag_freq(spark, sf_dir):
    return evaluation.tag_frequency(_results(spark, sf_dir))


def grade_buckets(spark, sf_dir):
    return _results(spark, sf_dir).groupBy(F.coalesce(evaluation.grade(F.col("total_score")), F.lit("none")).alias("grade")).agg(F.count("*").alias("n"))


def bottom_results(spark, sf_dir):
    return evaluation.bottom(_results(spark, sf_dir)).select("item_id", "total_score")


def score_percentiles(spark, sf_dir):
    out = evaluation.percentiles(table(spark, sf_dir, "orders"), "o_totalprice", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


# operations, from events: a user is a run or job, an event a question or attempt

STATUS = {"click": "pending", "error": "failed", "purchase": "succeeded", "signup": "running", "view": "succeeded"}


def _questions(spark, sf_dir):
    status = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))[F.col("event_type")]
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", "ts", status.alias("status"), "event_type")


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"))


def batch_run_listing(spark, sf_dir):
    return operations.run_listing(_runs(spark, sf_dir), _questions(spark, sf_dir))


def finalizable_runs(spark, sf_dir):
    return operations.finalizable(_runs(spark, sf_dir), _questions(spark, sf_dir))


def _attempts(spark, sf_dir):
    rows = operations.numbered(_questions(spark, sf_dir), ["run_id"], ["ts", "event_id"])
    state = F.when(F.col("event_type") == "purchase", "committed").when(F.col("event_type") == "error", "prepared")
    return rows.select(F.col("run_id").alias("job_id"), F.col("sequence").alias("attempt_no"), "event_id", state.alias("commit_state"))


def _jobs(spark, sf_dir):
    return operations.latest(_questions(spark, sf_dir), "run_id", ["ts", "event_id"]).join(_questions(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("attempt_count")), "run_id").select(F.col("run_id").alias("job_id"), "status", "attempt_count")


def job_current_attempt(spark, sf_dir):
    return operations.current_attempt(_jobs(spark, sf_dir), _attempts(spark, sf_dir)).select("job_id", "status", "attempt_no", "event_id")


def recovery_actions(spark, sf_dir):
    return operations.recovery_actions(_jobs(spark, sf_dir), _attempts(spark, sf_dir))


def run_state_fold(spark, sf_dir):
    return operations.latest(_questions(spark, sf_dir), "run_id", ["ts", "event_id"]).select("run_id", "event_id", "status")


def run_state_violations(spark, sf_dir):
    return operations.violations(_questions(spark, sf_dir), "run_id", ["ts", "event_id"]).select("run_id", "event_id", "before", "status")


def latest_events(spark, sf_dir):
    return operations.recent(table(spark, sf_dir, "events"), ["ts", "event_id"]).select("event_id", "user_id", "event_type")


LOG_CAP = 12


def event_log_compaction(spark, sf_dir):
    """Views and clicks are progress."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return operations.compacted(events, ["user_id"], ["ts", "event_id"], LOG_CAP, ["view", "click"]).select("user_id", "sequence", "event_id", "event_type", "merged", "latest_type")


# texts


SECRET = "token"


def pii_redaction(spark, sf_dir):
    """All rules, with a word as the secret, over the texts with an identity number and phone numbers behind each."""
    tail = F.concat(F.lit(" 11010519491231002x 1"), F.lpad((F.col("doc_id") % 7 + 3).cast("string"), 1, "0"), F.lit("8 0013-8000, +86 13912345678 tel 139123456789"))
    out = redaction.redacted(F.concat("text", tail), SECRET)
    return docs(spark, sf_dir).select("doc_id", F.md5(out).alias("digest"), F.length(out).alias("n_chars"))


def preview_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.preview(F.col("text")).alias("preview"))


def bounded_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.bounded(F.col("text"), 205).alias("bounded"))


def csv_backfill(spark, sf_dir):
    """Questions are a conversation's user turns, answers the assistant's behind them; a third of these failed, and what was there stays."""
    c = table(spark, sf_dir, "conversations").withColumn("row_index", F.concat_ws("/", "conv_id", F.when(F.col("role") == "assistant", F.col("turn") - 1).otherwise(F.col("turn"))))
    asked = c.where("role = 'user'").select("row_index", F.md5("text").alias("question"), F.lit("old").alias("answer"))
    told = c.where("role = 'assistant'").select("row_index", F.when(F.col("conv_id") % 3 == 0, "failed").otherwise("succeeded").alias("status"), F.md5("text").alias("answer"))
    return output.backfilled(asked, told)


def safe_messages(spark, sf_dir):
    """Documents as messages, with a path, a secret and, every ninth, a stack behind them."""
    tail = F.when(F.col("doc_id") % 9 == 0, F.lit("\n  at x.y(z.py)")).otherwise(F.lit(" api_key: 'a b', see /var/log/app.log and C:\\tmp\\x.txt, Bearer abc.def; http://host/path"))
    out = redaction.safe_message(F.concat("text", tail))
    return docs(spark, sf_dir).select("doc_id", F.md5(out).alias("digest"), F.length(out).alias("n_chars"))


def incremental_upsert_stream(spark, sf_dir):
    """documents as a stream of files into an index table, and the table read."""
    where = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index = IndexTable(spark, f"{where}/table", "doc_id")
    # a pattern: Spark takes the path of a stream for a folder unless it is one
    stream = chunk_stream(spark, f"{sf_dir}/documents.parque[t]", "doc_id long, text string, lang string, source string, n_chars long")
    upsert_stream(stream.select("doc_id", F.sha2("text", 256).alias("text_hash"), "lang", "source"), index, f"{where}/checkpoint").awaitTermination()
    return index.read()


_HASHED = "h AS (SELECT doc_id, sha256(text) AS text_hash, source, CASE WHEN regexp_extract(source, '[0-9]+')::INT % 2 = 1 THEN 'case' ELSE 'training' END AS kind FROM documents)"
_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"
_FLAT = "c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS evidence_index, string_split(text, chr(10)) AS s FROM conversations), e AS (SELECT conv_id, evidence_index, unnest(s) AS citation, generate_subscripts(s, 1) AS pos FROM c), f AS (SELECT conv_id, evidence_index, citation, row_number() OVER (PARTITION BY conv_id ORDER BY evidence_index, pos) AS citation_index FROM e)"
_RESULTS = """l AS (SELECT doc_id, quality, toxic, lang, toxic = 1 AS t, quality = 0 AND doc_id % 5 = 0 AS u FROM labels JOIN documents USING (doc_id)),
r AS (SELECT doc_id AS item_id, CASE WHEN doc_id % 3 = 0 THEN '未定位' ELSE '完整支持' END AS trace_status, CASE WHEN t THEN 0e0 WHEN NOT u THEN (quality * 35 + 40 + doc_id % 16)::DOUBLE END AS total_score, CASE WHEN t THEN '问答失败' WHEN u THEN '评测失败' ELSE '已完成' END AS status, lang AS stratum, quality, toxic,
  CASE WHEN NOT t THEN (doc_id % 16)::DOUBLE END AS det, doc_id % 2 = 0 AS hit, doc_id % 4 / 4e0 AS recall, CASE WHEN t THEN ['问答执行失败'] WHEN u THEN ['裁判执行失败'] ELSE list_filter([CASE WHEN quality = 0 THEN 'junk' END, CASE WHEN doc_id % 7 = 0 THEN 'short' END], lambda x: x IS NOT NULL) END AS tags FROM l)"""
_STATUS = "q AS (SELECT user_id AS run_id, event_id, ts, event_type, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END AS status FROM events)"
_JOBS = f"{_STATUS}, a AS (SELECT run_id AS job_id, event_id, status, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS attempt_no, count(*) OVER (PARTITION BY run_id) AS attempt_count, CASE event_type WHEN 'purchase' THEN 'committed' WHEN 'error' THEN 'prepared' END AS commit_state FROM q)"
_MOVES = ", ".join(f"('{a}', '{b}')" for a, b in operations.MOVES)
_ITEMS = f"""{BM25}, {NEAR}, g AS (SELECT query_id, list(chunk_id) AS gold, min(CASE WHEN rank = 1 THEN chunk_id END) AS primary_id FROM {RANKED.format('near')} WHERE rank <= 3 GROUP BY 1),
t AS (SELECT query_id, list(chunk_id ORDER BY rank) AS got, count(lang) AS known FROM {RANKED.format('scores')} LEFT JOIN (SELECT doc_id AS chunk_id, lang FROM documents WHERE lang = 'en') USING (chunk_id) WHERE rank <= 10 AND score > 0 GROUP BY 1),
i AS (SELECT query_id AS item_id, query_id % 4 = 0 AS u, got, known, gold, list_contains(got, primary_id) AND query_id % 4 <> 0 AS primary_hit, CASE WHEN query_id % 4 = 0 THEN 0e0 ELSE len(list_intersect(got, gold)) / len(gold)::DOUBLE END AS recall, list_intersect(got[1:2], gold) AS named, len(got[1:2]) AS valid FROM g JOIN t USING (query_id)),
s AS (SELECT *, CASE WHEN u THEN 5e0 * (len(got) > 0)::INT + 5e0 * known / len(got) ELSE 5e0 * primary_hit::INT + 5e0 * recall END AS r, 25e-1 * valid / 4 + 25e-1 * CASE WHEN u THEN 5e-1 ELSE (len(named) > 0)::INT END AS c FROM i)"""

QUERIES = {
    "dedupe_keep_first": (dedupe_keep_first, f"WITH {_HASHED} SELECT min(doc_id) AS doc_id, text_hash FROM h GROUP BY text_hash"),
    "dedupe_conflicts": (dedupe_conflicts, f"WITH {_HASHED} SELECT text_hash, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM h GROUP BY text_hash HAVING count(DISTINCT kind) > 1"),
    "duplicate_text_groups": (duplicate_text_groups, "SELECT sha256(text) AS text_hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "source_preference_dedupe": (source_preference_dedupe, r"""WITH n AS (SELECT doc_id, sha256(text) AS h, trim(text) = '' AS empty, source || CASE WHEN doc_id % 2 = 0 THEN ' (1).txt' WHEN doc_id % 3 = 0 THEN ' (2)' ELSE '.txt' END AS name FROM documents)
SELECT doc_id, name FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY regexp_matches(name, '\([0-9]+\)\.[^.]+$'), empty, name, doc_id) AS k FROM n) WHERE k = 1"""),
    "id_set_difference": (id_set_difference, "SELECT 'left' AS side, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'right', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)"),
    "upsert_merge": (upsert_merge, "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'q' || quality FROM labels"),
    "index_rollback": (index_rollback, "SELECT doc_id, source FROM documents"),
    "delete_by_ids": (delete_by_ids, "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    "chunk_contract_violations": (chunk_contract_violations, """WITH r AS (SELECT sha256(text) AS chunk_id, text, count(*) OVER (PARTITION BY sha256(text)) AS copies, lang, source FROM documents),
v AS (SELECT chunk_id, list_filter([CASE WHEN trim(text) = '' THEN 'blank_text' END, CASE WHEN trim(source) = '' THEN 'blank_source_file' END, CASE WHEN strlen(text) > 4096 THEN 'long_text' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'chunk_type' END, CASE WHEN copies > 1 THEN 'duplicate_chunk_id' END], lambda x: x IS NOT NULL) AS codes FROM r)
SELECT chunk_id, array_to_string(codes, ',') AS codes FROM v WHERE len(codes) > 0"""),
    "vector_validation": (vector_validation, "SELECT vec_id AS chunk_id, 'dimension' AS code FROM embeddings WHERE label % 2 = 1"),
    "line_asof_heading": (line_asof_heading, f"WITH {_LINES} SELECT doc_id, line_no, last_value(CASE WHEN length(line) <= 40 THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS heading_line FROM l"),
    "context_window": (context_window, f"WITH {_LINES}, n AS (SELECT *, (max(line_no) OVER (PARTITION BY doc_id) + 1) // 2 AS middle FROM l) SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (abs(line_no - middle) <= 3 AND trim(line) <> ''), '') AS context FROM n GROUP BY doc_id"),
    "quote_locate": (quote_locate, r"""WITH s AS (SELECT doc_id, text, coalesce(string_split(text, chr(10))[2], '') AS second FROM documents),
q AS (SELECT doc_id, text, length(second) > 40 AND doc_id % 2 = 0 AS cut, second FROM s),
p AS (SELECT doc_id, 1 AS i, text, trim(CASE WHEN cut THEN rtrim(left(second, 20), '.') ELSE second END) AS part, cut FROM q UNION ALL SELECT doc_id, 2, text, trim(left(text, 8)), cut FROM q WHERE cut),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY strpos(text, part) = 0 OR length(part) < 2, length(part) DESC, i) AS k FROM (SELECT doc_id, i, text, cut, unnest(regexp_split_to_array(part, '\.{3,}|…+')) AS part FROM p)),
z AS (SELECT doc_id, text, trim(part) AS part, CASE WHEN part = '' OR strpos(text, trim(part)) = 0 OR (cut AND length(trim(part)) < 2) THEN 'unmatched' WHEN cut THEN 'approximate' ELSE 'exact' END AS confidence FROM f WHERE k = 1),
c AS (SELECT *, CASE WHEN confidence = 'unmatched' THEN -1 ELSE strpos(text, part) - 1 END AS char_start FROM z)
SELECT doc_id, confidence, char_start, CASE WHEN confidence = 'unmatched' THEN -1 ELSE char_start + length(part) END AS char_end, CASE WHEN char_start >= 0 THEN length(left(text, char_start)) - length(replace(left(text, char_start), chr(10), '')) + 1 END AS line FROM c"""),
    "heading_sections": (heading_sections, f"WITH {_LINES}, s AS (SELECT *, regexp_matches(line, '{ONE_WORD}') AS head, sum(regexp_matches(line, '{ONE_WORD}')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM l) SELECT doc_id, section, coalesce(max(CASE WHEN head THEN line END), '') AS heading, count(*) AS n_lines, sum(length(line)) AS n_chars FROM s GROUP BY doc_id, section"),
    "page_text_sections": (page_text_sections, f"WITH {_LINES} SELECT doc_id, line_no AS page, length(trim(line)) AS n_chars, md5(trim(line)) AS digest FROM l"),
    "paragraph_pack": (paragraph_pack, r"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS ps FROM documents WHERE length(text) > 2000),
fold(doc_id, i, size, pos) AS (SELECT doc_id, 1, length(ps[1]), 0 FROM p WHERE len(ps) > 0 UNION ALL SELECT doc_id, i + 1, CASE WHEN size + length(ps[i + 1]) > 2000 THEN 0 ELSE size END + length(ps[i + 1]), pos + (size + length(ps[i + 1]) > 2000)::INT FROM fold JOIN p USING (doc_id) WHERE i < len(ps)),
b AS (SELECT doc_id, pos, string_agg(ps[i], chr(10) ORDER BY i) AS block FROM fold JOIN p USING (doc_id) GROUP BY doc_id, pos UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 2000)
SELECT doc_id, pos, length(block) AS n_chars, md5(block) AS digest FROM b"""),
    "short_page_merge": (short_page_merge, """WITH RECURSIVE p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ps FROM documents),
fold(doc_id, i, size, pos) AS (SELECT doc_id, 1, length(ps[1]), 0 FROM p WHERE len(ps) > 0 UNION ALL SELECT doc_id, i + 1, CASE WHEN size >= 100 THEN 0 ELSE size + 2 END + length(ps[i + 1]), pos + (size >= 100)::INT FROM fold JOIN p USING (doc_id) WHERE i < len(ps)),
l AS (SELECT doc_id, max(pos) AS last, max_by(size, i) AS rest FROM fold GROUP BY doc_id),
b AS (SELECT doc_id, CASE WHEN pos = last AND rest < 100 AND last > 0 THEN pos - 1 ELSE pos END AS pos, i FROM fold JOIN l USING (doc_id)),
t AS (SELECT doc_id, pos, string_agg(ps[i], chr(10) || chr(10) ORDER BY i) AS block FROM b JOIN p USING (doc_id) GROUP BY doc_id, pos)
SELECT doc_id, pos, length(block) AS n_chars, md5(block) AS digest FROM t"""),
    "segment_numbering": (segment_numbering, f"WITH {_LINES} SELECT 'course__' || doc_id || '__' || printf('%04d', line_no) AS chunk_id, doc_id, line_no FROM l"),
    "evidence_flatten": (evidence_flatten, f"WITH {_FLAT} SELECT conv_id, evidence_index, citation_index, citation FROM f"),
    "citation_select": (citation_select, f"WITH {_FLAT} SELECT conv_id, evidence_index, citation_index, citation, CASE citation_index WHEN 3 THEN 0 ELSE 1 END AS place FROM f WHERE citation_index IN (1, 3)"),
    "compliance_collect": (compliance_collect, "WITH r AS (SELECT conv_id, turn, unnest([" + ", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN '{r}' END" for r, k in RISKS) + f"]) AS risk, unnest(range({len(RISKS)})) AS pos FROM conversations), f AS (SELECT conv_id, risk, min(turn * 100 + pos) AS first FROM r WHERE risk IS NOT NULL GROUP BY ALL) SELECT conv_id, string_agg(risk, ',' ORDER BY first) AS risks FROM f GROUP BY conv_id"),
    "eval_retrieval_scores": (eval_retrieval_scores, f"WITH {_ITEMS} SELECT item_id, CASE WHEN u THEN '未定位' ELSE '完整支持' END AS trace_status, primary_hit, round(recall, 6) AS recall, round(r, 2) AS retrieval_points, round(c, 2) AS citation_points, round(r + c, 2) AS deterministic_points FROM s"),
    "eval_totals": (eval_totals, f"WITH {_RESULTS} SELECT item_id, status, total_score, array_to_string(tags, ',') AS tags FROM r"),
    "eval_summary": (eval_summary, f"""WITH {_RESULTS} SELECT count(*) AS n_items, count_if(status = '评测失败')::BIGINT AS n_judge_failed, count_if(status = '问答失败')::BIGINT AS n_answer_failed, count(total_score) AS n_scored, round(count_if(total_score >= 75) / count(*), 6) AS conservative_rate, round(count_if(total_score >= 75) / count_if(status <> '评测失败'), 6) AS effective_rate, round(count_if(total_score >= 85) / count(*), 6) AS excellent_rate, round(count_if(status <> '问答失败') / count(*), 6) AS answer_rate, round(avg(total_score), 6) AS mean_score, round(quantile_cont(total_score, 0.5), 6) AS p50, round(quantile_cont(total_score, 0.95), 6) AS p95,
round(avg(hit::INT) FILTER (trace_status <> '未定位' AND det IS NOT NULL), 6) AS primary_hit_rate, round(avg(recall) FILTER (trace_status <> '未定位' AND det IS NOT NULL), 6) AS mean_recall, round(avg(det), 6) AS mean_deterministic FROM r"""),
    "eval_strata": (eval_strata, f"WITH {_RESULTS}, s(stratum) AS (VALUES ('en'), ('de'), ('fr'), ('es'), ('it')) SELECT s.stratum, count(r.item_id) AS n_items, round(coalesce(avg(total_score), 0), 6) AS mean_score, round(coalesce(count_if(total_score >= 75) / nullif(count(r.item_id), 0), 0), 6) AS pass_rate FROM s LEFT JOIN r USING (stratum) GROUP BY s.stratum"),
    "error_tag_freq": (error_tag_freq, f"WITH {_RESULTS} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM r) GROUP BY tag"),
    "grade_buckets": (grade_buckets, f"WITH {_RESULTS} SELECT CASE WHEN total_score >= 85 THEN 'excellent' WHEN total_score >= 75 THEN 'qualified' WHEN total_score IS NOT NULL THEN 'failed' ELSE 'none' END AS grade, count(*) AS n FROM r GROUP BY 1"),
    "bottom_results": (bottom_results, f"WITH {_RESULTS} SELECT item_id, total_score FROM r ORDER BY total_score ASC NULLS LAST, item_id LIMIT 5"),
    "score_percentiles": (score_percentiles, "SELECT round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.95), 6) AS p95, round(quantile_cont(o_totalprice, 0.99), 6) AS p99 FROM orders"),
    "batch_run_listing": (batch_run_listing, f"WITH {_STATUS} SELECT c_custkey AS run_id, count(status) AS n_questions, count(CASE WHEN status = 'pending' THEN 1 END) AS n_pending, count(CASE WHEN status = 'running' THEN 1 END) AS n_running, count(CASE WHEN status = 'succeeded' THEN 1 END) AS n_succeeded, count(CASE WHEN status = 'failed' THEN 1 END) AS n_failed FROM customer LEFT JOIN q ON run_id = c_custkey GROUP BY c_custkey"),
    "finalizable_runs": (finalizable_runs, f"WITH {_STATUS} SELECT c_custkey AS run_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM q WHERE run_id = c_custkey AND status IN ('pending', 'running'))"),
    "job_current_attempt": (job_current_attempt, f"WITH {_JOBS} SELECT job_id, status, attempt_no, event_id FROM a WHERE attempt_no = attempt_count"),
    "recovery_actions": (recovery_actions, f"WITH {_JOBS} SELECT job_id, CASE commit_state WHEN 'committed' THEN 'mark_succeeded' WHEN 'prepared' THEN 'roll_back' ELSE 'interrupt' END AS action FROM a WHERE attempt_no = attempt_count AND status NOT IN ('succeeded', 'failed')"),
    "run_state_fold": (run_state_fold, f"WITH {_JOBS} SELECT job_id AS run_id, event_id, status FROM a WHERE attempt_no = attempt_count"),
    "run_state_violations": (run_state_violations, f"WITH {_STATUS}, b AS (SELECT run_id, event_id, status, coalesce(lag(status) OVER (PARTITION BY run_id ORDER BY ts, event_id), '') AS before FROM q) SELECT run_id, event_id, before, status FROM b WHERE (before, status) NOT IN ({_MOVES})"),
    "latest_events": (latest_events, "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200"),
    "event_log_compaction": (event_log_compaction, f"""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, event_type IN ('view', 'click') AS fits, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
fold(user_id, k, log) AS (SELECT user_id, 0::BIGINT, []::STRUCT(sequence BIGINT, event_id BIGINT, event_type VARCHAR, merged BIGINT, latest_type VARCHAR)[] FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT f.user_id, e.k, CASE
  WHEN len(log) >= {LOG_CAP} AND fits AND len(list_filter(log, lambda x: x.event_type = 'progress_compacted')) > 0 THEN list_transform(log, lambda x: CASE WHEN x.event_type = 'progress_compacted' THEN struct_pack(sequence := x.sequence, event_id := x.event_id, event_type := x.event_type, merged := x.merged + 1, latest_type := e.event_type) ELSE x END)
  WHEN len(log) >= {LOG_CAP} AND fits AND len(list_filter(log, lambda x: x.event_type IN ('view', 'click'))) > 0 THEN list_transform(log, lambda x: CASE WHEN x.sequence = list_max(list_transform(list_filter(log, lambda y: y.event_type IN ('view', 'click')), lambda y: y.sequence)) THEN struct_pack(sequence := x.sequence, event_id := x.event_id, event_type := 'progress_compacted', merged := x.merged + 1, latest_type := e.event_type) ELSE x END)
  WHEN len(log) >= {LOG_CAP} AND len(list_filter(log, lambda x: x.event_type IN ('view', 'click', 'progress_compacted'))) = 0 THEN log
  ELSE list_append(CASE WHEN len(log) >= {LOG_CAP} THEN list_filter(log, lambda x: x.sequence <> list_min(list_transform(list_filter(log, lambda y: y.event_type IN ('view', 'click', 'progress_compacted')), lambda y: y.sequence))) ELSE log END,
    struct_pack(sequence := coalesce(list_max(list_transform(CASE WHEN len(log) >= {LOG_CAP} THEN list_filter(log, lambda x: x.sequence <> list_min(list_transform(list_filter(log, lambda y: y.event_type IN ('view', 'click', 'progress_compacted')), lambda y: y.sequence))) ELSE log END, lambda x: x.sequence)), 0) + 1, event_id := e.event_id, event_type := e.event_type, merged := 1::BIGINT, latest_type := e.event_type)) END
FROM fold f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1),
last AS (SELECT user_id, unnest(arg_max(log, k)) AS x FROM fold GROUP BY user_id)
SELECT user_id, x.sequence AS sequence, x.event_id AS event_id, x.event_type AS event_type, x.merged AS merged, x.latest_type AS latest_type FROM last"""),
    "pii_redaction": (pii_redaction, rf"""WITH t AS (SELECT doc_id, text || ' 11010519491231002x 1' || (doc_id % 7 + 3) || '8 0013-8000, +86 13912345678 tel 139123456789' AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(replace(t, '{SECRET}', '【API密钥已隐藏】'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', '【邮箱已隐藏】', 'g') AS t FROM t),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(^|[^0-9])(?:(?:\+86|0086|86)[\s-]*)?1[3-9](?:[\s-]*[0-9]){{9}}($|[^0-9])', '\1【手机号已隐藏】\2', 'g'), '(^|[^0-9])(?:(?:\+86|0086|86)[\s-]*)?1[3-9](?:[\s-]*[0-9]){{9}}($|[^0-9])', '\1【手机号已隐藏】\2', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '(^|[^0-9])[0-9]{{17}}[0-9Xx]($|[^0-9])', '\1【身份证号已隐藏】\2', 'g') AS t FROM b) SELECT doc_id, md5(t) AS digest, length(t) AS n_chars FROM c"""),
    "preview_text": (preview_text, r"""WITH r AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '...' ELSE t END AS preview FROM r"""),
    "bounded_text": (bounded_text, "SELECT doc_id, CASE WHEN length(text) > 205 THEN left(text, 100) || chr(10) || '...' || chr(10) || right(text, 100) ELSE text END AS bounded FROM documents"),
    "csv_backfill": (csv_backfill, "SELECT u.conv_id || '/' || u.turn AS row_index, md5(u.text) AS question, CASE WHEN a.conv_id % 3 <> 0 THEN md5(a.text) ELSE 'old' END AS answer FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'"),
    "safe_messages": (safe_messages, r"""WITH m AS (SELECT doc_id, text || CASE WHEN doc_id % 9 = 0 THEN chr(10) || '  at x.y(z.py)' ELSE ' api_key: ''a b'', see /var/log/app.log and C:\tmp\x.txt, Bearer abc.def; http://host/path' END AS m FROM documents),
a AS (SELECT doc_id, m, regexp_replace(m, '(?i)(^|[^A-Za-z0-9_])["'']?((?:[A-Za-z0-9.]+[_-])*(?:api[_-]key|token|secret|password)|Bearer)["'']?\s*[:=]\s*(?:"[^"]*"|''[^'']*''|[^\s,;，；。]+)', '\1\2=[已隐藏敏感信息]', 'g') AS t FROM m),
b AS (SELECT doc_id, m, regexp_replace(regexp_replace(regexp_replace(t, '(?i)\bBearer\s+[^\s,;，；。]+', 'Bearer [已隐藏敏感信息]', 'g'), '(^|[^A-Za-z0-9_])[A-Za-z]:[\\/](?:[^\\/\s]+[\\/])*[^\\/\s,;)\]}]+', '\1[已隐藏路径]', 'g'), '(^|[^:/])/(?:[^/\s]+/)*[^/\s,;)\]}]+', '\1[已隐藏路径]', 'g') AS t FROM a)
SELECT doc_id, md5(t) AS digest, length(t) AS n_chars FROM (SELECT doc_id, CASE WHEN regexp_matches(m, '(?i)\b(traceback|stack\s*trace|exception\s*chain)\b|(^|\n)\s*at\s+\S+\([^)]*\)') THEN '内部处理信息已隐藏' ELSE left(t, 2000) END AS t FROM b)"""),
    "incremental_upsert_stream": (incremental_upsert_stream, "SELECT doc_id, sha256(text) AS text_hash, lang, source FROM documents"),
}
