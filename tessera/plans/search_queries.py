"""Registered queries of retrieval and rules, with the DuckDB SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import latin_tokens
from tessera.operators import classify, retrieval

#: Rule tables for the driver's Latin texts; every operator takes its own as a parameter.
DOMAINS = {"anglo": ["that", "with", "from"], "gallic": ["eaux", "ment", "pour"], "iberian": ["ción", "para", "mente"], "teuton": ["ung", "lich", "und "]}
TIES = ["teuton", "gallic", "anglo", "iberian"]
#: Labels that name a domain.
LABELS = {"anglo": ["en"], "gallic": ["fr"], "iberian": ["es"], "teuton": ["de"]}
TAGS = [("legal", "license", ["licensed under", "license"]), ("legal", "rights", ["all rights reserved"]), ("contact", "mail", ["@mail"]), ("style", "list", [" | "]), ("style", "shout", ["!!"])]
FACETS = ["lang", "source"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's vector is the one of the same number."""
    return questions(spark, sf_dir).select("query_id").join(vectors(spark, sf_dir).select(F.col("chunk_id").alias("query_id"), "vector"), "query_id")


def _domains(c):
    return classify.query_domains(c, DOMAINS, TIES)


def _keys(keys: list[str], column: str = "text") -> str:
    return " OR ".join(f"contains(lower({column}), '{k.lower()}')" for k in keys)


def _count(keys: list[str], column: str = "text") -> str:
    return " + ".join(f"contains(lower({column}), '{k.lower()}')::INT" for k in dict.fromkeys(keys))


TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
BM25 = f"""
words AS (SELECT doc_id, source, {TOKENS.format('text')} AS w FROM documents),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words),
tf AS (SELECT doc_id, dl, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS t FROM words) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
q AS (SELECT item_id, t, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS.format('text')}) AS t FROM benchmark) GROUP BY ALL),
scores AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(sum(ln((n - df + 5e-1) / (df + 5e-1) + 1) * tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * dl / avgdl)) * qtf), 6) AS score
  FROM tf JOIN q USING (t) JOIN df USING (t), stats GROUP BY ALL)"""
RANKED = "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {})"
NEAR = """
near AS (SELECT q.item_id AS query_id, e.vec_id AS chunk_id, round(list_dot_product(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM benchmark q JOIN embeddings v ON v.vec_id = q.item_id, embeddings e)"""
FUSED = f"""
arms AS (SELECT query_id, chunk_id, rank, 0 AS arm FROM {RANKED.format('near')} WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, rank, 1 FROM {RANKED.format('scores')} WHERE rank <= 20 AND score > 0),
fused AS (SELECT query_id, chunk_id, round(sum(1e0 / (60 + rank)), 9) AS score, min(arm * 1000 + rank) AS first FROM arms GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, chunk_id) AS rank FROM fused)"""


def bm25_topk(spark, sf_dir):
    return retrieval.bm25(chunks(spark, sf_dir), questions(spark, sf_dir), 10, latin_tokens)


def bm25_corpus_stats(spark, sf_dir):
    return retrieval.corpus_statistics(chunks(spark, sf_dir), latin_tokens).select("n", F.round("avgdl", 6).alias("avgdl"))


def tokenize_counts(spark, sf_dir):
    words = latin_tokens(F.col("text"))
    return chunks(spark, sf_dir).select("chunk_id", F.size(words).alias("n_tokens"), F.size(F.array_distinct(words)).alias("n_distinct"))


def vector_topk(spark, sf_dir):
    return retrieval.vector_search(vectors(spark, sf_dir), question_vectors(spark, sf_dir), 10)


def vector_topk_filtered(spark, sf_dir):
    """Only English chunks compete: the filter comes before the top k."""
    pool = chunks(spark, sf_dir).where("lang = 'en'").select("chunk_id")
    return retrieval.vector_search(vectors(spark, sf_dir).join(pool, "chunk_id", "left_semi"), question_vectors(spark, sf_dir), 10)


def _arms(spark, sf_dir, n=20):
    return [retrieval.vector_search(vectors(spark, sf_dir), question_vectors(spark, sf_dir), n), retrieval.bm25(chunks(spark, sf_dir), questions(spark, sf_dir), n, latin_tokens)]


def rrf_fusion(spark, sf_dir):
    return retrieval.fused(_arms(spark, sf_dir))


def hybrid_direct(spark, sf_dir):
    """Without boost, cut to the ten best."""
    return retrieval.fused(_arms(spark, sf_dir), 10)


def hybrid_boosted(spark, sf_dir):
    own = chunks(spark, sf_dir).withColumn("domain_tags", _domains(F.col("text")))
    asked = questions(spark, sf_dir).select("query_id", _domains(F.col("query")).alias("domains"))
    return retrieval.boosted(retrieval.fused(_arms(spark, sf_dir)), own.select("chunk_id", "domain_tags"), asked, 20)


def _odd(c):
    return F.regexp_extract(c, "[0-9]+", 0).cast("int") % 2 == 1


def multi_collection_pooled(spark, sf_dir):
    """Two collections, odd and even sources, scored with common statistics."""
    own = chunks(spark, sf_dir)
    return retrieval.bm25(retrieval.pooled([own.where(_odd(F.col("source"))), own.where(~_odd(F.col("source")))]), questions(spark, sf_dir), 5, latin_tokens)


def multi_collection_vector(spark, sf_dir):
    """The top five of each of two collections, merged by similarity."""
    v, q = vectors(spark, sf_dir), question_vectors(spark, sf_dir)
    tops = [retrieval.vector_search(v.where(F.col("chunk_id") % 2 == r), q, 5) for r in (0, 1)]
    return retrieval.top_k(tops[0].unionByName(tops[1]), 5)


def late_materialised_details(spark, sf_dir):
    hits = retrieval.bm25(chunks(spark, sf_dir), questions(spark, sf_dir), 3, latin_tokens)
    return retrieval.with_details(hits, chunks(spark, sf_dir).withColumn("n_chars", F.length("text")), "lang", "source", "n_chars")


def rule_tags(spark, sf_dir):
    tags = classify.rule_tags(F.col("text"), TAGS)
    return chunks(spark, sf_dir).select("chunk_id", F.array_join(tags, ";").alias("tags"), F.size(tags).alias("n_tags"))


def rule_tag_frequency(spark, sf_dir):
    rows = chunks(spark, sf_dir).select(F.explode(classify.rule_tags(F.col("text"), TAGS)).alias("tag"))
    return classify.distribution(rows, "tag")


def query_domain_tags(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", F.array_join(_domains(F.col("query")), ";").alias("domains"))


def _scored(spark, sf_dir):
    """The language is a label, the first line structured text, and the source's name source text;
    of every third document only the text counts."""
    some = F.col("chunk_id") % 3 != 0
    title = F.split("text", "\n")[0]
    texts = {"structured": F.when(some, classify.structured_text(F.array(title, F.col("lang")), DOMAINS, LABELS)), "source": F.when(some, F.col("source")), "text": F.col("text")}
    direct = {"lang": F.when(some, F.array("lang"))}
    return chunks(spark, sf_dir).withColumn("scores", classify.domain_scores(DOMAINS, direct, texts, LABELS))


def domain_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("chunk_id", F.explode("scores").alias("domain", "score"))


def _primary(spark, sf_dir):
    return _scored(spark, sf_dir).withColumn("domain", F.coalesce(classify.primary_domain(F.col("scores"), TIES), F.lit("unclassified")))


def primary_domain(spark, sf_dir):
    return _primary(spark, sf_dir).select("chunk_id", "domain")


def domain_tags(spark, sf_dir):
    tags = classify.domain_tags(F.col("scores"), TIES)
    return _scored(spark, sf_dir).select("chunk_id", F.coalesce(F.array_join(tags, ";"), F.lit("")).alias("tags"))


def domain_distribution(spark, sf_dir):
    return classify.distribution(_primary(spark, sf_dir), "domain")


def domain_samples(spark, sf_dir):
    return classify.samples(_primary(spark, sf_dir).select("domain", "chunk_id"), "domain", ["chunk_id"])


def facet_values(spark, sf_dir):
    return retrieval.facets(chunks(spark, sf_dir), FACETS)


def facet_merge(spark, sf_dir):
    """Facets of two collections as one list: documents, and parts by type."""
    part = table(spark, sf_dir, "part")
    kind = next(c for c in part.columns if c.endswith("type"))
    return retrieval.facets(chunks(spark, sf_dir), ["lang"]).unionByName(retrieval.facets(part.select(F.col(kind).alias("lang")), ["lang"])).distinct()


_TAG_LIST = "list_filter([" + ", ".join(f"CASE WHEN {_keys(k)} THEN '{d}/{v}' END" for d, v, k in TAGS) + "], lambda x: x IS NOT NULL)"
_DOMAIN_LIST = "list_filter([" + ", ".join(f"CASE WHEN {_keys(DOMAINS[d])} THEN '{d}' END" for d in TIES) + "], lambda x: x IS NOT NULL)"
_SCORES = "scored AS (" + " UNION ALL ".join(f"SELECT doc_id AS chunk_id, '{d}' AS domain, {i} AS tie, CASE WHEN doc_id % 3 <> 0 THEN 10 * (lang = '{LABELS[d][0]}')::INT + 4 * ({_count(DOMAINS[d], 'title')}) + 2 * ({_count(DOMAINS[d], 'source')}) ELSE 0 END + {_count(DOMAINS[d])} AS score FROM titled" for i, d in enumerate(TIES)) + ")"
_TITLED = "titled AS (SELECT doc_id, text, lang, source, CASE WHEN string_split(text, chr(10))[1] IN ('en', 'de', 'fr', 'es') THEN '' ELSE string_split(text, chr(10))[1] END AS title FROM documents)"
_PRIMARY = f"{_TITLED}, {_SCORES}, best AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, tie) AS k FROM scored), classed AS (SELECT chunk_id, CASE WHEN score >= 4 THEN domain ELSE 'unclassified' END AS domain FROM best WHERE k = 1)"
_HIT = "query_id, chunk_id, rank, score"

QUERIES = {
    "bm25_topk": (bm25_topk, f"WITH {BM25} SELECT {_HIT} FROM {RANKED.format('scores')} WHERE rank <= 10"),
    "bm25_corpus_stats": (bm25_corpus_stats, f"SELECT count(*) AS n, round(avg(len({TOKENS.format('text')})), 6) AS avgdl FROM documents"),
    "tokenize_counts": (tokenize_counts, f"SELECT doc_id AS chunk_id, len({TOKENS.format('text')}) AS n_tokens, len(list_distinct({TOKENS.format('text')})) AS n_distinct FROM documents"),
    "vector_topk": (vector_topk, f"WITH {NEAR} SELECT {_HIT} FROM {RANKED.format('near')} WHERE rank <= 10"),
    "vector_topk_filtered": (vector_topk_filtered, f"WITH {NEAR}, pool AS (SELECT near.* FROM near JOIN documents ON doc_id = chunk_id WHERE lang = 'en') SELECT {_HIT} FROM {RANKED.format('pool')} WHERE rank <= 10"),
    "rrf_fusion": (rrf_fusion, f"WITH {BM25}, {NEAR}, {FUSED} SELECT {_HIT} FROM placed"),
    "hybrid_direct": (hybrid_direct, f"WITH {BM25}, {NEAR}, {FUSED} SELECT {_HIT} FROM placed WHERE rank <= 10"),
    "hybrid_boosted": (hybrid_boosted, f"""WITH {BM25}, {NEAR}, {FUSED},
dt AS (SELECT doc_id AS chunk_id, {_DOMAIN_LIST} AS tags FROM documents), qt AS (SELECT item_id AS query_id, {_DOMAIN_LIST} AS asked FROM benchmark),
f AS (SELECT query_id, chunk_id, rank AS prior, score AS base, 1 + 1e-1 * least(len(list_filter(coalesce(tags, []), lambda t: list_contains(asked, t))), 3) AS factor FROM placed LEFT JOIN dt USING (chunk_id) JOIN qt USING (query_id)),
b AS (SELECT query_id, chunk_id, prior, round(base * factor, 9) AS score, round(factor, 6) AS factor FROM f)
SELECT query_id, chunk_id, rank, score, factor FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prior) AS rank FROM b) WHERE rank <= 20"""),
    "multi_collection_pooled": (multi_collection_pooled, f"WITH {BM25} SELECT {_HIT} FROM {RANKED.format('scores')} WHERE rank <= 5"),
    "multi_collection_vector": (multi_collection_vector, f"WITH {NEAR} SELECT {_HIT} FROM {RANKED.format('near')} WHERE rank <= 5"),
    "late_materialised_details": (late_materialised_details, f"WITH {BM25} SELECT {_HIT}, lang, d.source, length(text) AS n_chars FROM {RANKED.format('scores')} JOIN documents d ON doc_id = chunk_id WHERE rank <= 3"),
    "rule_tags": (rule_tags, f"SELECT doc_id AS chunk_id, array_to_string({_TAG_LIST}, ';') AS tags, len({_TAG_LIST}) AS n_tags FROM documents"),
    "rule_tag_frequency": (rule_tag_frequency, f"SELECT value, count(*) AS n FROM (SELECT unnest({_TAG_LIST}) AS value FROM documents) GROUP BY value"),
    "query_domain_tags": (query_domain_tags, f"SELECT item_id AS query_id, array_to_string({_DOMAIN_LIST}, ';') AS domains FROM benchmark"),
    "domain_scores": (domain_scores, f"WITH {_TITLED}, {_SCORES} SELECT chunk_id, domain, score FROM scored WHERE score > 0"),
    "primary_domain": (primary_domain, f"WITH {_PRIMARY} SELECT chunk_id, domain FROM classed"),
    "domain_tags": (domain_tags, f"WITH {_PRIMARY} SELECT chunk_id, coalesce(string_agg(domain, ';' ORDER BY k > 1, tie) FILTER (score >= 4), '') AS tags FROM best GROUP BY chunk_id"),
    "domain_distribution": (domain_distribution, f"WITH {_PRIMARY} SELECT domain AS value, count(*) AS n FROM classed GROUP BY domain"),
    "domain_samples": (domain_samples, f"WITH {_PRIMARY} SELECT domain, chunk_id, k FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY chunk_id) AS k FROM classed) WHERE k <= 3"),
    "facet_values": (facet_values, "SELECT DISTINCT 'lang' AS facet, trim(lang) AS value FROM documents WHERE trim(lang) <> '' UNION SELECT DISTINCT 'source', trim(source) FROM documents WHERE trim(source) <> ''"),
    "facet_merge": (facet_merge, "SELECT DISTINCT 'lang' AS facet, trim(lang) AS value FROM documents WHERE trim(lang) <> '' UNION SELECT DISTINCT 'lang', trim(p_type) FROM part WHERE trim(p_type) <> ''"),
}
