"""Chunks as flat rows of an index, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import text_hash
from tessera.sources.chunks import CITATION

#: Facets that stand in columns of their own, the length of an excerpt and the bytes of citations that a row may have: fixed values.
FACETS = ["case_name", "stage", "scenario", "source_kind", "primary_domain"]
MOST_EXCERPT, MOST_CITATIONS = 600, 65_535
#: The file that a chunk which comes back from the index names as its source.
RESTORED_FROM = "case.sales_insights.json"


def compact(citation: Column) -> Column:
    """A citation as JSON without its context, and with a cut excerpt."""
    return F.to_json(citation.dropFields("context").withField("source_excerpt", F.substring(citation["source_excerpt"], 1, MOST_EXCERPT)), {"ignoreNullFields": "false"})


def citations_json(citations: Column, most: int = MOST_CITATIONS) -> Column:
    """A JSON list of as many citations from the first on as fit in so many bytes. Each is written once;
    a running sum of their lengths tells where to stop."""
    texts = F.transform(F.coalesce(citations, F.expr(f"cast(array() AS array<struct<{CITATION.replace(' string', ': string').replace(' map', ': map')}>>)")), compact)
    # brackets, and a comma behind all but the first
    start = F.struct(F.lit(1).cast("long").alias("bytes"), F.lit(0).alias("n"), F.lit(True).alias("open"))
    def step(s: Column, x: Column) -> Column:
        more = s["bytes"] + F.octet_length(x) + 1
        fits = s["open"] & (more <= most)
        return F.struct(F.when(fits, more).otherwise(s["bytes"]).alias("bytes"), F.when(fits, s["n"] + 1).otherwise(s["n"]).alias("n"), fits.alias("open"))
    n = F.aggregate(texts, start, step, lambda s: s["n"])
    return F.concat(F.lit("["), F.array_join(F.slice(texts, F.lit(1), n), ","), F.lit("]"))


def flattened(chunks: DataFrame) -> DataFrame:
    """Rows of chunks (chunk_id, chunk_type, text, metadata map, citations, and vector where it is there): the facets in
    columns, empty where the metadata has none, and metadata and citations as JSON."""
    own = [F.coalesce(F.try_element_at("metadata", F.lit(f)), F.lit("")).alias(f) for f in FACETS]
    more = ["vector"] if "vector" in chunks.columns else []
    return chunks.select("chunk_id", *more, "text", text_hash(F.col("text")).alias("text_hash"), "chunk_type", *own, F.to_json("metadata").alias("metadata_json"), citations_json(F.col("citations")).alias("citations_json"))


def restored(rows: DataFrame) -> DataFrame:
    """Chunks of flat rows; missing JSON is empty."""
    some = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    kind = f"array<struct<{CITATION.replace(' string', ': string').replace(' map', ': map')}>>"
    return rows.select("chunk_id", "chunk_type", "text", F.from_json(some("metadata_json", "{}"), "map<string,string>").alias("metadata"), F.from_json(some("citations_json", "[]"), kind).alias("citations"), F.lit(RESTORED_FROM).alias("source_file"))
