"""URL filter: a blocked Bloom filter of listed entries, then an exact hash join.

An entry (host, path, verdict, rule) fits its host and all subdomains where the
url's path starts with the entry's. Rules go before the other listed entries; then
the longest wins (host and path together; of equally long ones the greatest host, path, verdict). A canonical url is the host,
lower-cased, and the path, without query and fragment. Its keys are each suffix of the host's
labels with each beginning of the path that is as long as some entry's path; of these lengths there are as many as
the longest entry has characters at most, and they are looked up as a table. The
filter, blocks of 512 bits of which an entry sets eight in one block, passes keys that
may be listed; the join on the key removes false positives. Verdicts are made
once for each distinct (host, path), so a frequent url costs no more than a row.

The filter is broadcast: MAX_FILTER_BYTES bounds it, and beyond that, entries
share blocks more densely, which costs false positives but no listed entry. The
entries are only joined. A null url, or one without ``://``, has an empty host
and path, fits nothing and gets the default verdict. Repeated rows stay rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_ENTRY, BLOCK_BITS, PROBES = 16, 512, 8
MAX_FILTER_BYTES = 64 << 20
ENTRIES = "host string, path string, verdict string, rule boolean"
#: Hosts that the corpus lists for spam, and the rules of the check: fixed values.
LISTED = [("spam-farm.example.org", "/", "block", False), ("cheap-pills.example.com", "/", "block", False)]
RULES = [("com", "/en/", "block", True), ("example.com", "/en/7", "allow", True), ("net", "/de/", "allow", True), ("example.net", "/de/8", "block", True), ("org", "/es/", "block", True)]


def canonical(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def key_digest(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def _places(digest: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, bits) of each digest: one block, PROBES bits in it."""
    d = digest.view(np.uint64)
    block = ((d >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    step = (d * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(10)
    odd = (d >> np.uint64(3)) | np.uint64(1)
    return block.astype(np.int64), (step[:, None] + odd[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(BLOCK_BITS)


def _filled(blocks: int):
    """Each task's part of the filter: (block, word, bits) of the entries in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, bits = _places(batch.column(0).to_numpy(), blocks)
            at = (block[:, None] * BLOCK_BITS + bits.astype(np.int64)).ravel()
            word, bit = at >> 6, np.left_shift(np.int64(1), at & 63)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit)], names=["word", "bits"])

    return run


def bloom(entries: DataFrame) -> np.ndarray:
    """The filter's 64-bit words; Spark sets the bits, the driver gets MAX_FILTER_BYTES at most."""
    n = entries.count()
    blocks = max(1, min(-(-n * BITS_PER_ENTRY // BLOCK_BITS), MAX_FILTER_BYTES * 8 // BLOCK_BITS))
    bits = entries.select(key_digest(F.col("host"), F.col("path")).alias("digest")).mapInArrow(_filled(blocks), "word long, bits long")
    words = np.zeros(blocks * BLOCK_BITS // 64, np.int64)
    set_ = bits.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words[set_["word"].to_numpy()] = set_["bits"].to_numpy()
    return words


def _probed(words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words.value
        for batch in batches:
            block, bits = _places(batch.column("digest").to_numpy(), len(table) * 64 // BLOCK_BITS)
            at = block[:, None] * BLOCK_BITS + bits.astype(np.int64)
            hit = ((table[at >> 6] >> (at & 63)) & 1).all(axis=1)
            yield batch.filter(pa.array(hit))

    return run


def url_verdicts(pages: DataFrame, entries: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, listed) of every row of pages. entries:
    ENTRIES; rule is the winning entry where it is flagged as one."""
    entries = entries.dropna(subset=["host", "path", "verdict"])
    lengths = sorted(r[0] for r in entries.select(F.length("path").alias("n")).distinct().collect())
    depths = sorted(r[0] for r in entries.select(F.size(F.split("host", r"\.")).alias("n")).distinct().collect())
    host, path = canonical(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rows = rows.fillna("", ["host", "path"])
    urls = rows.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    # only ends of as many labels as some entry has, so a host of very many labels makes no more keys
    deep = F.filter(F.from_json(F.lit(json.dumps(depths)), "array<int>"), lambda n: n <= F.size(labels))
    tails = F.transform(deep, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    fitting = F.filter(F.from_json(F.lit(json.dumps(lengths)), "array<int>"), lambda n: n <= F.length("path"))
    heads = F.transform(fitting, lambda n: F.substr("path", F.lit(1), n))
    keys = urls.withColumn("tail", F.explode(tails)).withColumn("head", F.explode(heads)).withColumn("digest", key_digest(F.col("tail"), F.col("head")))
    words = pages.sparkSession.sparkContext.broadcast(bloom(entries))
    hits = keys.mapInArrow(_probed(words), keys.schema)
    found = hits.join(entries.select(F.col("host").alias("tail"), F.col("path").alias("head"), "verdict", "rule"), ["tail", "head"])
    best = F.max(F.struct("rule", (F.length("tail") + F.length("head")).alias("n"), "tail", "head", "verdict"))
    best = found.groupBy("host", "path").agg(best.alias("best"))
    out = rows.join(best, ["host", "path"], "left")
    rule = F.when(F.col("best.rule"), F.concat("best.tail", "best.head"))
    return out.select(id_col, "host", "path", rule.alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.col("best").isNotNull().alias("listed"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES + LISTED, ENTRIES))


_VALUES = ", ".join(f"('{h}', '{p}', '{v}', {str(r).lower()})" for h, p, v, r in RULES + LISTED)
OP9_SQL = f"""
WITH entries(h, p, v, is_rule) AS (VALUES {_VALUES}),
parts AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM parts),
fits AS (SELECT page_id, host, path, h || p AS entry, v, is_rule, row_number() OVER (PARTITION BY page_id ORDER BY is_rule DESC NULLS LAST, length(h) + length(p) DESC, h DESC, p DESC, v DESC) AS k
  FROM urls LEFT JOIN entries ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, CASE WHEN is_rule THEN entry END AS rule, coalesce(v, 'allow') AS verdict, entry IS NOT NULL AS listed FROM fits WHERE k = 1
"""
