"""Best-fit packing of documents into training sequences, with conflicts.

A text longer than a bin is cut into pieces of a bin's length; nothing is
dropped. Pieces are dealt to shards of about SHARD_PIECES by a hash, and each shard
is packed by itself, longest piece first: bins stand in the order of their
residual room, and a piece takes the first from its own length on that has no
conflict, so the tightest compatible one; without any it opens a bin. Bins carry
bitmaps: of the duplicate clusters they hold, of which none may come twice, and
for k = 1.. of the sources they hold k pieces of, so max_per_source is one bit.

Tokens are those of a tokenizer, counted through the digest cache, or words (white space apart) with tokenizer=None,
unless tokens_col gives counts. Clusters are exact copies
but for case and white space unless cluster_col gives others, as the components of near copies. Null and
empty texts are pieces of 0 tokens, which fit anywhere. Pieces of one document are
one cluster. Repeated rows conflict like other copies. Ties go to the smaller id, piece, and the older bin.

A shard holds pieces of all kinds: its hash takes the whole row and, of equal rows, their number, so neither
null ids nor repeated rows gather in one. Within a shard a search passes each of its bins once at most,
SHARD_PIECES squared steps at worst, whatever the conflicts.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import written
from tessera.llm.token_counts import TOKENIZER, token_counts

CAPACITY, MAX_PER_SOURCE, SHARD_PIECES = 4096, 4, 1024
#: Equal rows that are numbered at once.
COPIES = 10_000


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text."""
    for batch in batches:
        n = [len((text.as_py() or "").encode().split()) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64()), batch.column("cluster")], names=["doc_id", "source", "n_tokens", "cluster"])


def cluster_of(text: Column) -> Column:
    """A digest of the lower-cased text without white space: equal for copies but for these."""
    letters = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    for space in " \n\t\r\x0b\x0c":
        letters = F.replace(letters, F.lit(space))
    return F.xxhash64(letters)


def best_fit(sizes, clusters, sources, capacity: int, max_per_source: int) -> tuple[list[int], list[int]]:
    """(bin, offset in it) of each piece, taken in the given order."""
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    held: list[int] = []  # of each bin, the clusters in it
    counts: list[list[int]] = []  # of each bin and k, the sources with more than k pieces in it
    bins, offsets = [], []
    cluster_bit = {c: 1 << i for i, c in enumerate(dict.fromkeys(clusters))}
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    for size, cluster, source in zip(sizes, clusters, sources):
        c, s = cluster_bit[cluster], source_bit[source]
        at = bisect_left(order, (size, -1))
        while at < len(order) and (held[order[at][1]] & c or counts[order[at][1]][-1] & s):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(held)
            held.append(0)
            counts.append([0] * max_per_source)
        bins.append(b)
        offsets.append(capacity - residual)
        held[b] |= c
        k = next(k for k in range(max_per_source) if not counts[b][k] & s)
        counts[b][k] |= s
        insort(order, (residual - size, b))
    return bins, offsets


def numbered(rows: DataFrame) -> DataFrame:
    """rows with copy: 0.. among equal ones. Equal rows are counted, map side first, and made again by number."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))))
    first = F.col("block") * COPIES
    return blocks.select(*rows.columns, F.explode(F.sequence(first, F.least(first + COPIES, F.col("copies")) - 1)).alias("copy"))


def packed(docs: DataFrame, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE, shard_pieces: int = SHARD_PIECES, cluster_col: str | None = None, tokens_col: str | None = None, tokenizer: str | None = TOKENIZER, cache: str | None = None) -> DataFrame:
    """(doc_id, piece, start, n_tokens, source, bin, offset): the bin of every piece
    of every row of docs and its place in it. bin is unique over shards."""
    cluster = F.xxhash64(cluster_col) if cluster_col else cluster_of(F.col("text"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("?")).alias("source"), cluster.alias("cluster"), *([F.coalesce(F.col(tokens_col).cast("long"), F.lit(0).cast("long")).alias("n_tokens")] if tokens_col else [F.col("text").cast("string").alias("text")]))
    if tokens_col:
        rows = own.select("doc_id", "source", "n_tokens", "cluster")
    elif tokenizer:
        rows = token_counts(own, tokenizer, cache, carry=("source", "cluster")).select("doc_id", "source", "n_tokens", "cluster")
    else:
        rows = own.mapInArrow(_measured, "doc_id long, source string, n_tokens long, cluster long")
    cuts = F.greatest(F.ceil(F.col("n_tokens") / capacity).cast("int"), F.lit(1))
    pieces = numbered(rows).withColumn("piece", F.explode(F.sequence(F.lit(0), cuts - 1))).withColumn("start", F.col("piece") * F.lit(capacity).cast("long"))
    pieces = written(pieces.withColumn("n_tokens", F.least(F.col("n_tokens") - F.col("start"), F.lit(capacity).cast("long"))), "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    order = ["n_tokens", "doc_id", "piece", "cluster", "source", "copy"]

    def pack(key, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(order, ascending=[c != "n_tokens" for c in order], kind="stable", na_position="last")
        bins, offsets = best_fit(shard["n_tokens"].tolist(), shard["cluster"].tolist(), shard["source"].tolist(), capacity, max_per_source)
        return shard.assign(bin=[key[0] << 32 | b for b in bins], offset=offsets)[["doc_id", "piece", "start", "n_tokens", "source", "bin", "offset"]]

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(*order), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(pack, "doc_id long, piece int, start long, n_tokens long, source string, bin long, offset long")


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
