"""Exact top-k by inner product, score at a time over impact-ordered postings.

Vectors, as integers, go in blocks. In a block, each dimension has its postings in the order of the component, cut into segments of equally
many; the quantised impact of a segment for a query is the most that one of its components adds to a score above the least that the dimension gives. A query takes
the segments of all dimensions of a block by descending impact, in stages, and adds impacts to accumulators. What it has not taken of a dimension is worth the next
impact there at most, so an accumulator bounds its vector's score from above, and the k-th best exact score so far is what a vector has to reach. A query stops
in a block only when these bounds prove that all but FEW vectors fall short of it, or when the postings end; possible members are then scored
exactly from their vectors. What is to be reached passes from block to block of a task; each task gives its k best of each query, and Spark merges these.

Queries lie in the shared folder as arrays, which tasks map and go through in pieces: no table of queries is broadcast or gathered.

A row is a vector, so repeated rows are candidates of each other, and of two queries of one id each gets its k. Vectors that are null, or hold null, NaN, infinite
components or such beyond MOST, whose scores wouldn't fit a long, take no part. Shorter vectors count as if zeros followed. Fewer candidates than k all appear. Ties
go to the smaller id, null ids come last, and rows without an id are no queries. Other columns are not read. An empty table gives an empty one.

Bounds: a task holds BLOCKS blocks of BLOCK vectors and PIECE queries. The work is queries times vectors, less what the bounds save.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shards import Writer, folder, mapped
from tessera.llm.shared import written

SCALE, MOST, EVERY, TOP = 256, 1 << 26, 50, 5
BLOCK, BLOCKS, PIECE = 4096, 16, 1024
#: Segments of a dimension; the parts of all segments after which a query looks at its bounds; the part of a block's vectors that it rather scores exactly than tells apart.
SEGMENTS, STAGES, FEW = 32, (0.5, 0.65, 0.8, 1.0), 1 / 8
NO_ID = np.iinfo(np.int64).max
INDEX, HITS = "block long, n int, ids binary, vectors binary, postings binary", "block long, place long, query_id long, vec_id long, score long"


def integers(c: Column) -> Column:
    """floor(SCALE * x) of each component, x as double; null for vectors that take no part."""
    x = F.transform(c, lambda v: v.cast("double") * SCALE)
    return F.when(~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= MOST)), F.transform(x, lambda v: F.floor(v).cast("int")))


def _blocks(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, ids, rows = TaskContext.get().partitionId(), 0, [], []

        def block() -> pa.RecordBatch:
            x = np.zeros((len(rows), dims), np.int32)
            for i, r in enumerate(rows):
                x[i, : len(r)] = r
            postings = np.argsort(-x, axis=0, kind="stable").T.astype(np.int16)
            return pa.RecordBatch.from_pylist([{"block": part << 32 | made, "n": len(ids), "ids": np.array(ids, np.int64).tobytes(), "vectors": x.tobytes(), "postings": postings.tobytes()}], schema=BLOCK_TYPES)

        for batch in batches:
            for i, r in zip(batch.column("vec_id").to_pylist(), batch.column("x"), strict=True):
                ids.append(NO_ID if i is None else i)
                rows.append(np.asarray(r.values))
                if len(ids) == BLOCK:
                    yield block()
                    made, ids, rows = made + 1, [], []
        if ids:
            yield block()

    return run


BLOCK_TYPES = pa.schema([("block", pa.int64()), ("n", pa.int32()), *((c, pa.binary()) for c in ("ids", "vectors", "postings"))])


@dataclass
class Block:
    number: int
    ids: np.ndarray
    vectors: np.ndarray
    postings: np.ndarray  # of each dimension, the vectors by descending component
    cuts: np.ndarray  # of the segments in these
    high: np.ndarray  # of each dimension and segment, the largest and the smallest component
    low: np.ndarray

    @staticmethod
    def of(row: dict, dims: int) -> Block:
        n = row["n"]
        vectors = np.frombuffer(row["vectors"], np.int32).reshape(n, dims).astype(np.int64)
        postings = np.frombuffer(row["postings"], np.int16).reshape(dims, n).astype(np.intp)
        cuts = np.unique(np.linspace(0, n, SEGMENTS + 1).astype(int))
        at = lambda places: np.take_along_axis(vectors.T, postings[:, places], 1)
        return Block(row["block"], np.frombuffer(row["ids"], np.int64), vectors, postings, cuts, at(cuts[:-1]), at(cuts[1:] - 1))

    def members(self, query: np.ndarray, k: int, own: int, reach: float) -> np.ndarray:
        """The vectors that may be among the k of largest inner product with query: all whose bound is reach or more, but for own."""
        n, segments, up = len(self.ids), len(self.cuts) - 1, (query > 0)[:, None]
        least = np.where(query > 0, query * self.low[:, -1], query * self.high[:, 0])
        # by descending impact: segments run forward where the query's component is positive, else backward
        impact = np.where(up, query[:, None] * self.high, (query[:, None] * self.low)[:, ::-1]) - least[:, None]
        ranked, bound = np.sort(impact, axis=None), None
        for stage in STAGES:
            taken = (impact >= ranked[min(len(ranked) - 1, int(len(ranked) * (1 - stage)))]).sum(1)
            rest = np.where(taken < segments, impact[np.arange(len(query)), np.minimum(taken, segments - 1)], 0)
            met, worth = [], []
            for d in np.flatnonzero(taken):
                m, gain = taken[d], impact[d, : taken[d]] - rest[d]
                first, last, gain = (0, m, gain) if query[d] > 0 else (segments - m, segments, gain[::-1])
                met.append(self.postings[d, self.cuts[first] : self.cuts[last]])
                worth.append(np.repeat(gain, np.diff(self.cuts[first : last + 1])))
            bound = np.bincount(np.concatenate(met), np.concatenate(worth), n) + (least.sum() + rest.sum()) if met else np.full(n, least.sum() + rest.sum())
            if own >= 0:
                bound[own] = -np.inf
            if n > k:
                best = np.argpartition(-bound, k - 1)[:k]
                reach = max(reach, float((self.vectors[best] @ query).min()))
            possible = np.flatnonzero((bound >= reach) & (bound > -np.inf))
            if len(possible) <= max(k, FEW * n):
                break
        return possible


def _queries(every: int, dims: int, path: str):
    """A file for each task: the id, block and place of its queries, then their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, n = None, 0
        for row in (r for batch in batches for r in batch.to_pylist()):
            ids = np.frombuffer(row["ids"], np.int64)
            asks = np.flatnonzero((ids % every == 0) & (ids != NO_ID))
            if len(asks):
                file = file or Writer(path, "queries")
                file.add(np.column_stack([ids[asks], np.full(len(asks), row["block"]), asks, np.frombuffer(row["vectors"], np.int32).reshape(-1, dims)[asks]]).astype(np.int64))
                n += len(asks)
        if file:
            yield pa.RecordBatch.from_pylist([{"file": file.close(), "n": n}])

    return run


def _searched(files: list[str], dims: int, k: int):
    def found(blocks: list[Block], queries: np.ndarray) -> Iterator[pa.RecordBatch]:
        hits = []
        for query_id, home, place, *query in queries.tolist():
            query, reach = np.array(query, np.int64), -np.inf
            scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for b in blocks:
                members = b.members(query, k, place if b.number == home else -1, reach)
                scores, ids = np.append(scores, b.vectors[members] @ query), np.append(ids, b.ids[members])
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
                reach = float(scores[-1]) if len(best) == k else reach
            hits.append(np.column_stack([np.full(len(ids), home), np.full(len(ids), place), np.full(len(ids), query_id), ids, scores]))
        hits = np.concatenate(hits)
        columns = [pa.array(hits[:, i]) if i != 3 else pa.array(hits[:, 3], mask=hits[:, 3] == NO_ID) for i in range(5)]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in HITS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_queries(blocks: list[Block]) -> Iterator[pa.RecordBatch]:
            for file in files if blocks else ():
                queries = mapped(file).reshape(-1, 3 + dims)
                for first in range(0, len(queries), PIECE):
                    yield from found(blocks, queries[first : first + PIECE])

        held: list[Block] = []
        for row in (r for batch in batches for r in batch.to_pylist()):
            held.append(Block.of(row, dims))
            if len(held) == BLOCKS:
                yield from all_queries(held)
                held = []
        yield from all_queries(held)

    return run


def top_k(vectors: DataFrame, k: int = TOP, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose id is divisible by every, the k other rows of largest inner product."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vector_col)).alias("x")).where("x is not null")
    n, dims = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    index = written(rows.repartition(max(1, -(-n // BLOCK))).mapInArrow(_blocks(dims), INDEX), "impacts", "zstd")
    files = [r.file for r in index.select("block", "ids", "vectors").mapInArrow(_queries(every, dims, folder(spark, "queries")), "file string, n long").collect()]
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // (BLOCK * BLOCKS)))
    hits = index.repartition(tasks).mapInArrow(_searched(files, dims, k), HITS)
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.n, q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.n <> v.n WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM scored
)
SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= 5
"""
