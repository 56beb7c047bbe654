"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted in tokens by (source, language, topic). The sample has a
documented size, ``keep`` of all tokens that a target lets in, and each value of a
dimension its target share of it. A value with fewer tokens than that gives all
it has, and the others share the rest in proportion to their targets. Raking then scales the cells to each
marginal in turn until all agree; a cell that reaches its own tokens is cut there
(probability 1) and the other cells of the value take what it lacks. So a rare
value decides about its own documents and not about the corpus, the expected tokens of the sample have
these marginals, and no document is drawn twice. Values that can't reach their share, and
raking that ends unconverged (each marginal within tolerance of its own size), after max_rounds or as two rounds
bring it no nearer, which is so where cells have too few tokens for all marginals at once, are told in a warning; ``marginals`` has
the wanted and the expected share of every value. ``raked`` without keep instead divides
by the largest factor of any cell: exact shares, in a sample that the rarest cell limits.
The draw is a hash of id and text: the same for equal rows, in every run, at every partitioning.

Without targets a marginal's shares are tempered, ``share ** exponent`` and
rescaled, which lessens a dominant source. A value that a given
target doesn't list has share 0; listed values that no document has are left out and
the others rescaled. Cells are counts of values and not of documents: up to MAX_CELLS of them, which is
checked, are raked as arrays and broadcast to the documents; more are a table that Spark joins to itself in
each round, written to the shared folder, and documents meet it in a plain join. Both give the same.

Topics are given in a column, or learned (``Topics``). Null sources, languages and topics
count as a value of their own (``?``); a null, empty or blank text has no tokens and the topic
EMPTY. A cell without tokens has probability 1. Columns of docs pass, whatever their names.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import fresh, written
from tessera.llm.words import slices

EXPONENTS = {"source": 0.8, "lang": 0.9, "topic": 1.0}
DIMENSIONS = ["source", "lang", "topic"]
#: The distance of a marginal from its share, as a part of the share; rounds; the part of the last distance that a round has to get below.
TOLERANCE, MAX_ROUNDS, PROGRESS, MAX_CELLS = 1e-2, 30, 0.9, 100_000
#: Topics of a language, places of a vector, passes, languages with topics of their own.
TOPICS, DIMS, STEPS, MAX_LANGS, SEED = 4, 64, 5, 32, 11
OTHER_LANGS, EMPTY = "*", "no words"
#: Tokens of the sample, as a share of the tokens that can be drawn.
KEEP = 0.85


class Topics:
    """Centres of document vectors, by language: a document has the topic of the nearest centre.

    A vector counts a text's words in DIMS hashed places, as square roots scaled to unit length. The
    centres are learned from all documents by spherical k-means, a Spark pass a step: tasks sum the
    vectors of each (language, topic), and K x DIMS sums of each of MAX_LANGS languages at most, as rows, reach
    the driver; rarer languages share one set. So topics divide each language and don't repeat it."""

    def __init__(self, centres: dict[str, np.ndarray]):
        self.centres = centres

    def nearest(self, lang: str | None, vectors: np.ndarray) -> np.ndarray:
        centres = self.centres.get(lang, self.centres.get(OTHER_LANGS))
        return np.zeros(len(vectors), np.int64) if centres is None else np.argmax(np.round(vectors @ centres.T, 9), axis=1)

    @classmethod
    def learned(cls, docs: DataFrame, k: int = TOPICS, steps: int = STEPS) -> Topics:
        langs = [r[0] for r in docs.where("lang is not null").groupBy(F.col("lang").cast("string").alias("l")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(MAX_LANGS).collect()]
        rows = written(_own(docs).mapInArrow(_vectors, "lang string, vector array<float>"), "vectors")
        names = [*langs, OTHER_LANGS]
        rng = np.random.default_rng(SEED)
        start = rng.random((k, DIMS))
        self = cls({name: start / np.linalg.norm(start, axis=1, keepdims=True) for name in names})
        for _ in range(steps):
            sums: dict[str, dict[int, np.ndarray]] = {}
            out = rows.mapInArrow(_summed(self, langs), "lang string, topic int, sums array<double>")
            places = out.select("lang", "topic", F.posexplode("sums").alias("place", "part"))
            for r in places.groupBy("lang", "topic", "place").agg(F.sum(F.round("part", 6).cast("decimal(30,6)")).cast("double").alias("sum")).collect():
                sums.setdefault(r["lang"], {}).setdefault(r["topic"], np.zeros(DIMS))[r["place"]] = r["sum"]
            for name, own in sums.items():
                centres = self.centres[name].copy()
                for t, v in own.items():
                    centres[t] = v
                norms = np.linalg.norm(centres, axis=1, keepdims=True)
                self.centres = self.centres | {name: centres / np.where(norms > 0, norms, 1)}
        return self


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def vectors_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each text, and its number of words."""
    out, words = np.zeros((len(texts), DIMS)), np.zeros(len(texts), np.int64)
    for s in slices(texts):
        place = (s.digests(lower=True) >> np.uint64(64 - DIMS.bit_length() + 1)).astype(np.int64)
        row = np.repeat(np.arange(s.first, s.last), np.diff(s.words))
        np.add.at(out, (row, place), 1)
        words[s.first : s.last] = np.diff(s.words)
    out = np.sqrt(out)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1), words


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors, words = vectors_of(batch.column("text"))
        some = words > 0
        flat = pa.array(vectors[some].astype(np.float32).ravel())
        yield pa.RecordBatch.from_arrays([batch.column("lang").filter(pa.array(some)), pa.ListArray.from_arrays(pa.array(np.arange(some.sum() + 1) * DIMS, pa.int32()), flat)], names=["lang", "vector"])


def _summed(topics: Topics, langs: list[str]):
    """Of a task: for each language and topic the number and the sum of its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            vectors = batch.column("vector").flatten().to_numpy().astype(np.float64).reshape(-1, DIMS)
            lang = np.array([x if x in langs else OTHER_LANGS for x in batch.column("lang").to_pylist()], dtype=object)
            for name in dict.fromkeys(lang):
                own = vectors[lang == name]
                at = topics.nearest(name, own)
                for t in np.unique(at):
                    held = sums.setdefault((name, int(t)), np.zeros(DIMS))
                    held += own[at == t].sum(axis=0)
        rows = [{"lang": k[0], "topic": k[1], "sums": v.tolist()} for k, v in sums.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("lang", pa.string()), ("topic", pa.int32()), ("sums", pa.list_(pa.float64()))]))

    return run


def _measured(topics: Topics | None):
    """Batches with the topic and the words of each text behind their own columns (text first, lang second)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(0), np.array(batch.column(1).to_pylist(), dtype=object)
            if topics is None:
                names, words = batch.column(2), np.array([len(t.as_buffer().to_pybytes().split()) if t.is_valid else 0 for t in texts], np.int64)
            else:
                vectors, words = vectors_of(texts)
                found = np.zeros(len(langs), np.int64)
                for name in set(langs):
                    found[langs == name] = topics.nearest(name, vectors[langs == name])
                names = pa.array([f"topic {t}" if w else EMPTY for t, w in zip(found, words)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], names, pa.array(words)], names=[*batch.schema.names[3:], "topic", "tokens"])

    return run


def with_topics(docs: DataFrame, topics: Topics | None, topic_col: str | None, topic: str, tokens: str) -> DataFrame:
    """docs with two more columns: the topic of each row (given, or the nearest) and its words."""
    given = F.coalesce(F.col(topic_col).cast("string"), F.lit("?")) if topic_col else F.lit(None).cast("string")
    # columns by place, as any name may be taken
    own = docs.select(F.col("text").cast("string").alias("c0"), F.col("lang").cast("string").alias("c1"), given.alias("c2"), *(F.col(f"`{c}`").alias(f"c{i + 3}") for i, c in enumerate(docs.columns)))
    kinds = ", ".join(f"c{i + 3} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return own.mapInArrow(_measured(topics), f"{kinds}, topic string, tokens long").toDF(*docs.columns, topic, tokens)


def _shares(cells: DataFrame, targets: dict[str, DataFrame] | None, exponents: dict[str, float]) -> dict[str, DataFrame]:
    """(value, share) of each dimension, as tables with the columns d and d_share."""
    total = F.sum("tokens").cast("double")
    shares = {}
    for d in DIMENSIONS:
        own = cells.groupBy(F.col(d).alias("value")).agg(total.alias("has"))
        if targets and d in targets:
            own = own.join(targets[d].select("value", F.col("share").cast("double")), "value", "left").fillna(0.0, ["share"])
        else:
            whole = cells.agg(total.alias("all"))
            own = own.join(F.broadcast(whole)).withColumn("share", F.pow(F.col("has") / F.col("all"), exponents[d]))
        own = own.join(F.broadcast(own.agg(F.sum("share").alias("sum"))))
        shares[d] = written(own.select(F.col("value").alias(d), (F.col("share") / F.col("sum")).alias(f"{d}_share")), "shares")
    return shares


def _within_reach(cells: DataFrame, shares: dict[str, DataFrame], keep: float) -> tuple[dict[str, DataFrame], float]:
    """Shares that a sample of keep of the tokens can have, and its tokens: values that
    have too few give all, the others the rest. The common factor of the others comes from
    below by Newton's steps on a concave sum, a row each."""
    able = cells
    for d in DIMENSIONS:
        able = able.join(shares[d].where(F.col(f"{d}_share") > 0), d, "left_semi")
    able = written(able, "able")
    size = keep * (able.agg(F.sum("tokens")).head()[0] or 0)
    out = {}
    for d in DIMENSIONS:
        own = written(able.groupBy(d).agg(F.sum("tokens").cast("double").alias("has")).join(shares[d], d).select(d, "has", F.col(f"{d}_share").alias("share")), "values")
        factor, full = 0.0, -1
        while size:
            r = own.agg(F.count(F.when(F.col("share") * factor >= F.col("has"), 1)).alias("full"), F.sum(F.when(F.col("share") * factor >= F.col("has"), F.col("has")).otherwise(0.0)).alias("given"), F.sum(F.when(F.col("share") * factor < F.col("has"), F.col("share")).otherwise(0.0)).alias("rest")).head()
            if r.full == full or r.rest <= 0:
                break
            full, factor = r.full, (size - r.given) / r.rest
        if full > 0:
            warnings.warn(f"{full} values of {d} have fewer tokens than their share of the sample and give all they have", stacklevel=3)
        out[d] = written(own.select(d, (F.least("has", F.col("share") * factor) / F.lit(size or 1.0)).alias(f"{d}_share")), "reach")
    return out, size


def _raked_here(cells: pd.DataFrame, targets: dict[str, dict[str, float]], exponents: dict[str, float], tolerance: float, max_rounds: int, keep: float | None) -> tuple[pd.DataFrame, list[str]]:
    """raked() of a few cells, and what there is to warn of."""
    tokens, told = cells["tokens"].to_numpy(np.float64), []
    codes, wanted = {}, {}
    for d in DIMENSIONS:
        codes[d], values = pd.factorize(cells[d])
        has = np.bincount(codes[d], tokens, len(values))
        share = np.array([targets[d].get(v, 0.0) for v in values]) if d in targets else (has / tokens.sum()) ** exponents[d]
        wanted[d] = share / share.sum() if share.sum() > 0 else share
    size, most = 1.0, np.full(len(tokens), np.inf)
    if keep is not None:
        able = np.all([wanted[d][codes[d]] > 0 for d in DIMENSIONS], axis=0)
        size = keep * tokens[able].sum() or 1.0
        for d in DIMENSIONS:
            has = np.bincount(codes[d], tokens * able, len(wanted[d]))
            factor, full = 0.0, -1
            while True:
                gives_all = (wanted[d] * factor >= has) & (has > 0)
                rest = wanted[d][(has > 0) & ~gives_all].sum()
                if gives_all.sum() == full or rest <= 0:
                    break
                full, factor = gives_all.sum(), (size - has[gives_all].sum()) / rest
            if full > 0:
                told.append(f"{full} values of {d} have fewer tokens than their share of the sample and give all they have")
            wanted[d] = np.minimum(has, wanted[d] * factor) / size
        most = tokens / size
    weight, offs = tokens / size, []
    for _ in range(max_rounds):
        for d in DIMENSIONS:
            cut = np.where(weight >= most, weight, 0.0)
            total, fixed = (np.bincount(codes[d], w, len(wanted[d])) for w in (weight, cut))
            share, free = wanted[d], total - fixed
            more = (share > total) & (free > 0)
            factor = np.where(more, (share - fixed) / np.where(free > 0, free, 1.0), np.where(total > 0, share / np.where(total > 0, total, 1.0), 0.0))
            weight = np.minimum(weight * factor[codes[d]], most)
        off = 0.0
        for d in DIMENSIONS:
            total = np.bincount(codes[d], weight, len(wanted[d]))
            off = max(off, *np.where(wanted[d] > 0, np.abs(total / np.where(wanted[d] > 0, wanted[d], 1.0) - 1), total), 0.0)
        offs.append(off)
        if off <= tolerance or len(offs) > 2 and off > PROGRESS * offs[-3]:
            break
    if offs and offs[-1] > tolerance:
        told.append(_off(offs, tolerance))
    factor = weight / tokens
    probability = np.minimum(factor * size, 1.0) if keep is not None else factor / factor.max() if len(factor) and factor.max() > 0 else factor * 0.0
    return cells.assign(weight=weight, probability=probability), told


def _off(offs: list[float], tolerance: float) -> str:
    return f"raking is {offs[-1]:.4f} of a share off a marginal after {len(offs)} rounds; the tolerance is {tolerance}"


def raked(cells: DataFrame, targets: dict[str, DataFrame] | None = None, exponents: dict[str, float] = EXPONENTS, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS, keep: float | None = None) -> DataFrame:
    """cells with the probability of their documents. targets: for a dimension, (value,
    share). keep: the sample's share of the tokens; without it the largest factor is 1."""
    cells = written(cells.where("tokens > 0").select(*DIMENSIONS, "tokens"), "cells")
    if cells.count() <= MAX_CELLS:
        # of the targets only what the cells have
        given = {d: {r["value"]: r["share"] for r in t.select("value", F.col("share").cast("double")).join(cells.select(F.col(d).alias("value")).distinct(), "value", "left_semi").collect()} for d, t in (targets or {}).items()}
        out, told = _raked_here(cells.orderBy(*DIMENSIONS).toPandas(), given, exponents, tolerance, max_rounds, keep)
        for message in told:
            warnings.warn(message, stacklevel=2)
        return cells.sparkSession.createDataFrame(out, "source string, lang string, topic string, tokens long, weight double, probability double")
    shares, size = _shares(cells, targets, exponents), None
    most = F.lit(float("inf"))
    if keep is not None:
        shares, size = _within_reach(cells, shares, keep)
        most = F.col("tokens") / F.lit(size or 1.0)
    state = cells.withColumn("weight", F.col("tokens") / F.lit(size or 1.0))
    off, offs_before = 0.0, []
    for _ in range(max_rounds):
        for d in DIMENSIONS:
            cut = F.col("weight") >= most
            sums = state.groupBy(d).agg(F.sum("weight").alias("sum"), F.sum(F.when(cut, F.col("weight")).otherwise(F.lit(0.0))).alias("cut"))
            # what cut cells lack is for the others to give; to give less, all cells give less
            share, free = F.col(f"{d}_share"), F.col("sum") - F.col("cut")
            more, less = (share - F.col("cut")) / F.nullif(free, F.lit(0.0)), share / F.nullif("sum", F.lit(0.0))
            factor = sums.join(shares[d], d).select(d, F.coalesce(F.when((share > F.col("sum")) & (free > 0), more).otherwise(less), F.lit(0.0)).alias("factor"))
            state = state.join(factor, d).withColumn("weight", F.least(F.col("weight") * F.col("factor"), most)).drop("factor")
        state = written(state, "raked")
        offs = [state.groupBy(d).agg(F.sum("weight").alias("sum")).join(shares[d], d).agg(F.max(F.when(F.col(f"{d}_share") > 0, F.abs(F.col("sum") / F.col(f"{d}_share") - 1)).otherwise(F.col("sum"))).alias("off")) for d in DIMENSIONS]
        off = offs[0].union(offs[1]).union(offs[2]).agg(F.max("off")).head()[0] or 0.0
        offs_before.append(off)
        if off <= tolerance or len(offs_before) > 2 and off > PROGRESS * offs_before[-3]:
            break
    if off > tolerance:
        warnings.warn(_off(offs_before, tolerance), stacklevel=2)
    factor = F.col("weight") / F.col("tokens")
    if keep is not None:  # cells that no target lets in have left the state
        out = cells.join(state.select(*DIMENSIONS, "weight"), DIMENSIONS, "left").fillna(0.0, ["weight"])
        return written(out.select(*DIMENSIONS, "tokens", "weight", F.least(factor * F.lit(size or 0.0), F.lit(1.0)).alias("probability")), "probabilities")
    top = state.agg(F.max(factor).alias("top"))
    return written(state.join(F.broadcast(top)).select(*DIMENSIONS, "tokens", "weight", F.coalesce(factor / F.nullif("top", F.lit(0.0)), F.lit(0.0)).alias("probability")), "probabilities")


def marginals(cells: DataFrame, targets: dict[str, DataFrame] | None = None, exponents: dict[str, float] = EXPONENTS) -> DataFrame:
    """(dimension, value, tokens, wanted, expected) of raked cells: the target share of every value and that of the sample."""
    shares = _shares(cells, targets, exponents)
    drawn = F.sum(F.col("tokens") * F.col("probability"))
    whole = F.broadcast(cells.agg(drawn.alias("all")))
    parts = [cells.groupBy(d).agg(F.sum("tokens").alias("tokens"), drawn.alias("drawn")).join(shares[d], d).join(whole).select(F.lit(d).alias("dimension"), F.col(d).alias("value"), "tokens", F.col(f"{d}_share").alias("wanted"), (F.col("drawn") / F.nullif("all", F.lit(0.0))).alias("expected")) for d in DIMENSIONS]
    return parts[0].union(parts[1]).union(parts[2])


def sampled(docs: DataFrame, targets: dict[str, DataFrame] | None = None, topics: Topics | None = None, exponents: dict[str, float] = EXPONENTS, seed: int = 1, keep: float = KEEP, topic_col: str | None = None) -> DataFrame:
    """docs with topic_, probability_ and drawn_; a name that docs has already gets more underscores
    (``shared.fresh`` tells). topic_col: a column of given topics; else topics, learned from docs by default."""
    names = {c: fresh(docs, f"{c}_") for c in (*DIMENSIONS, "tokens", "probability", "drawn")}
    topics = None if topic_col else topics or Topics.learned(docs)
    measured = with_topics(docs, topics, topic_col, names["topic"], names["tokens"])
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    keyed = measured.select(value("source").alias("source"), value("lang").alias("lang"), F.col(names["topic"]).alias("topic"), F.col(names["tokens"]).alias("tokens"))
    cells = raked(keyed.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), targets, exponents, keep=keep)
    cells = cells.select(*(F.col(d).alias(names[d]) for d in DIMENSIONS), F.col("probability").alias(names["probability"]))
    cells = F.broadcast(cells) if cells.count() <= MAX_CELLS else cells
    own = measured.withColumns({names["source"]: value("source"), names["lang"]: value("lang")})
    draw = F.xxhash64(F.lit(seed), "doc_id", "text").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    out = own.join(cells, [names[d] for d in DIMENSIONS], "left").withColumn(names["probability"], F.coalesce(names["probability"], F.lit(1.0)))
    return out.withColumn(names["drawn"], draw < F.col(names["probability"])).select(*docs.columns, names["topic"], names["probability"], names["drawn"])


def drawn(docs: DataFrame, **more) -> DataFrame:
    """The rows of docs that are drawn, with its own columns only."""
    out = sampled(docs, **more)
    return out.where(F.col(fresh(docs, "drawn_"))).select(*docs.columns)


#: Shares of the query's languages; sources and topics are tempered.
TARGETS = {"lang": {"en": 0.58, "de": 0.15, "fr": 0.15, "es": 0.12}}


def op7_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    targets = {d: spark.createDataFrame(list(t.items()), "value string, share double") for d, t in TARGETS.items()}
    out = sampled(docs, targets)
    return out.select("doc_id", "source", "lang", F.col("topic_").alias("topic"), F.round("probability_", 6).alias("probability"), F.col("drawn_").alias("drawn"))
