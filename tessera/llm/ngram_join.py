"""Exact Jaccard self-join of word n-gram sets by PartEnum signatures.

Two sets of sizes a and b with Jaccard similarity of ``percent`` or more differ
in at most (a + b) * (100 - percent) / (100 + percent) features. Sizes fall into
bands (r/2, r]; a set also takes part in the band above if a partner can lie
there. A band hashes the feature domain into n partitions, more than two sets
can differ in, so similar sets agree on n - k of them or more. Signatures are
enumerated subsets of partitions: single ones in wide bands; pairs in narrow
ones, where n = k + 2. A set leaves out its lightest subsets as long as every
choice of n - k partitions keeps one; the set that leaves out more decides, so
no pair is lost. A set that must keep an empty partition repeats the enumeration
under further hash functions, and only after the last of them signs empties.

A set that signs the E partitions of a wide band with FLOOR features or more
shares E - k of these signatures or more with any partner, so one that shares fewer with all others together leaves
the band. Candidates in a bucket are then verified on the words of the texts, without digests: first each
member with the bucket's smallest id, then, only between members that aren't
connected yet, every remaining pair that can be similar at all. For these, the
features of the sets concerned are ranked from the rarest on. If the rarest
common feature of two sets has rank u in one of size a, their intersection has
a - u features at most, so the other has (a - u) * (100 + percent) / percent - a
at most. Sets are joined on their rarest features where this bound holds both
ways, and leave a feature that no set of a fitting size has. So copies cost a row
each, and no link between different classes is lost; there is no cap on buckets
or partners.

Null, empty and blank texts have the empty set and no links. A text with fewer
words than ``width`` has one feature, the whole sequence. Equal rows share a
component. A null id keeps its row and joins only equal sets. Rows with one id are one document: what is
linked with one of their texts is linked with all. Inside, a class of equal sets goes by its smallest id, so that
buckets have the first document for their centre, which its copies are likelier near to than to each other; where an id
is the smallest of several classes, all but one go by numbers below all ids, so its texts are its own whatever the ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.graph import components
from tessera.llm.shared import written
from tessera.llm.words import joined, mix, slices, windows

WIDTH, PERCENT = 5, 80
#: Hash functions that a set goes through before it signs empty partitions.
SEEDS = 4
#: Features that a signed partition has, if enough have them.
FLOOR = 2
#: Partitions of a wide band, as a share of its largest size.
SHARE = 0.3


def most_apart(a: int, b: int, percent: int) -> int:
    """The largest symmetric difference of similar sets of sizes a and b."""
    return (a + b) * (100 - percent) // (100 + percent)


@lru_cache(4096)
def instances(size: int, percent: int) -> tuple[tuple[int, int, int, int, int], ...]:
    """(band, its parity, partitions, partitions in a subset, most differences) of each band a set takes part in."""
    alone = 1
    while most_apart(alone + 1, (alone + 1) * 100 // percent, percent) == 0:
        alone += 1
    if size <= alone:
        return ()  # similar sets of such sizes are equal
    top, band = max(2 * alone, alone + 1), 0
    while size > top:
        top, band = 2 * top, band + 1
    out, most = [], size * 100 // percent
    for r, parity in ((top, band % 2), (2 * top, (band + 1) % 2))[: 1 + (most > top)]:
        k = most_apart(r, r, percent)
        n, t = (k + 2, 2) if k <= 3 else (max(int(np.ceil(SHARE * r)), k + 2), 1)
        out.append((r, parity, n, t, most_apart(size, min(most, r), percent)))
    return tuple(out)


@lru_cache(64)
def subsets(n: int) -> np.ndarray:
    return np.array(list(combinations(range(n), 2)))


def signatures(features: np.ndarray, percent: int = PERCENT, seeds: int = SEEDS) -> tuple[np.ndarray, list[int]]:
    """The signatures of a set of distinct 64-bit features, the lowest bit being
    the band's parity; and for either parity the signatures that the set shares
    with any partner there, at least. Sets leave out partitions of FLOOR - 1
    features at most, so one that does so shares all but k of its own."""
    out, shared = [], [1, 1]
    for r, parity, n, t, k in instances(len(features), percent):
        for seed in range(seeds):
            salt = np.uint64(((r << 8) + seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            part = ((mix(features ^ salt) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            count = np.bincount(part, minlength=n)
            full = np.flatnonzero(count)
            sums = np.zeros(n, np.uint64)
            sums[full] = np.add.reduceat(mix(features + salt)[order], (np.cumsum(count) - count)[full])
            names = joined(mix(np.arange(n, dtype=np.uint64) + salt), sums)
            least = int(np.sort(count)[: n - k][-t:].sum())  # what the lightest choice of partitions keeps
            floor = max(min(least, FLOOR), 0 if seed == seeds - 1 else 1)
            if t == 2:
                i, j = subsets(n).T
                keep = count[i] + count[j] >= floor
                names = joined(names[i[keep]], names[j[keep]])
            else:
                names = names[count >= floor]
                if least >= FLOOR and not seed:
                    shared[parity] = max(1, len(names) - k)
            out.append(names & ~np.uint64(1) | np.uint64(parity))
            if least:
                break
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), shared


def feature_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The distinct n-grams of each text, as sorted digests."""
    for s in slices(texts):
        words = s.digests(lower=True)
        for a, b in zip(s.words[:-1], s.words[1:]):
            own = words[a:b]
            yield np.unique(windows(own, min(width, len(own)))) if len(own) else own


def _signed(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # of this task: its copies sign once
        for batch in batches:
            ids, rows, shared = batch.column(0), ([], [], []), []
            signs, offsets = [], [0]
            for i, features in enumerate(feature_sets(batch.column(1), width)):
                d = (int(features.sum(dtype=np.uint64)), int(mix(features + np.uint64(len(features))).sum(dtype=np.uint64)))
                own, least = np.zeros(0, np.uint64), None
                if len(features) and d not in seen and ids[i].is_valid:
                    seen.add(d)
                    own, least = signatures(features, percent)
                for column, x in zip(rows, (len(features), *d)):
                    column.append(x)
                signs.append(own)
                shared.append(least)
                offsets.append(offsets[-1] + len(own))
            n, d1, d2 = (np.array(x, np.uint64).view(np.int64) for x in rows)
            values = pa.array(np.concatenate([np.zeros(0, np.uint64), *signs]).view(np.int64))
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(n), pa.array(d1), pa.array(d2), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), pa.array(shared, pa.list_(pa.int32()))], names=["doc_id", "hash", "n_shingles", "d1", "d2", "signs", "shared"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (sign, doc): each member of a bucket with its smallest."""
    last_sign = last_centre = None
    for batch in batches:
        if not batch.num_rows:
            continue
        sign, doc = (batch.column(i).to_numpy() for i in (0, 1))
        new = np.concatenate([[last_sign is None or sign[0] != last_sign], sign[1:] != sign[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        centre = np.where(at >= 0, doc[np.maximum(at, 0)], last_centre if last_centre is not None else 0)
        last_sign, last_centre = sign[-1], centre[-1]
        keep = centre != doc
        keep[1:] &= (doc[1:] != doc[:-1]) | new[1:]
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (sign, centre, doc)], names=["sign", "c", "m"])


def numbered_ngrams(texts: list[str], width: int) -> list[np.ndarray]:
    """The distinct n-grams of each text as numbers that are common to the texts: equal numbers, equal words."""
    place: dict[bytes, int] = {}
    words = [[place.setdefault(w, len(place)) for w in text.encode().lower().split()] for text in texts]
    ends = np.cumsum([0, *map(len, words)])
    single = np.fromiter((w for own in words for w in own), np.int64, int(ends[-1]))
    grams, inside = single, [(a, b) for a, b in zip(ends[:-1], ends[1:])]
    if all(b - a >= width for a, b in inside):
        for step in range(1, width):  # number pairs of a number of step words and the word behind
            _, grams = np.unique(grams[:-1] * len(place) + single[step:], return_inverse=True)
        return [np.unique(grams[a : b - width + 1]) for a, b in inside]
    # a text of fewer words is one sequence
    numbers: dict[tuple, int] = {}
    def of(own: list[int]) -> np.ndarray:
        n = min(width, len(own))
        return np.unique([numbers.setdefault(tuple(own[i : i + n]), len(numbers)) for i in range(len(own) - n + 1)] if own else np.zeros(0, np.int64))
    return [of(own) for own in words]


def _verified(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for c, m in zip(batch.column("text_c"), batch.column("text_m")):
                a, b = numbered_ngrams([c.as_py() or "", m.as_py() or ""], width)
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("m"), pa.array(ok, pa.bool_())], names=["c", "m", "linked"])

    return run


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, features in enumerate(feature_sets(batch.column("text"), width)):
                yield pa.RecordBatch.from_arrays([pa.array(features.view(np.int64)), batch.column("rep").take(pa.array(np.full(len(features), i)))], names=["feature", "rep"])

    return run


def ngram_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs; other columns of
    docs are not read. component_id is the smallest id reachable by links."""
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    sets = texts.mapInArrow(_signed(width, percent), "doc_id long, hash long, n_shingles long, d1 long, d2 long, signs array<long>, shared array<int>")
    sets = written(sets.withColumn("row", F.monotonically_increasing_id()), "sets")

    rows = sets.select("row", "doc_id", "hash", "n_shingles", "d1", "d2")
    key = ["d1", "d2", "n_shingles"]
    # a class has the number of one of its rows, and its smallest id; written first, so that this
    # join has a shuffle of its own and Spark can split a large class in it
    classes = rows.where("n_shingles > 0").groupBy(*key).agg(F.min(F.when(F.col("doc_id").isNotNull(), F.col("row"))).alias("first"), F.min("doc_id").alias("least"))
    lowest = rows.agg(F.min("doc_id")).head()[0] or 0
    named = classes.where("least is not null")
    named = named.join(named.groupBy("least").agg(F.min("first").alias("own")), "least").withColumn("rep", F.when(F.col("first") == F.col("own"), F.col("least")).otherwise(F.lit(lowest) - 1 - F.col("first")))
    classes = written(named.drop("own").unionByName(classes.where("least is null"), allowMissingColumns=True), "classes")
    placed = written(rows.join(classes, key, "left").select("row", "doc_id", "hash", "n_shingles", "rep", "least", (F.col("row") == F.col("first")).alias("is_first")), "placed")
    rep_of = placed.where("doc_id is not null and rep is not null").select("row", "rep", "n_shingles")

    stars = sets.select(F.explode("signs").alias("sign"), "row").repartition("sign").sortWithinPartitions("sign", "row").mapInArrow(_stars, "sign long, c long, m long")
    members = stars.select("sign", F.explode(F.array("c", "m")).alias("row")).distinct().join(rep_of, "row").select("sign", "rep", "n_shingles").distinct()
    members = written(members.withColumn("parity", F.col("sign").bitwiseAND(F.lit(1)).cast("int")), "members")
    least = sets.where("shared is not null").join(rep_of.select("row", "rep"), "row").select("rep", F.posexplode("shared").alias("parity", "shared")).groupBy("rep", "parity").agg(F.max("shared").alias("shared"))

    def common(rows: DataFrame) -> DataFrame:
        """Without buckets of a single set."""
        return rows.join(rows.groupBy("sign").agg(F.count("*").alias("k"), F.min("rep").alias("centre")).where("k > 1").select("sign", "centre"), "sign")

    able = common(members).groupBy("rep", "parity").agg(F.count("*").alias("has")).join(least, ["rep", "parity"]).where("has >= shared").select("rep", "parity")
    members = written(common(members.join(able, ["rep", "parity"], "left_semi")), "able").drop("parity")
    sizes = classes.where("rep is not null").select("rep", "n_shingles")
    pairs = members.where("rep <> centre").groupBy(F.col("centre").alias("c"), F.col("rep").alias("m"), F.col("n_shingles").alias("m_n")).agg(F.count("*").alias("shared"))
    pairs = pairs.join(sizes.select(F.col("rep").alias("c"), F.col("n_shingles").alias("c_n")), "c")
    pairs = written(pairs.where(100 * F.least("c_n", "m_n") >= percent * F.greatest("c_n", "m_n")).select("c", "m", "shared"), "pairs")

    needed = placed.where("is_first").join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "doc_id", "hash")
    kept = written(texts.join(needed, ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"]).select("rep", "text"), "texts")

    def links(todo: DataFrame) -> DataFrame:
        both = todo.select("c", "m").join(kept.select(F.col("rep").alias("c"), F.col("text").alias("text_c")), "c").join(kept.select(F.col("rep").alias("m"), F.col("text").alias("text_m")), "m")
        return written(both.mapInArrow(_verified(width, percent), "c long, m long, linked boolean"), "verified")

    def apart(todo: DataFrame, comps: DataFrame) -> DataFrame:
        for side in ("c", "m"):
            todo = todo.join(comps.select(F.col("node").alias(side), F.col("component").alias(f"{side}_comp")), side, "left")
        return todo.where(F.coalesce("c_comp", "c") != F.coalesce("m_comp", "m"))

    def extended(comps: DataFrame, more: DataFrame) -> DataFrame:
        """comps with the components that more links join together."""
        new = more.where("linked").select("c", "m")
        if not new.head(1):
            return comps
        held = comps.select(F.col("node").alias("c"), F.col("component").alias("m"))
        return written(components(held.unionByName(new), "c", "m"), "comps")

    # each member with its best centre; then the pairs of stars that are still apart
    best = pairs.groupBy("m").agg(F.max_by("c", F.struct("shared", -F.col("c"))).alias("c"))
    done = links(best)
    # texts of one id are one document
    several = placed.where("doc_id is not null and rep is not null").groupBy("doc_id").agg(F.min("rep").alias("c"), F.max("rep").alias("m")).where("c < m").select("doc_id", "c")
    shared = placed.where("rep is not null").join(several, "doc_id").where("c < rep").select("c", F.col("rep").alias("m"))
    comps = written(components(done.where("linked").select("c", "m").unionByName(shared), "c", "m"), "comps")
    more = links(apart(pairs.select("c", "m").join(done.select("c", "m"), ["c", "m"], "left_anti"), comps).select("c", "m"))
    done = done.unionByName(more)
    comps = extended(comps, more)

    # buckets that hold several components yet: every pair that is apart and can be similar
    def mixed(rows: DataFrame) -> DataFrame:
        several = rows.groupBy("sign").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n_shingles").alias("smallest")).where("lo <> hi")
        return rows.join(several.select("sign", "smallest"), "sign")

    members = members.select("sign", "rep", "n_shingles").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    members = written(mixed(members).drop("smallest"), "mixed")
    inside = kept.join(members.select("rep").distinct(), "rep", "left_semi")
    features = written(inside.mapInArrow(_features(width), "feature long, rep long"), "features")
    common = features.groupBy("feature").agg(F.count("*").alias("sets")).where("sets > 1")
    ranked = features.join(common, "feature", "left").withColumn("rank", F.row_number().over(Window.partitionBy("rep").orderBy(F.coalesce("sets", F.lit(1)), "feature")) - 1)
    sized = members.select("rep", "n_shingles", "component").distinct()
    members = ranked.where("sets > 1").drop("sets").join(sized, "rep").where(f"rank <= n_shingles - ({percent} * n_shingles + 99) div 100").withColumnRenamed("feature", "sign")
    members = members.withColumn("largest", F.expr(f"(n_shingles - rank) * {100 + percent} div {percent} - n_shingles"))
    members = written(mixed(members).where("largest >= smallest").drop("smallest"), "open")
    members = mixed(members).drop("smallest")
    x, y = (members.select("sign", *(F.col(c).alias(f"{c}_{side}") for c in ("rep", "n_shingles", "component", "largest"))) for side in "xy")
    can = (F.col("n_shingles_x") <= F.col("largest_y")) & (F.col("n_shingles_y") <= F.col("largest_x"))
    rest = x.join(y, (x["sign"] == y["sign"]) & (F.col("rep_x") < F.col("rep_y")) & (F.col("component_x") != F.col("component_y")) & can)
    rest = written(rest.select(F.col("rep_x").alias("c"), F.col("rep_y").alias("m")).distinct().join(done.select("c", "m"), ["c", "m"], "left_anti"), "rest")
    comps = extended(comps, links(rest))

    comps = classes.select("rep", "least").join(comps.withColumnRenamed("node", "rep"), "rep")
    comps = comps.join(comps.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("rep", "component_id")
    return placed.join(comps, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "least", "doc_id").alias("component_id"))


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
