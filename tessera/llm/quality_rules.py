"""Quality rules: base counts of a text, and the divergence of its character
classes and common words from those of its language.

Base rules reject texts with too few words or too many words in repeated
windows. The others are compared with their language: the Jensen-Shannon
distance (square root of the divergence, base 2, so 0..1) of two histograms,
character classes and common words, from the histograms of all texts of that
language. References are given, as a stored table fitted on clean texts, so that a verdict depends on the
document alone; or they are made of all rows that pass the base rules; each document weighs the same in them, so
a few long ones don't decide. A short text's histogram strays more by chance, so
the limits are ``class_distance + 1 / sqrt(characters)`` and ``word_distance + 2 / sqrt(words)``.
The words' histogram has a place for all other words, so a text with few or none of its
language's common words is far from the others. Guards are lengths: a text below ``min_chars`` non-space
characters or ``min_words`` words isn't judged by the one
or the other; texts of languages without a list aren't judged by words. Every
language, by its value as it stands, has a reference of character classes of its own; a
null one, or one with fewer than ``min_docs`` texts, isn't judged by classes. References
are a row for each language and broadcast only up to MAX_LANGS of them.

A null text is empty: no words, base_failed. Ties don't arise; equal rows get equal verdicts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import written
from tessera.llm.words import slices, windows

#: Common words of each language: a fixed list of function words.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "this", "are", "or", "from"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "plus", "pas", "au", "sur"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
}
CLASSES = ["lower", "upper", "digit", "symbol", "punctuation", "other"]
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED, WIDTH = 10, 20, 5
#: Distances from which a text is rejected; lengths below which a histogram isn't judged.
CLASS_DISTANCE, WORD_DISTANCE, MIN_CHARS, MIN_LENGTH = 0.15, 0.08, 200, 20
#: Texts below which a language has no reference of classes; references that are broadcast.
MIN_DOCS, MAX_LANGS = 20, 1000

_CLASS = np.full(256, 5, np.int8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[ord(c) for c in r"""!"'()+,-./:;=?@[\]^_`{}~"""]] = 4
_CLASS[[ord(c) for c in SYMBOLS]] = 3
_CLASS[0x80:0xC0] = -1  # within a character
_CLASS[[0x20, *range(9, 14)]] = -2


def _letters_beyond_ascii(data: np.ndarray) -> np.ndarray:
    """Classes of the bytes; Latin-1 letters of two bytes count as lower or upper."""
    kinds = _CLASS[data]
    lead = np.flatnonzero(data == 0xC3)
    if len(lead):
        after = data[np.minimum(lead + 1, len(data) - 1)]
        kinds[lead] = np.where((after == 0x97) | (after == 0xB7), 5, np.where(after >= 0x9F, 0, 1))
    return kinds


def _counted(common: dict[str, list[str]], width: int, carry: tuple[str, ...] = ()):
    wide = max([1, *map(len, common.values())])
    places = {lang: {w.encode(): i for i, w in enumerate(words)} for lang, words in common.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            out = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common")}
            for s in slices(batch.column("text")):
                digests, kinds = s.digests(), _letters_beyond_ascii(s.data)
                for row, (a, b) in enumerate(zip(s.offsets[:-1], s.offsets[1:])):
                    i, j = s.words[row], s.words[row + 1]
                    kind = kinds[a:b]
                    classes = np.bincount(kind[kind >= 0], minlength=len(CLASSES))
                    seen = windows(digests[i:j], width)
                    _, back, times = np.unique(seen, return_inverse=True, return_counts=True)
                    edge = np.zeros(j - i + 1, np.int32)
                    again = np.flatnonzero(times[back] > 1)
                    np.add.at(edge, again, 1)
                    np.add.at(edge, again + width, -1)
                    text = s.data[a:b].tobytes()
                    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
                    lang = langs[s.first + row]
                    found = np.zeros(wide + 1, np.int64)
                    if own := places.get(lang):
                        for w in re.findall(rb"[a-z\x80-\xff]+", text.lower()):
                            if (at := own.get(w)) is not None:
                                found[at] += 1
                        found[wide] = max(j - i - found.sum(), 0)
                    for k, v in zip(out, (j - i, classes.sum(), classes[3], len(lines) - len(set(lines)), np.count_nonzero(np.cumsum(edge)), classes, found)):
                        out[k].append(v)
            columns = [pa.array(out[k], pa.int64()) for k in list(out)[:5]] + [pa.array(out[k], pa.list_(pa.int64())) for k in ("classes", "common")]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", "lang", *carry)), *columns], names=["doc_id", "lang", *carry, *out])

    return run


def distance(a, b):
    """Jensen-Shannon distance of two histograms given as arrays of counts or
    shares; null if one is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))
    share = lambda v, x: v.cast("double") / F.nullif(total(x), F.lit(0.0))
    part = lambda v, m: F.when(v > 0, v * F.log2(v / m)).otherwise(F.lit(0.0))
    both = F.zip_with(F.transform(F.col(a), lambda v: share(v, F.col(a))), F.transform(F.col(b), lambda v: share(v, F.col(b))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    far = F.aggregate(both, F.lit(0.0), lambda s, x: s + part(x["p"], (x["p"] + x["q"]) / 2) + part(x["q"], (x["p"] + x["q"]) / 2), lambda s: F.sqrt(F.greatest(s / 2, F.lit(0.0))))
    return F.when((total(F.col(a)) > 0) & (total(F.col(b)) > 0), far)


def counts(docs: DataFrame, common: dict[str, list[str]] = COMMON, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """Base counts and the two histograms of every row, with the columns in carry."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), *carry)
    whole = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, common array<long>"
    more = "".join(f"{c} {own.schema[c].dataType.simpleString()}, " for c in carry)
    return own.mapInArrow(_counted(common, width, carry), f"doc_id long, lang string, {more}{whole}")


def references(counted: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, class_ref, word_ref): the mean histogram of each language's texts; no
    class_ref for a language with fewer than min_docs texts with characters."""
    counted, kinds = counted.where("lang is not null"), []
    for name, ref in (("classes", "class_ref"), ("common", "word_ref")):
        n = F.aggregate(name, F.lit(0).cast("long"), lambda s, v: s + v)
        flat = counted.select("lang", F.posexplode(F.transform(name, lambda v: v / F.nullif(n, F.lit(0).cast("long")))).alias("i", "share"))
        mean = flat.groupBy("lang", "i").agg(F.avg(F.round("share", 9).cast("decimal(20,9)")).cast("double").alias("share"))
        kinds.append(mean.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("share", F.lit(0.0)).alias("share")))), lambda x: x["share"]).alias(ref)))
    n_docs = counted.groupBy("lang").agg(F.count(F.when(F.col("word_chars") > 0, 1)).alias("n_docs"))
    return kinds[0].join(kinds[1], "lang").join(n_docs, "lang").select("lang", F.when(F.col("n_docs") >= min_docs, F.col("class_ref")).alias("class_ref"), "word_ref")


def judged(docs: DataFrame, common: dict[str, list[str]] = COMMON, class_distance: float = CLASS_DISTANCE, word_distance: float = WORD_DISTANCE, min_chars: int = MIN_CHARS, min_words: int = MIN_LENGTH, min_docs: int = MIN_DOCS, refs: DataFrame | None = None, carry: tuple[str, ...] = (), **columns: str) -> DataFrame:
    """Base counts, distances (null: not judged) and the verdict of every row of docs, with its columns in carry. refs: what references() made."""
    counted = written(counts(docs, common, carry=carry, **columns), "counted")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    refs = written(references(counted.where(~failed), min_docs) if refs is None else refs.select("lang", "class_ref", "word_ref"), "references")
    refs = F.broadcast(refs) if refs.count() <= MAX_LANGS else refs
    out = counted.join(refs, "lang", "left")
    far = {"class_distance": F.when(F.col("word_chars") >= min_chars, distance("classes", "class_ref")), "word_distance": F.when(F.col("n_words") >= min_words, distance("common", "word_ref"))}
    out = out.withColumns(far).withColumn("base_failed", failed)
    stray = lambda n: 1 / F.sqrt(F.greatest(n, F.lit(1)))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= F.lit(class_distance) + stray("word_chars")) & (F.coalesce("word_distance", F.lit(0.0)) <= F.lit(word_distance) + 2 * stray("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & near).drop("classes", "common", "class_ref", "word_ref", "lang")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))
