"""Positions in texts: lines, pages and headings at a line, quotes, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import once, stripped

CONTEXT_LINES = 3
#: Line ends of texts, as str.splitlines has them.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text", end: str = "\n") -> DataFrame:
    """(key, line_no, line), lines numbered from 1."""
    return docs.select(key, F.posexplode(F.split(text, end))).select(key, (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line"))


def as_of(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """The last value that isn't null at or before each row."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def heading_path(rows: DataFrame, key: str = "doc_id", levels: int = 6) -> DataFrame:
    """rows of lines() with the path of markdown headings that hold at each line:
    a level's heading lasts until one of its own or a higher level."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1))
    rows = rows.withColumn("depth", F.when(depth > 0, depth))
    for n in range(1, levels + 1):
        title = F.struct("line_no", F.regexp_replace("line", r"^#{1,6}\s+", "").alias("title"))
        rows = rows.withColumn(f"h{n}", F.last(F.when(F.col("depth") == n, title), ignorenulls=True).over(w))
    held = []
    for n in range(1, levels + 1):
        above = F.coalesce(F.greatest(*(F.col(f"h{m}.line_no") for m in range(1, n)), F.lit(0), F.lit(0)), F.lit(0))
        held.append(F.when(F.col(f"h{n}.line_no") >= above, F.col(f"h{n}.title")))
    path = F.array_compact(F.array(*held))
    return rows.withColumn("heading_path", path).drop("depth", *(f"h{n}" for n in range(1, levels + 1)))


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of a character offset from 0."""
    before = F.substr(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1


def context(text: Column, first: Column, last: Column, around: int = CONTEXT_LINES) -> Column:
    """Lines first..last with so many around them, blank ones left out."""
    all_ = F.split(text, "\n")
    start = F.greatest(first - around, F.lit(1))
    span = F.slice(all_, start, F.least(last + around, F.size(all_)) - start + 1)
    return F.array_join(F.filter(span, lambda x: F.trim(x) != ""), "\n")


def located(text: Column, quote: Column) -> Column:
    """Where a quote stands: exactly, or by the longest of its parts around ellipses that
    stands there, the first of equally long ones (approximate), else unmatched; offsets from 0, -1 if unmatched."""
    quote = stripped(quote)
    parts = F.filter(F.transform(F.split(quote, r"\.{3,}|…+"), stripped), lambda p: F.length(p) >= 2)
    placed = F.transform(parts, lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), F.position(p, text).alias("at")))
    def found(x: Column) -> Column:
        whole, near = (F.length(quote) > 0) & (x["exact"] > 0), x["near"].isNotNull()
        kind = F.when(whole, F.lit("exact")).when(near, F.lit("approximate")).otherwise(F.lit("unmatched"))
        start = F.when(whole, x["exact"] - 1).when(near, x["near"]["at"] - 1).otherwise(F.lit(-1))
        size = F.when(whole, F.length(quote)).when(near, -x["near"]["n"]).otherwise(F.lit(0))
        return F.struct(kind.alias("confidence"), start.alias("char_start"), (start + size).alias("char_end"))
    return once(F.struct(F.instr(text, quote).alias("exact"), F.array_min(F.filter(placed, lambda p: p["at"] > 0)).alias("near")), found)


def candidate_sources(wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """For each (ref_id, source_path, filename, source_id) the sources of the best
    level: by path, else by file name, else by id, else all of its case (case_id on both sides)."""
    s = sources.select("case_id", F.col("source_path").alias("s_path"), F.col("filename").alias("s_file"), F.col("source_id").alias("s_id"))
    fits = lambda a, b: (F.col(a) != "") & (F.col(a) == F.col(b))
    level = F.when(fits("source_path", "s_path"), 0).when(fits("filename", "s_file"), 1).when(fits("source_id", "s_id"), 2).otherwise(3)
    rows = wanted.join(s, "case_id").withColumn("level", level)
    best = F.min("level").over(Window.partitionBy("case_id", "ref_id"))
    return rows.withColumn("best", best).where("level = best").select("case_id", "ref_id", F.col("s_id").alias("source_id"), "level")


def resolved(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """Where references stand. refs: (ref_id, case_id, source_path, filename,
    source_id, quote, line_start, line_end); sources: (case_id, source_path,
    filename, source_id, text). In the sources of a reference's best level, in order of
    their ids, a valid line span counts first, then the quote, exactly or nearly.
    Returns (case_id, ref_id, source_id, confidence, error, line_start, line_end, excerpt, context, anchor_id)."""
    asked = refs.select("case_id", "ref_id", "quote", F.col("line_start").alias("l_start"), F.col("line_end").alias("l_end"))
    found = candidate_sources(refs, sources).join(asked, ["case_id", "ref_id"]).join(sources.select("case_id", "source_id", "text"), ["case_id", "source_id"])
    n = F.size(F.split("text", "\n"))
    valid = (F.col("l_start") >= 1) & (F.col("l_end") >= F.col("l_start")) & (F.col("l_end") <= n)
    rows = found.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn("at", located(F.col("text"), F.coalesce("quote", F.lit(""))))
    rank = F.when(F.col("valid"), 0).when(F.col("at.confidence") == "exact", 1).when(F.col("at.confidence") == "approximate", 2).otherwise(3)
    rows, hit = rows.withColumn("rank", rank), F.col("rank") < 3
    at = lambda span, offset: F.when(F.col("rank") == 0, F.col(span)).when(hit, line_of(F.col("text"), F.col(offset)))
    rows = rows.withColumn("line_start", at("l_start", "at.char_start")).withColumn("line_end", at("l_end", "at.char_end"))
    excerpt = F.when(hit, F.array_join(F.slice(F.split("text", "\n"), F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n"))
    around = F.when(hit, context(F.col("text"), F.col("line_start"), F.col("line_end")))
    # texts end here: what is ranked and shuffled is narrow
    rows = rows.withColumn("excerpt", excerpt).withColumn("context", around).drop("text", "at", "valid")
    w = Window.partitionBy("case_id", "ref_id").orderBy("rank", "source_id")
    best = rows.withColumn("k", F.row_number().over(w)).where("k = 1")
    spanned = F.col("l_start").isNotNull() & F.col("l_end").isNotNull()
    error = F.when(~hit & spanned, "line_span_invalid_and_quote_not_found").when(~hit, "quote_not_found").otherwise("")
    confidence = F.element_at(F.array(*map(F.lit, ("validated_span", "exact", "approximate", "unmatched"))), F.col("rank") + 1)
    source = F.when(hit, F.col("source_id")).otherwise(F.lit(""))
    anchor = F.when(hit, F.concat("source_id", F.lit("#line-"), F.col("line_start").cast("string")))
    out = best.select("case_id", "ref_id", source.alias("source_id"), confidence.alias("confidence"), error.alias("error"), "line_start", "line_end", "excerpt", "context", anchor.alias("anchor_id"))
    none = refs.join(out.select("case_id", "ref_id"), ["case_id", "ref_id"], "left_anti").select("case_id", "ref_id", F.lit("").alias("source_id"), F.lit("unmatched").alias("confidence"), F.lit("source_not_found").alias("error"))
    return out.unionByName(none, allowMissingColumns=True)
