"""Chunks of texts: pages, heading sections, paragraph packing, course segments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from tessera.functions.text import once, stripped

#: Fixed sizes, in characters.
LEAST_PAGE, MOST_SEGMENT, OVERVIEW = 100, 2000, 800


@F.pandas_udf(ArrayType(StringType()))
def _packed(texts: pd.Series, most: pd.Series) -> pd.Series:
    def parts(text: str | None, most: int) -> list[str] | None:
        if text is None or len(text) <= most:
            return None if text is None else [text]
        out, size = [], most
        for paragraph in filter(str.strip, text.split("\n")):
            if not out or size + len(paragraph) > most:
                out.append([])
                size = 0
            out[-1].append(paragraph)
            size += len(paragraph)
        return ["\n".join(x) for x in out]

    return pd.Series([parts(t, int(n)) for t, n in zip(texts, most)], dtype=object)


def long_split(text: Column, most: int = MOST_SEGMENT) -> Column:
    """A text of at most so many characters whole; else its lines that aren't blank, joined
    while their own lengths sum to at most so many. One pass over a text, whatever its length."""
    return _packed(text, F.lit(most))


@F.pandas_udf(ArrayType(IntegerType()))
def _gathered(lengths: pd.Series, least: pd.Series) -> pd.Series:
    """Where each block ends, as a number of pages; of pages only the lengths come here, as a batch of texts can be of any size."""

    def ends(lengths, least: int) -> list[int] | None:
        if lengths is None:
            return None
        out, size, begun = [], 0, False
        for i, n in enumerate(lengths, 1):
            size, begun = size + int(n) + 2 * begun, True
            if size >= least:
                out.append(i)
                size, begun = 0, False
        if begun and out:
            out[-1] = len(lengths)
        elif begun:
            out.append(len(lengths))
        return out

    return pd.Series([ends(x, int(n)) for x, n in zip(lengths, least)], dtype=object)


def short_merged(pages: Column, least: int = LEAST_PAGE) -> Column:
    """Pages gathered until a block has so many characters, a blank line between them; a short rest joins the last block."""
    ends = _gathered(F.transform(pages, F.length), F.lit(least))
    block = lambda x, end, i: F.array_join(F.slice(x["pages"], F.coalesce(F.get(x["ends"], i - 1), F.lit(0)) + 1, end - F.coalesce(F.get(x["ends"], i - 1), F.lit(0))), "\n\n")
    return once(F.struct(pages.alias("pages"), ends.alias("ends")), lambda x: F.transform(x["ends"], lambda end, i: block(x, end, i)))


def heading_sections(lines: DataFrame, key: str = "doc_id", heading: str = r"^#{1,6}\s+\S") -> DataFrame:
    """(key, section, heading, n_lines, n_chars) of lines (key, line_no, line):
    a section starts at each heading line; lines before the first are section 0."""
    w = Window.partitionBy(key).orderBy("line_no")
    starts = F.col("line").rlike(heading)
    rows = lines.withColumn("section", F.sum(starts.cast("int")).over(w))
    title = F.max(F.when(starts, F.regexp_replace("line", r"^#{1,6}\s+", "")))
    return rows.groupBy(key, "section").agg(F.coalesce(title, F.lit("")).alias("heading"), F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def pages_of(text: Column) -> Column:
    """[(page, text)] of a text with lines ``## 第 N 页``."""
    mark = r"(?m)^## 第 (\d+) 页$"
    numbers = F.transform(F.regexp_extract_all(text, F.lit(mark), 1), lambda n: n.cast("int"))
    bodies = F.slice(F.transform(F.split(text, mark), stripped), F.lit(2), F.size(F.split(text, mark)))
    return F.zip_with(numbers, bodies, lambda n, b: F.struct(n.alias("page"), b.alias("text")))


def segment_ids(rows: DataFrame, key: str, order: list[str], prefix: str) -> DataFrame:
    """rows with chunk_id prefix__key__0001, numbered in order, with more digits from 10000 on."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("chunk_id", F.concat_ws("__", F.lit(prefix), F.col(key).cast("string"), F.format_string("%04d", n)))


def labelled_text(parts: list[tuple[str, Column]]) -> Column:
    """``label：value`` lines; lines without a label are left out if empty."""
    out = [F.concat(F.lit(f"{label}："), F.coalesce(v, F.lit(""))) if label else F.coalesce(v, F.lit("")) for label, v in parts]
    return F.array_join(F.filter(F.array(*out), lambda x: x != ""), "\n")
