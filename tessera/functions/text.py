"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(c: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def single_line(c: Column) -> Column:
    return stripped(F.regexp_replace(c, r"(?U)\s+", " "))


def without_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def tokens(c: Column) -> Column:
    """Search tokens: runs of a-z and 0-9 as they are; of each run of CJK
    characters all 1- to 4-grams, by length, then place. The rest separates."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"([\x{4e00}-\x{9fff}]+|[a-z0-9]+)"), 1)

    def grams(run: Column) -> Column:
        n = F.length(run)
        by_size = F.transform(F.sequence(F.lit(1), F.least(F.lit(4), n)), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(run, i, k)))
        return F.when(run.rlike("^[a-z0-9]+$"), F.array(run)).otherwise(F.flatten(by_size))

    return F.flatten(F.transform(runs, grams))


def latin_tokens(c: Column) -> Column:
    """tokens() of a text without CJK characters."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)


def preview(c: Column, size: int = 120) -> Column:
    line = single_line(c)
    return F.when(F.length(line) > size, F.concat(F.substring(line, 1, size), F.lit("..."))).otherwise(line)


def bounded(c: Column, size: int, marker: str = "\n...\n") -> Column:
    """Head and tail around a marker, size characters in all, where the text is longer."""
    room = size - len(marker)
    head = (room + 1) // 2
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(head)), F.lit(marker), F.right(c, F.lit(room - head)))).otherwise(c)


def text_hash(c: Column) -> Column:
    return F.sha2(stripped(c), 256)


def once(value: Column, use) -> Column:
    """use(value), with value computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unfenced(c: Column) -> Column:
    """The inside of a text that is a fenced JSON block as a whole, or the text, stripped."""
    whole = stripped(c)
    fence = r"(?is)^```(?:json)?\s*(.*?)\s*```$"
    return F.when(whole.rlike(fence), F.regexp_extract(whole, fence, 1)).otherwise(whole)


def without_citation_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"\s*\[引用[0-9]+\]", "")


def contains_any(text: Column, keywords: list[str]) -> Column:
    return F.reduce(F.array(*map(F.lit, keywords)), F.lit(False), lambda s, k: s | F.contains(text, k)) if keywords else F.lit(False)
