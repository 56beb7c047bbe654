"""Tag lines of chunk texts, what their paths say, and the text that tag rules look at."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import once, stripped
from tessera.operators.locate import LINE_END

#: What a tag line and the line before it begin with, what parts paths, and the domains whose paths are read: fixed values.
MARK, KIND_MARK, BETWEEN = "标签：", "知识类型：", "；"
DOMAINS_OF_PATHS = ["销售技能", "客户经营"]


def lines_of(text: Column) -> Column:
    """The lines of a text; an end of line at the end opens no other, and an empty text has none."""
    own = F.split(F.regexp_replace(text, f"(?:{LINE_END})\\z", ""), LINE_END)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(own)


def distinct_texts(values: Column) -> Column:
    """The values, stripped, each once, without empty ones, in order."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: stripped(x.cast("string"))), lambda x: x != ""))


def tag_line(paths: Column) -> Column:
    """The line for an array of paths, empty without any."""
    own = F.filter(F.transform(F.coalesce(paths, F.array().cast("array<string>")), stripped), lambda x: x != "")
    return once(own, lambda x: F.when(F.size(x) > 0, F.concat(F.lit(MARK), F.array_join(x, BETWEEN))).otherwise(F.lit("")))


def tag_paths(paths: Column, text: Column) -> Column:
    """The given paths, and those of the text's tag lines."""
    marked = F.filter(F.transform(lines_of(F.coalesce(text, F.lit(""))), stripped), lambda x: F.startswith(x, F.lit(MARK)))
    told = F.flatten(F.transform(marked, lambda x: F.split(F.substr(x, F.lit(len(MARK) + 1)), BETWEEN)))
    return distinct_texts(F.concat(F.coalesce(paths, F.array().cast("array<string>")), told))


def without_tag_lines(text: Column) -> Column:
    kept = F.filter(lines_of(text), lambda x: ~F.startswith(stripped(x), F.lit(MARK)))
    return stripped(F.array_join(kept, "\n"))


def with_tag_line(text: Column, line: Column) -> Column:
    """The text with the line behind its first line that tells the kind of knowledge, else behind the first line."""
    def put(own: Column) -> Column:
        at = F.array_position(F.transform(own, lambda x: F.startswith(x, F.lit(KIND_MARK))), True)
        at = F.greatest(at, F.lit(1)).cast("int")
        both = F.concat(F.slice(own, F.lit(1), at), F.array(line), F.slice(own, at + 1, F.greatest(F.size(own) - at, F.lit(0))))
        return F.when(F.size(own) == 0, line).otherwise(F.array_join(both, "\n"))
    return once(lines_of(text), put)


def path_parts(paths: Column, domains: list[str] = DOMAINS_OF_PATHS) -> Column:
    """struct of domains, categories and tags of the paths of three parts or more that begin with one of domains."""
    parts = F.filter(F.transform(paths, lambda p: F.split(p, "/")), lambda p: (F.size(p) >= 3) & p[0].isin(*domains))
    part = lambda x, i: distinct_texts(F.transform(x, lambda p: p[i]))
    return once(parts, lambda x: F.struct(part(x, 0).alias("business_domains"), part(x, 1).alias("business_categories"), part(x, 2).alias("business_tags")))


def haystack(text: Column, fields: list[Column], citations: Column) -> Column:
    """What rules look at, lower-cased: the text, the fields, and quote, context and excerpt of each citation, a line each."""
    cited = F.flatten(F.transform(citations, lambda c: F.array(c["quote"], c["context"], c["source_excerpt"])))
    parts = F.concat(F.array(text, *(f.cast("string") for f in fields)), cited)
    return F.lower(F.array_join(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""), "\n"))
