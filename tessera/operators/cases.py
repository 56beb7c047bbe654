"""Cases and courses: ids, chunk texts, evidence catalog, notes, upload grouping."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.text import single_line, stripped, without_spaces
from tessera.operators.chunking import labelled_text
from tessera.operators.locate import LINE_END

#: Fields of speaker notes that are left out, the audience without a rule, the group of paths without a folder: fixed values.
DROPPED_NOTES, EVERYONE, ROOT = ["教学时间", "教学方式"], "通用", "__root__"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def case_id(name: Column) -> Column:
    """A readable part of at most 80 characters and ten digits of the name's SHA-1."""
    base = F.regexp_replace(F.regexp_replace(F.lower(stripped(nfkc(name))), r"(?U)[^\w]+", "_"), "^_+|_+$", "")
    base = F.regexp_replace(F.when(base == "", "case").otherwise(F.substring(base, 1, 80)), "_+$", "")
    return F.concat_ws("_", base, F.left(F.sha1(name), F.lit(10)))


def bullets(label: str, items: Column) -> Column:
    """A heading line and ``- item`` lines, or nothing without items."""
    own = F.filter(F.transform(items, stripped), lambda x: x != "")
    return F.when(F.size(own) > 0, F.concat(F.lit(f"{label}：\n"), F.array_join(F.transform(own, lambda x: F.concat(F.lit("- "), x)), "\n"))).otherwise(F.lit(""))


def chunk_text(kind: str, fields: list[tuple[str, Column]], lists: list[tuple[str, Column]] = ()) -> Column:
    """The text of a chunk: its kind, labelled fields (kept also if empty), then lists."""
    return labelled_text([("知识类型", F.lit(kind)), *fields, *(("", bullets(label, items)) for label, items in lists)])


def numbered(text: Column, end: str = LINE_END, empty_line: bool = False) -> Column:
    """``L001: line`` for each line, with more digits from 1000 on; an end of line at the end opens no other. An empty text has no line, or one with empty_line."""
    own = F.split(F.regexp_replace(text, f"(?:{end})\\z", ""), end)
    out = F.array_join(F.transform(own, lambda x, i: F.concat(F.format_string("L%03d: ", i + 1), x)), "\n")
    return out if empty_line else F.when(text == "", F.lit("")).otherwise(out)


def deltas(answer: Column) -> Column:
    """An answer in parts of at most 18 characters that end after a sentence."""
    ends = r"。！？；\n"
    return F.regexp_extract_all(answer, F.lit(f"[^{ends}]{{0,17}}[{ends}]|[^{ends}]{{1,18}}"), 0)


def notes_kept(notes: Column, dropped: list[str] = DROPPED_NOTES) -> Column:
    """``【field】value`` or ``field：value`` lines of notes without the dropped fields; a
    field lasts until the next one."""
    mark = r"(?m)^[【\[]?([\x{4e00}-\x{9fff}]{2,8})[】\]]?[：:]"
    names, bodies = F.regexp_extract_all(notes, F.lit(mark), 1), F.split(notes, mark)
    pairs = F.zip_with(names, F.slice(bodies, F.lit(2), F.size(bodies)), lambda n, b: F.when(~n.isin(dropped) & (stripped(b) != ""), F.concat(n, F.lit("："), stripped(b))))
    head = F.filter(F.array(stripped(bodies[0])), lambda x: x != "")
    return F.when(F.size(names) == 0, notes).otherwise(F.array_join(F.concat(head, F.filter(pairs, lambda x: x.isNotNull())), "\n"))


def audience(path: Column, rules: list[tuple[str, str]], enriched: Column | None = None) -> Column:
    out = F.lit(EVERYONE)
    for keyword, name in reversed(rules):
        out = F.when(F.contains(F.lower(path), F.lit(keyword.lower())), F.lit(name)).otherwise(out)
    return out if enriched is None else F.when(F.trim(F.coalesce(enriched, F.lit(""))) != "", F.trim(enriched)).otherwise(out)


def path_groups(paths: DataFrame, key: str = "upload_id", path: str = "path") -> DataFrame:
    """(key, unit, n, names): paths by their first folder; names over 1 is a conflict of
    folders that differ in white space only."""
    parts = F.split(path, "/")
    folder = F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit(ROOT))
    return paths.groupBy(key, F.trim(folder).alias("unit")).agg(F.count("*").alias("n"), F.count_distinct(folder).alias("names"))


def evidence_catalog(evidence: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, evidence_id, kind, summary, n_refs) of evidence (case, pos, kind, text,
    refs array<struct<anchor_id, quote>>), in order: an item joins the entry with its
    kind and text, else the first one with a common reference; which one depends on the
    order, so a case is folded as a whole (it is one document's evidence)."""
    rows = evidence.withColumn("match", without_spaces(F.col("text"))).withColumn("summary", single_line(F.col("text")))

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        entries: list[dict] = []
        place: dict[tuple, int] = {}
        for row in pdf.sort_values("pos", kind="stable").itertuples(index=False):
            refs = [(r["anchor_id"], r["quote"]) for r in row.refs]
            keys = [(row.kind, "text", row.match), *((row.kind, "ref", *r) for r in refs if all(r))]
            at = next((place[k] for k in keys if k in place), None)
            if at is None:
                at = len(entries)
                entries.append({"kind": row.kind, "summary": row.summary, "refs": {}})
                place[keys[0]] = at
            entries[at]["refs"].update(dict.fromkeys(refs))
            for k in keys[1:]:
                place.setdefault(k, at)
        out = [(key[0], f"E{i:03d}", e["kind"], e["summary"], len(e["refs"])) for i, e in enumerate(entries, 1)]
        return pd.DataFrame(out, columns=["case_id", "evidence_id", "kind", "summary", "n_refs"])

    kind = evidence.schema[case].dataType.simpleString()
    return rows.groupBy(case).applyInPandas(fold, f"case_id {kind}, evidence_id string, kind string, summary string, n_refs long")


def with_fallback(flat: DataFrame, chosen: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """Citations that an answer names (selected), then all others of its evidence; each identity once."""
    rows = flat.join(chosen.select(key, F.posexplode(F.array_distinct("indexes")).alias("place", "citation_index")), [key, "citation_index"], "left")
    rows = rows.withColumn("selected", F.col("place").isNotNull())
    w = Window.partitionBy(key, *identity).orderBy(F.col("place").asc_nulls_last(), "citation_index")
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
