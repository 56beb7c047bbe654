"""Chunk and document sources: JSON lines, directories, text decoding, Office XML, question tables."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.normalize import preferred

CITATION = "section_name string, source_id string, filename string, source_type string, source_path string, quote string, context string, source_excerpt string, locator map<string,string>, locator_confidence string, locator_error string, anchor_id string"
CHUNK = f"chunk_id string, chunk_type string, text string, metadata map<string,string>, citations array<struct<{CITATION.replace(' string', ': string').replace(' map', ': map')}>>, source_file string"
#: Kinds of sources by where their chunks lie: fixed values.
TRAINING, CASE = "培训资料", "绩优案例"


def chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, raw) of every line that isn't blank in the chunk files under path."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*chunks.jsonl").text(path, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("pos", "raw"))
    return rows.select("path", (F.col("pos") + 1).alias("line_no"), "raw").where(F.trim("raw") != "")


def chunks_and_errors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Parsed chunks (path, line_no, chunk columns), and (path, line_no, code) of lines that aren't."""
    parsed = chunk_lines(spark, path).withColumn("c", F.from_json("raw", CHUNK)).withColumn("keys", F.json_object_keys("raw"))
    known = F.array(*map(F.lit, ["chunk_id", "chunk_type", "text", "metadata", "citations", "source_file"]))
    code = F.when(F.col("keys").isNull(), "invalid_json").when(F.size(F.array_except("keys", known)) > 0, "unknown_field").when(F.coalesce(F.col("c.chunk_id"), F.lit("")) == "", "missing_field")
    rows = parsed.withColumn("code", code)
    return rows.where("code is null").select("path", "line_no", "c.*"), rows.where("code is not null").select("path", "line_no", "code")


def strict_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON lines; if some line isn't one, the first of them is told and nothing is returned."""
    good, bad = chunks_and_errors(spark, path)
    first = bad.orderBy("path", "line_no").head(1)
    if first:
        raise ValueError(f"{first[0].path}: line {first[0].line_no}: {first[0].code}")
    return good


def source_kind(relative: Column) -> Column:
    """chunk/x.chunks.jsonl is training material, <case>/chunks.jsonl a case, else null."""
    return F.when(relative.rlike(r"^chunk/[^/]+\.chunks\.jsonl$"), TRAINING).when(relative.rlike(r"^[^/]+/chunks\.jsonl$"), CASE)


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, else as GBK, whatever isn't valid replaced."""

    @F.pandas_udf("string")
    def gbk(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else bytes(b).decode("gb18030", "replace"))

    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(gbk(content))


def _docx(file: zipfile.ZipFile) -> str:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    out = []
    for node in ElementTree.fromstring(file.read("word/document.xml")).find(f"{w}body"):
        if node.tag == f"{w}p":
            text = "".join(t.text or "" for t in node.iter(f"{w}t")).strip()
            style = node.find(f"{w}pPr/{w}pStyle")
            level = re.search(r"(?i)heading ?(\d)", style.get(f"{w}val") or "") if style is not None else None
            out.append(("#" * int(level[1]) + " " if level and text else "") + text)
        elif node.tag == f"{w}tbl":
            rows = [["".join(t.text or "" for t in cell.iter(f"{w}t")).strip() for cell in row.iter(f"{w}tc")] for row in node.iter(f"{w}tr")]
            if rows:
                out += ["| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * len(rows[0]), *rows[1:]]]
    return "\n".join(x for x in out if x)


def _related(file: zipfile.ZipFile, part: str, kind: str) -> dict[str, str]:
    """id -> name of the parts of a kind that a part refers to."""
    folder, name = part.rsplit("/", 1)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in file.namelist():
        return {}
    own = {r.get("Id"): r for r in ElementTree.fromstring(file.read(rels)) if (r.get("Type") or "").endswith(f"/{kind}")}
    return {k: posixpath.normpath(posixpath.join(folder, r.get("Target"))).lstrip("/") if not r.get("Target").startswith("/") else r.get("Target").lstrip("/") for k, r in own.items()}


def _slides(file: zipfile.ZipFile) -> list[str]:
    """The slides' parts in the order of the presentation, or by number where it tells none."""
    r = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    p = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
    named = _related(file, "ppt/presentation.xml", "slide")
    if named:
        order = [named.get(x.get(r)) for x in ElementTree.fromstring(file.read("ppt/presentation.xml")).iter(f"{p}sldId")]
        return [x for x in order if x in file.namelist()]
    numbered = sorted((int(m[1]), n) for n in file.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    return [n for _, n in numbered]


def _pptx(file: zipfile.ZipFile) -> str:
    """Texts, table rows and notes of each slide, under a line with its number."""
    a, p = "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/presentationml/2006/main}"
    def text(body) -> str:
        return "\n".join("".join(t.text or "" for t in x.iter(f"{a}t")) for x in body.iter(f"{a}p")).strip()
    out = []
    for page, name in enumerate(_slides(file), 1):
        parts = []
        for shape in ElementTree.fromstring(file.read(name)).iter():
            if shape.tag == f"{p}sp" and (body := shape.find(f"{p}txBody")) is not None:
                parts.append(text(body))
            elif shape.tag == f"{a}tbl":
                parts += [" | ".join(filter(None, (text(cell) for cell in row.iter(f"{a}tc")))) for row in shape.iter(f"{a}tr")]
        for notes in _related(file, name, "notesSlide").values():
            for shape in ElementTree.fromstring(file.read(notes)).iter(f"{p}sp"):
                mark, body = shape.find(f"{p}nvSpPr/{p}nvPr/{p}ph"), shape.find(f"{p}txBody")
                if mark is not None and mark.get("type") == "body" and body is not None and text(body):
                    parts.append(f"### 讲师备注\n{text(body)}")
        if parts := list(filter(None, parts)):
            out.append("\n".join([f"## 第 {page} 页", *parts]))
    return "\n\n".join(out)


def office_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, image, size, sha256) of the pictures inside the docx and pptx files under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{docx,pptx}").load(path).select("path", "content")

    def images(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"]):
                try:
                    file = zipfile.ZipFile(io.BytesIO(content))
                    rows += [(p, n, len(data := file.read(n)), hashlib.sha256(data).hexdigest()) for n in sorted(file.namelist()) if re.match(r"(word|ppt)/media/[^/]+$", n)]
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(rows, columns=["path", "image", "size", "sha256"])

    return files.mapInPandas(images, "path string, image string, size long, sha256 string")


def case_sections(texts: DataFrame, root: str) -> DataFrame:
    """(case_name, section_dir, section_name, filename, source_type, text) of texts (path, text) under root: its
    folders are cases, and each folder in them, and they themselves, sections. Of files of a section with one type and text one stays."""
    parts = F.split(F.regexp_replace("path", f"^.*?{re.escape(root.rstrip('/').removeprefix('file://'))}/", ""), "/")
    rows = texts.withColumn("parts", parts).where(F.size("parts") >= 2)
    folder = F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1), "/")
    rows = rows.select(F.col("parts")[0].alias("case_name"), folder.alias("section_dir"), F.element_at("parts", -2).alias("section_name"), F.element_at("parts", -1).alias("filename"), "text", "path")
    rows = rows.withColumn("source_type", F.lower(F.substring_index("filename", ".", -1))).where(F.col("source_type").isin("txt", "docx", "pptx", "pdf"))
    same = [F.col("section_dir"), F.col("source_type"), F.sha2("text", 256)]
    return preferred(rows, same, F.col("filename"), F.trim("text") == "", "path").drop("path")


def office_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, warning) of the docx, pptx and txt files under path, one task per
    files' bytes; PDF has no parser here and gets a warning."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"]):
                kind, text, warning = p.rsplit(".", 1)[-1].lower(), "", ""
                try:
                    if kind in ("docx", "pptx"):
                        text = (_docx if kind == "docx" else _pptx)(zipfile.ZipFile(io.BytesIO(content)))
                    elif kind == "txt":
                        try:
                            text = content.decode()
                        except UnicodeDecodeError:
                            text = content.decode("gb18030", "replace")
                    else:
                        warning = f"unsupported: {kind}"
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    warning = f"unreadable: {type(e).__name__}"
                rows.append((p, text, warning))
            yield pd.DataFrame(rows, columns=["path", "text", "warning"])

    return files.mapInPandas(parse, "path string, text string, warning string")


def question_table(spark: SparkSession, path: str, most: int = 100) -> DataFrame:
    """(row_index, question, answer) of a CSV table with a header; blank questions go."""
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    if len(rows.columns) < 2:
        raise ValueError("two columns are needed")
    q, a = rows.columns[:2]
    numbered = rows.select(F.monotonically_increasing_id().alias("i"), F.trim(F.col(f"`{q}`")).alias("question"), F.coalesce(F.col(f"`{a}`"), F.lit("")).alias("answer")).where("question <> ''")
    out = numbered.orderBy("i").limit(most + 1).toPandas()
    if len(out) > most:
        raise ValueError(f"more than {most} questions")
    out["i"] = range(1, len(out) + 1)
    return spark.createDataFrame(out.rename(columns={"i": "row_index"}), "row_index long, question string, answer string")


def zip_violations(spark: SparkSession, path: str, most: int = 2000, ratio: int = 100, size: int = 2 << 30) -> DataFrame:
    """(path, entry, code) of entries that an upload may not have; a file that is no archive has one without a name."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                try:
                    infos = zipfile.ZipFile(io.BytesIO(content)).infolist()
                except zipfile.BadZipFile:
                    yield pd.DataFrame([(p, "", -1, 0, False, False)], columns=["path", "entry", "size", "packed", "encrypted", "link"])
                    continue
                yield pd.DataFrame([(p, i.filename, i.file_size, i.compress_size, bool(i.flag_bits & 1), (i.external_attr >> 16) & 0o170000 == 0o120000) for i in infos], columns=["path", "entry", "size", "packed", "encrypted", "link"])

    rows = files.mapInPandas(entries, "path string, entry string, size long, packed long, encrypted boolean, link boolean")
    total = rows.groupBy("path").agg(F.sum("size").alias("total"), F.count("*").alias("n"))
    code = F.when(F.col("size") < 0, "unreadable").when(F.col("entry").rlike(r"(^|/)\.\.(/|$)|^/|^[A-Za-z]:|\\"), "path").when(F.col("link"), "symlink").when(F.col("encrypted"), "encrypted").when(F.col("size") > ratio * F.greatest("packed", F.lit(1)), "ratio").when(F.col("total") > size, "size").when(F.col("n") > most, "count")
    return rows.join(total, "path").select("path", "entry", code.alias("code")).where("code is not null")
