"""Material of sections under a budget: numbered sources in order until the characters are used up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import stripped

#: A material's first lines, a source's head line, and what marks a cut and what was left out: fixed values.
INTRO = "案例：%s\n\n章节：%s\n\n请基于以下原始素材采集销售证据。\n\n引用定位要求：素材正文带 L 行号，source_refs.locator 必须填写 line_start/line_end。"
HEAD = "===== 来源：%s ｜ 文件：%s ｜ source_id：%s ====="
CUT, LEFT_OUT = "\n[内容已截断]", "[后续素材因上下文长度限制省略]\n[内容已截断]"
MAX_CHARS = 18_000
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def numbered(c: Column) -> Column:
    """Each line behind L and its number, of three digits at least; a line end at the end of the text begins no line."""
    lines = F.split(F.regexp_replace(c, rf"(?:{LINE_END})\z", ""), LINE_END)
    out = F.transform(lines, lambda line, i: F.concat(F.lit("L"), F.lpad((i + 1).cast("string"), F.greatest(F.lit(3), F.length((i + 1).cast("string"))), F.lit("0")), F.lit(": "), line))
    return F.when(c == "", "").otherwise(F.array_join(out, "\n"))


def section_blocks(sources: DataFrame, section: list[str], order: list[str], max_chars: int = MAX_CHARS) -> DataFrame:
    """(section columns, pos, block, state) of sources (section columns; order columns; case_name, section_name, source_type, filename, source_id, text).

    A section's blocks are those of its sources that the budget holds whole, in order; the source at the edge is cut and marked; one block tells that more
    was left out. state is whole, cut or left_out. Null and blank texts are no sources; ties of order go by source_id. White space that the cut takes off
    the end of a text is not given to the sources behind it. A section can hold a third of all sources: only so many of its first as the budget has room
    for head lines of are shuffled and sorted with texts, by a limit of ranks on the map side, and of texts no more than the budget.
    """
    head = F.format_string(HEAD, "source_type", "filename", "source_id")
    first, before = Window.partitionBy(*section).orderBy(*order, "source_id"), Window.partitionBy(*section).orderBy("place_").rowsBetween(Window.unboundedPreceding, -1)
    room = max_chars // (len(HEAD) - 6 + 3) + 2
    rows = sources.where(F.length(stripped(F.col("text"))) > 0).select(*section, *order, "source_id", F.length(F.format_string(INTRO, "case_name", "section_name")).alias("intro_"), head.alias("head_"), F.left("text", F.lit(max_chars + 1)).alias("text_"))
    rows = rows.withColumn("place_", F.row_number().over(first)).where(F.col("place_") <= room).withColumn("text_", numbered(F.col("text_")))
    used = F.col("intro_") + F.coalesce(F.sum(F.length("head_") + F.length("text_") + 3).over(before), F.lit(0))
    rows = rows.withColumn("left_", max_chars - used - F.length("head_") - 4)
    whole = (F.col("left_") > len(CUT)) & (F.length("text_") <= F.col("left_"))
    rows = rows.withColumn("whole_", whole).withColumn("edge_", F.coalesce(F.count_if(~F.col("whole_")).over(before), F.lit(0)))
    # the first source that isn't whole is cut, if there is room for a mark; the next tells, or this one itself
    cut = (F.col("left_") > len(CUT)) & (F.col("edge_") == 0)
    rows = rows.withColumn("cut_", ~F.col("whole_") & cut).withColumn("cuts_", F.coalesce(F.count_if("cut_").over(before), F.lit(0)))
    state = F.when((F.col("edge_") == 0) & F.col("whole_"), "whole").when(F.col("cut_"), "cut").when((F.col("edge_") == F.col("cuts_")), "left_out")
    short = F.concat(F.regexp_replace(F.left("text_", (F.col("left_") - len(CUT)).cast("int")), r"(?U)\s++\z", ""), F.lit(CUT))
    block = F.when(F.col("state") == "left_out", LEFT_OUT).otherwise(F.concat_ws("\n", "head_", F.when(F.col("state") == "cut", short).otherwise(F.col("text_"))))
    return rows.withColumn("state", state).where("state IS NOT NULL").select(*section, F.col("place_").alias("pos"), block.alias("block"), "state")


def section_materials(sources: DataFrame, section: list[str], order: list[str], max_chars: int = MAX_CHARS) -> DataFrame:
    """(section columns, material): each section's intro and blocks, which are no longer than the budget together (but for the line that tells what was left out)."""
    intro = sources.groupBy(*section).agg(F.min(F.format_string(INTRO, "case_name", "section_name")).alias("intro_"))
    blocks = section_blocks(sources, section, order, max_chars).groupBy(*section).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda b: b["block"]).alias("blocks_"))
    return intro.join(blocks, section, "left").select(*section, F.concat_ws("\n\n", "intro_", "blocks_").alias("material"))
