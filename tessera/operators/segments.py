"""The text of evidence read back into its fields, lists and plain lines."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labels whose values are the source's own words, and labels whose values are a model's: fixed values.
SOURCE_LABELS = ["来源原文", "原始话术"]
GENERATED_LABELS = ["案例", "知识类型", "标签", "阶段", "客户状态", "销售目标", "关键动作", "策略名称", "别名", "定义", "适用阶段", "步骤", "建议做法", "避免做法", "置信度", "模型归纳", "摘要", "关键要点", "话术 ID", "场景", "客户触发点", "目标", "教练推荐话术", "关联策略", "追问建议", "合规提醒", "客户异议", "异议诊断", "推荐回应", "关联话术"]
COLON, BULLET = "：", "- "
SEGMENT = "pos int, kind string, label string, origin string, value string, items array<string>"
#: White space that a browser's trim takes away.
BLANK = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


class Segments:
    """A table function: the segments of a text, a row each, in order. A field is ``label：value``; a label without value opens a block,
    whose items are ``- item`` lines and the lines that follow one; a line that is neither closes the block and is plain. A block without items stays one. Blank lines
    don't count. A null or blank text has no segments. One pass over the lines, which holds one segment at a time."""

    def __init__(self) -> None:
        self.origins = dict.fromkeys(GENERATED_LABELS, "generated") | dict.fromkeys(SOURCE_LABELS, "source")

    def eval(self, text: str | None) -> Iterator[tuple]:
        pos, block = 0, None
        for line in (text or "").split("\n"):
            line = line.strip(BLANK)
            if not line:
                continue
            label, colon, value = line.partition(COLON)
            origin = self.origins.get(label) if colon else None
            if block and line.startswith(BULLET):
                block[1].append([line[len(BULLET) :]])
                continue
            if block and not origin and block[1]:
                block[1][-1].append(line)
                continue
            if block:
                yield self.closed(block)
                block = None
            pos += 1
            if origin and not value:
                block = (pos, [], label, origin)
            else:
                yield (pos, "field", label, origin, value, None) if origin else (pos, "plain", None, None, line, None)
        if block:
            yield self.closed(block)

    @staticmethod
    def closed(block: tuple) -> tuple:
        pos, items, label, origin = block
        return pos, "block", label, origin, None, ["\n".join(lines) for lines in items]


def segments(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, kind, label, origin, value, items) of all segments of texts (key, text)."""
    split = F.udtf(Segments, returnType=SEGMENT)
    return texts.select(F.col(key), F.col(text).alias("text_")).lateralJoin(split(F.col("text_").outer())).select(key, *(c.split()[0] for c in SEGMENT.split(", ")))


def structured(rows: DataFrame, key: str) -> DataFrame:
    """(key, structured): whether a text of segments() rows has any field or block."""
    return rows.groupBy(key).agg(F.bool_or(F.col("kind") != "plain").alias("structured"))
