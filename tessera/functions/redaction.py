"""Texts without personal data and secrets, and messages without stacks and paths.

Both read a text once from left to right, by its at signs, digit groups, separators and slashes, so work follows the length of whatever
comes; they run as pandas functions on Arrow batches, as regular expressions for nested forms either recurse or go back in Java.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What stands for what redaction takes out: fixed values.
HIDDEN_SECRET, HIDDEN_EMAIL, HIDDEN_PHONE, HIDDEN_IDENTITY = "【API密钥已隐藏】", "【邮箱已隐藏】", "【手机号已隐藏】", "【身份证号已隐藏】"
STACK_HIDDEN, SECRET_HIDDEN, PATH_HIDDEN, MOST_MESSAGE = "内部处理信息已隐藏", "[已隐藏敏感信息]", "[已隐藏路径]", 2000

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HOST = frozenset(_LETTERS + "0123456789.-")
_LOCAL = _HOST | frozenset("_%+")
_DIGITS = re.compile(r"\d+")


def _replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with (start, end, what stands there) spans, which are in order and apart."""
    if not spans:
        return text
    out, last = [], 0
    for start, end, name in spans:
        out += [text[last:start], name]
        last = end
    return "".join([*out, text[last:]])


def _mails(text: str) -> list[tuple[int, int, str]]:
    spans, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        while end < len(text) and text[end] in _HOST:
            end += 1
        # the last label that begins with two letters, behind something
        dot = text.rfind(".", at + 2, end)
        while dot > 0 and not (len(label := text[dot + 1 : dot + 3]) == 2 and dot + 3 <= end and label[0] in _LETTERS and label[1] in _LETTERS):
            dot = text.rfind(".", at + 2, dot)
        if start < at and dot > 0:
            end = dot + 3
            while end < len(text) and text[end] in _LETTERS:
                end += 1
            spans.append((start, end, HIDDEN_EMAIL))
            last = end
        else:
            last = at + 1
        at = text.find("@", max(last, at + 1))
    return spans


def _is_gap(text: str) -> bool:
    return all(c == "-" or c.isspace() for c in text)


#: A mobile number has so many digits, perhaps behind the country's code.
MOBILE, CODES = 11, ("0086", "86", "")


def _phones(text: str) -> list[tuple[int, int, str]]:
    groups, spans, i = [m.span() for m in _DIGITS.finditer(text)], [], 0
    while i < len(groups):
        start, end = groups[i]
        for code in CODES:
            # a code is written as one; what follows it may be a group of its own
            if not text.startswith(code, start, end):
                continue
            j, digits = i, text[start + len(code) : end]
            while len(digits) < MOBILE and j + 1 < len(groups) and _is_gap(text[groups[j][1] : groups[j + 1][0]]):
                j += 1
                digits += text[slice(*groups[j])]
            if len(digits) == MOBILE and digits[0] == "1" and digits[1] in "3456789":
                spans.append((start - (code == "86" and text[start - 1 : start] == "+"), groups[j][1], HIDDEN_PHONE))
                i = j
                break
        i += 1
    return spans


def _identities(text: str) -> list[tuple[int, int, str]]:
    """Numbers of 18 digits, or of 17 and an X with no digit behind."""
    spans = []
    for m in _DIGITS.finditer(text):
        start, end = m.span()
        if end - start == 17 and text[end : end + 1] in ("X", "x") and not text[end + 1 : end + 2].isdecimal():
            spans.append((start, end + 1, HIDDEN_IDENTITY))
        elif end - start == 18:
            spans.append((start, end, HIDDEN_IDENTITY))
    return spans


def hidden(text: str, secret: str = "") -> str:
    text = text.replace(secret, HIDDEN_SECRET) if secret else text
    for found in (_mails, _phones, _identities):
        text = _replaced(text, found(text))
    return text


def redacted(c: Column, secret: str = "") -> Column:
    """c without a known secret, mail addresses, mobile and identity numbers, in this order."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hidden(x, secret))

    return run(c)


_KEY, _WORD = frozenset(_LETTERS + "0123456789._-"), frozenset(_LETTERS + "0123456789_")
_STOPS = frozenset(" \t\n\r\x0b\x0c,;，；。")
#: Names whose values are secret, and phrases that tell a stack: fixed values.
SECRET_NAMES, STACK_PHRASES = ["token", "secret", "password"], ["during handling of the above exception", "the above exception was the direct cause"]
_STACK_WORDS = re.compile(r"\b(?:traceback|stack\s*trace|exception\s*chain)\b")


def _shows_stack(text: str) -> bool:
    low = text.lower()
    if any(p in low for p in STACK_PHRASES) or _STACK_WORDS.search(low):
        return True
    place, closing = 0, low.rfind(")")
    for line in low.split("\n"):
        head = line.split(None, 1)
        if len(head) == 2 and head[0] == "at":
            call = head[1].split(None, 1)[0]
            opening = call.find("(", 1)
            if opening > 0 and place + line.index(call, line.index("at") + 2) + opening < closing:
                return True
        if len(head) == 2 and head[0] == "file" and head[1][0] in "\"'":
            parts = head[1].split(",")[1:]
            if any(len(p := part.split()) > 1 and p[0] == "line" and p[1][0].isdecimal() for part in parts):
                return True
        place += len(line) + 1
    return False


def _is_secret(name: str) -> bool:
    """Whether a key ends in a secret's name as a word of its own; what joins words is a hyphen or an underscore."""
    words = re.split(r"([_-])", name.lower())
    first = len(words) - 1
    while first >= 2 and words[first - 2]:
        first -= 2
    if first and words[first - 1] == "_":  # an underscore with nothing before it makes another name
        return False
    word = words[-1].rpartition(".")[2]
    if word == "key":
        return len(words) > 2 and words[-3].rpartition(".")[2] == "api"
    return word in SECRET_NAMES or (word == "bearer" and (len(words) == 1 or words[-2] == "-"))


def _value_end(text: str, at: int) -> int:
    """Where a value ends that may be in quotes; at, if there is none."""
    if text[at : at + 1] in ('"', "'") and (close := text.find(text[at], at + 1)) >= 0:
        return close + 1
    while at < len(text) and not (text[at] in _STOPS or text[at].isspace()):
        at += 1
    return at


def _assignments(text: str) -> list[tuple[int, int, str]]:
    spans, last = [], 0
    for m in re.finditer("[:=]", text):
        at = end = m.start()
        if at < last:
            continue
        while end > last and text[end - 1].isspace():
            end -= 1
        end -= end > last and text[end - 1] in "\"'"
        start = end
        while start > last and text[start - 1] in _KEY:
            start -= 1
        name = text[start:end]
        if not name or not _is_secret(name):
            continue
        value = at + 1
        while value < len(text) and text[value].isspace():
            value += 1
        stop = _value_end(text, value)
        if stop > value:
            # dots at the front, or joints, are not of the name
            name = name[len(name) - len(name.lstrip("-_")) :] if name[0] in "-_" else name
            start = end - len(name)
            start -= start > last and text[start - 1] in "\"'"
            spans.append((start, stop, f"{name}={SECRET_HIDDEN}"))
            last = stop
    return spans


def _bearers(text: str) -> list[tuple[int, int, str]]:
    spans = []
    for m in re.finditer(r"\bbearer\s+", text, re.IGNORECASE):
        end = m.end()
        while end < len(text) and not (text[end] in _STOPS or text[end].isspace()):
            end += 1
        if end > m.end() and (not spans or m.start() >= spans[-1][1]):
            spans.append((m.start(), end, f"Bearer {SECRET_HIDDEN}"))
    return spans


def _path_end(text: str, at: int, limit: int, joints: str, stops: str) -> tuple[int, int]:
    """The end of a path whose first part begins at at: parts between joints, the last up to a stop; at, if there is none. And how far
    was read: from the end up to there no part can end a path."""
    end = begin = at
    while begin < limit and text[begin] not in joints:
        stop = begin
        while stop < limit and text[stop] not in joints and text[stop] not in stops:
            stop += 1
        end = stop if stop > begin else end
        while stop < limit and text[stop] not in joints:
            stop += 1
        if stop == limit:
            break
        begin = stop + 1
    return end, begin


def _paths(text: str) -> list[tuple[int, int, str]]:
    """Absolute paths: of shares (two backslashes, host, joint), of drives (letter, colon, joint) and of roots."""
    spans = []
    for m in re.finditer(r"\S+", text):
        if "/" not in m[0] and "\\" not in m[0]:
            continue
        at, limit, last = m.start(), m.end(), m.start()
        read = {"drive": 0, "root": 0}  # no path of this kind begins before
        while at < limit:
            c, end, first = text[at], at, at
            if c == "\\" and text.startswith("\\\\", at):
                host = at + 2
                while host < limit and text[host] not in "\\/":
                    host += 1
                if at + 2 < host < limit:
                    first = host + 1
                    end, _ = _path_end(text, first, limit, "\\/", ",;，；。)]}")
            elif at >= read["drive"] and c in _LETTERS and text[at + 1 : at + 2] == ":" and text[at + 2 : at + 3] in ("\\", "/") and not (at and text[at - 1] in _WORD):
                first = at + 3
                end, read["drive"] = _path_end(text, first, limit, "\\/", ",;)]}")
            elif at >= max(last, read["root"]) and c == "/" and text[at + 1 : at + 2] != "/" and not (at and text[at - 1] in ":/"):
                first = at + 1
                end, read["root"] = _path_end(text, first, limit, "/", ",;)]}")
            if end > first:
                spans.append((at, end, PATH_HIDDEN))
                at = last = end
            else:
                at += 1
    return spans


def safe(text: str) -> str:
    if _shows_stack(text):
        return STACK_HIDDEN
    for found in (_assignments, _bearers, _paths):
        text = _replaced(text, found(text))
    return text[:MOST_MESSAGE]


@F.pandas_udf(StringType())
def _safe(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else safe(x))


def safe_message(c: Column) -> Column:
    """A message that may be stored: none that shows a stack; no secrets and paths; MOST_MESSAGE characters at most."""
    return _safe(c)
