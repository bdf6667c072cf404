"""Matching brackets and conditional expressions of script code: one pass with a stack over the tokens of a file.

A stack is what column expressions cannot hold, so this is the one step of the scan that runs in Python, in Arrow batches.
Its time follows the length of the file: every token is pushed or popped once.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, functions as F

NESTED = (
    "struct<parens:array<struct<line:int,col:int,start:int,end:int,line_end:int,parts:int,head:string>>,"
    "conditional:array<struct<start:int,end:int>>>"
)
_ARROW = pa.struct([
    ("parens", pa.list_(pa.struct([
        ("line", pa.int32()), ("col", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("line_end", pa.int32()), ("parts", pa.int32()),
        ("head", pa.string())]))),
    ("conditional", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])
_TOKEN = re.compile(r"[()\[\]{};,:<>]|\?\??|=>|[=!]=+|=|\b(?:const|let|var|return|throw|if|for|while|switch|try)\b")
_CLOSES = {")": "(", "]": "[", "}": "{"}
_VISIBLE = re.compile(r"\S")


class _Level:
    """What is open at one depth: its bracket, its parts so far, and the expression that began last in it."""

    __slots__ = ("bracket", "at", "part", "parts", "flat", "angle", "begin", "asked", "conditional")

    def __init__(self, bracket: str, at: int):
        self.bracket, self.at, self.part, self.parts, self.flat, self.angle = bracket, at, at + 1, 0, 0, 0
        self.begin, self.asked, self.conditional = at + 1, 0, None


def _head(code: str, at: int) -> str:
    """The name called by the parenthesis at ``at``, with a leading dot for a member; type arguments are passed over."""
    end = at
    while end and code[end - 1] in " \t":
        end -= 1
    if end and code[end - 1] == ">":
        depth, low = 0, max(0, end - 500)
        while end > low:
            end -= 1
            depth += (code[end] == ">") - (code[end] == "<")
            if not depth:
                break
    begin, low = end, max(0, end - 200)
    while begin > low and (code[begin - 1].isalnum() or code[begin - 1] in "_$."):
        begin -= 1
    name = code[begin:end]
    return "." + name.rpartition(".")[2] if "." in name else name


def nested(code: str) -> tuple[list[tuple], list[tuple[int, int]]]:
    """(parentheses by position, merged spans of conditional expressions) of blanked code; offsets in code points.

    A parenthesis is (line, column, start, end, last line, parts, head): its end is the closing one, its parts are what commas
    of its own level separate, those between angle brackets of types left alone. A span of a conditional reaches from the start of
    its expression to the end of its last branch. Brackets that do not match are passed over.
    """
    lines = [0, *(m.end() for m in re.finditer("\n", code))]
    parens, spans, stack = [], [], [_Level("", -1)]

    def ended(level: _Level, at: int) -> None:
        if level.conditional is not None:
            spans.append((level.conditional, at))
            level.conditional = None
        level.begin, level.asked = at + 1, 0

    def part(level: _Level, at: int) -> None:
        if _VISIBLE.search(code, level.part, at):
            level.flat += 1
            if not level.angle:
                level.parts += 1

    for m in _TOKEN.finditer(code):
        token, at, level = m[0], m.start(), stack[-1]
        if token in "([{":
            stack.append(_Level(token, at))
        elif token in _CLOSES:
            if level.bracket != _CLOSES[token] and not any(x.bracket == _CLOSES[token] for x in reversed(stack[-8:])):
                continue
            while stack[-1].bracket != _CLOSES[token]:
                ended(stack.pop(), at)
            level = stack.pop()
            ended(level, at)
            if token == ")":
                angle, level.angle = level.angle, 0
                part(level, at)
                line = bisect_right(lines, level.at) - 1
                parens.append((line, level.at - lines[line], level.at, at, bisect_right(lines, at) - 1,
                               level.flat if angle else level.parts, _head(code, level.at)))
            elif token == "}" and not stack[-1].asked:
                ended(stack[-1], at)
        elif token == ",":
            part(level, at)
            level.part = at + 1
            if not level.asked:
                ended(level, at)
        elif token == "?":
            follows = _VISIBLE.search(code, at + 1)
            if not follows or follows[0] not in ".:),;=" or follows[0] == "." and code[at + 2 : at + 3].isdigit():
                level.asked += 1
                if level.conditional is None:
                    level.conditional = level.begin
        elif token == ":":
            if level.asked:
                level.asked -= 1
            else:
                ended(level, at)
        elif token == "<":
            if at and (code[at - 1].isalnum() or code[at - 1] in "_$") and code[at + 1 : at + 2].strip(" ="):
                level.angle += 1
        elif token == ">":
            level.angle = max(0, level.angle - 1)
        elif token == ";" or token in ("=", "=>") and not level.asked or token[0].isalpha() and not level.asked:
            ended(level, m.end() - 1)
    for level in stack:
        ended(level, len(code))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    return sorted(parens), merged


def _nested_of(code: pa.Array) -> pa.Array:
    found = [nested(text or "") for text in code.to_pylist()]
    lists = []
    for field, values in zip(_ARROW, zip(*found) if found else ((), ())):
        ends = [0, *accumulate(len(v) for v in values)]
        item = field.type.value_type
        columns = list(zip(*chain.from_iterable(values))) or [()] * item.num_fields
        rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, item)], fields=list(item))
        lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, type=field.type))
    return pa.StructArray.from_arrays(lists, fields=list(_ARROW))


def nested_spans(code: Column) -> Column:
    """:func:`nested` of a column of blanked code."""
    return F.arrow_udf(_nested_of, NESTED)(code)
