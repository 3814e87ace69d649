"""Interval operators over arrays of spans: union within a type, greedy choice among types, both without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,entity:string,score:double,source:string>"
_KEYED = "struct<entity:string,start:int,i:int,end:int,score:double,source:string>"


def merged(spans: str) -> str:
    """SQL: spans of one type that overlap become one, from the first start to the last end, with the best score and all sources; touching ones do not."""
    rows = f"array_sort(transform({spans}, (x, i) -> named_struct('entity', x.entity, 'start', x.start, 'i', i, 'end', x.end, 'score', x.score, 'source', x.source)))"
    last = "try_element_at(acc, -1)"
    source = f"CASE WHEN array_contains(split({last}.source, '[+]'), x.source) THEN {last}.source ELSE concat({last}.source, '+', x.source) END"
    joined = f"named_struct('entity', x.entity, 'start', {last}.start, 'i', {last}.i, 'end', greatest({last}.end, x.end), 'score', greatest({last}.score, x.score), 'source', {source})"
    step = f"CASE WHEN {last}.entity = x.entity AND x.start < {last}.end THEN concat(slice(acc, 1, size(acc) - 1), array({joined})) ELSE array_append(acc, x) END"
    return f"aggregate({rows}, cast(array() AS array<{_KEYED}>), (acc, x) -> {step})"


def chosen(spans: str) -> str:
    """SQL: by score, then length, then start, each span that overlaps none chosen before it; returned by start."""
    rows = f"array_sort(transform({spans}, x -> named_struct('s', -x.score, 'l', x.start - x.end, 'start', x.start, 'end', x.end, 'entity', x.entity, 'score', x.score, 'source', x.source)))"
    kind = "struct<s:double,l:int,start:int,end:int,entity:string,score:double,source:string>"
    greedy = f"aggregate({rows}, cast(array() AS array<{kind}>), (acc, x) -> CASE WHEN exists(acc, c -> c.start < x.end AND x.start < c.end) THEN acc ELSE array_append(acc, x) END)"
    return f"array_sort(transform({greedy}, x -> named_struct('start', x.start, 'end', x.end, 'entity', x.entity, 'score', x.score, 'source', x.source)))"


def resolve(spans: str) -> Column:
    return F.expr(chosen(merged(spans)))
