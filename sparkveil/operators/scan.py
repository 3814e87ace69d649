"""Pattern matching over units of text.

The only step outside Catalyst: Spark has no function for the positions of matches, and Java's patterns differ in their character classes and overflow the
stack on long repeats. It returns candidates only; checks, context, scores and everything after are Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import patterns
from ..functions.text import fold, fold_py
from .ner import Model, model_spans, required

CANDIDATE = "struct<start:int,end:int,rule:int,value:string,near:string,tail:string>"
CAPITALISED = "struct<start:int,end:int,word:string>"
TAIL = 120
_CAP = re.compile(rf"{patterns.BEFORE}[A-Z]{patterns.LET}+{patterns.AFTER}")
_CANDIDATES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("rule", pa.int32()), ("value", pa.string()), ("near", pa.string()), ("tail", pa.string())]))
MODELLED = "struct<start:int,end:int,entity:string,score:double,source:string>"
_MODELLED = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity", pa.string()), ("score", pa.float64()), ("source", pa.string())]))
_WORDS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("word", pa.string())]))


def active_rules(cfg: Config) -> list[int]:
    """Rules that can give an entity that is asked for; those that may turn a person into an organisation serve both."""
    return [i for i, r in enumerate(patterns.rules()) if r.entity in cfg.entities or (r.company and "ORGANIZACIA" in cfg.entities)]


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    kept = text[a:b].rstrip(" \t,;:")
    return a + len(kept) - len(kept.lstrip(" \t")), a + len(kept)


def scan(units: DataFrame, cfg: Config, model: Callable[[], Model] | None = None) -> DataFrame:
    """units (any columns, with text) with `folded`, `candidates`, `words` and `modelled`: matches of the rules that cfg needs and of its deny list (rule -1 - i),
    capitalised words that are not all capitals, if names are to be propagated, and spans of the model, if there is one."""
    asked = required(cfg.engine, model)
    wanted = active_rules(cfg)
    deny = [rf"{patterns.BEFORE}{re.escape(fold_py(t))}{patterns.AFTER}" for t, _ in cfg.deny_list]
    names = cfg.propagate_names and "OSOBA" in cfg.entities

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = patterns.rules()
        jobs = [(i, patterns.compiled(all_[i].name), all_[i], re.compile(all_[i].guard) if all_[i].guard else None) for i in wanted]
        denied = [re.compile(p, re.I) for p in deny]
        label = model() if asked else None
        for b in batches:
            candidates, words, modelled = [], [], []
            for cell, plain in zip(b.column("folded"), b.column("text"), strict=True):
                text = cell.as_py() or ""
                found: list[dict] = []
                if text.strip():
                    low = text.lower()
                    for i, pattern, rule, guard in jobs:
                        if guard and not guard.search(text):
                            continue
                        group = "v" if "v" in pattern.groupindex else 0
                        for m in pattern.finditer(text):
                            a, e = _trim(text, *m.span(group))
                            if a < e:
                                near = f"{low[max(0, a - rule.window) : a]} {low[e : e + 15]}" if rule.context else ""
                                found.append({"start": a, "end": e, "rule": i, "value": text[a:e], "near": near, "tail": text[e : e + TAIL] if rule.company else ""})
                    for i, pattern in enumerate(denied):
                        found += [{"start": m.start(), "end": m.end(), "rule": -1 - i, "value": m.group(), "near": "", "tail": ""} for m in pattern.finditer(text)]
                candidates.append(found)
                modelled.append([{"start": a, "end": e, "entity": kind, "score": score, "source": "ner"} for a, e, kind, score in model_spans(plain.as_py(), label)] if label and text.strip() else [])
                words.append([{"start": m.start(), "end": m.end(), "word": m.group()} for m in _CAP.finditer(text) if not m.group().isupper()] if names else [])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(candidates, _CANDIDATES), pa.array(words, _WORDS), pa.array(modelled, _MODELLED)], [*b.schema.names, "candidates", "words", "modelled"])

    folded = units.withColumn("folded", fold(F.coalesce("text", F.lit(""))))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in folded.schema), f"candidates array<{CANDIDATE}>", f"words array<{CAPITALISED}>", f"modelled array<{MODELLED}>"])
    return folded.mapInArrow(run, schema)
