"""A plug-in for token-classification models: chunks of text in, labelled pieces out.

A model is given as a factory, called once a partition on the worker, of a function from a text of at most CHUNK characters to
pieces (start, end, label, score). No model is part of this repository; asking for one without a factory is an error."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from ..sources.files import BackendUnavailable

Model = Callable[[str], list[tuple[int, int, str, float]]]
CHUNK, MIN_SCORE = 1200, 0.6
# fixed values: numbered labels, and parts of named ones
NUMBERED = {1: "OSOBA", 2: "OSOBA", 3: "ORGANIZACIA", 4: "ORGANIZACIA", 5: "LOKALITA", 6: "LOKALITA"}
NAMED = (("PER", "OSOBA"), ("OSOB", "OSOBA"), ("ORG", "ORGANIZACIA"), ("LOC", "LOKALITA"), ("LOK", "LOKALITA"), ("GPE", "LOKALITA"))


def entity_of(label: str) -> str | None:
    bare = re.sub("^[BIES]-", "", label.upper())
    if number := re.fullmatch(r"LABEL_(\d+)", bare):
        return NUMBERED.get(int(number[1]))
    return next((entity for part, entity in NAMED if part in bare), None)


def chunks(text: str, size: int = CHUNK) -> Iterator[tuple[int, str]]:
    """(offset, chunk): cut after the last line end, else after the last space, else at the size."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            end = max(text.rfind("\n", at + 1, end), -1) + 1 or max(text.rfind(" ", at + 1, end), -1) + 1 or end
        yield at, text[at:end]
        at = min(end, len(text))


def model_spans(text: str, model: Model, min_score: float = MIN_SCORE) -> list[tuple[int, int, str, float]]:
    """(start, end, entity, score): pieces of one type with only spaces or hyphens between them are one, its score the mean of what came before and the next."""
    found = sorted((at + a, at + b, entity, score) for at, part in chunks(text) for a, b, label, score in model(part) if score >= min_score and (entity := entity_of(label)))
    out: list[tuple[int, int, str, float]] = []
    for a, b, entity, score in found:
        if out and out[-1][2] == entity and not text[out[-1][1] : a].strip(" -"):
            x, _, _, s = out.pop()
            a, score = x, (s + score) / 2
        out.append((a, b, entity, score))
    return [(a, b, e, round(s, 3)) for a, b, e, s in out]


def required(engine: str, factory: Callable[[], Model] | None) -> bool:
    """Whether models are to be run: engines are rules and rules+ner; auto is rules, with a model if one is given."""
    if engine not in ("rules", "rules+ner", "auto"):
        raise BackendUnavailable(f"engine {engine!r} is not part of this repository")
    if engine == "rules+ner" and factory is None:
        raise BackendUnavailable("engine 'rules+ner' needs a model")
    return factory is not None and engine != "rules"
