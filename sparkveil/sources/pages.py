"""Pages of words with places: lines, text, boxes, and OCR words that the text layer lacks. Words come from a plug-in."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A plug-in: pages of a file as rows (page, word, x0, top, x1, bottom, kind), kind being text or ocr.
WordExtractor = Callable[[bytes], Iterable[tuple[int, str, float, float, float, float, str]]]


def with_lines(words: DataFrame) -> DataFrame:
    """words (page, word, x0, top, x1, bottom) with `line` and `pos`: in order of rounded top and x0, a word that lies more than half of the greatest
    height so far below the first word of its line begins a new one. A page's words are folded together, no more."""
    row = F.struct(F.round("top").alias("r"), "x0", "top", "x1", "bottom", "word")
    pages = words.groupBy("page").agg(F.array_sort(F.collect_list(row)).alias("ws"))  # of one page
    tall = "greatest(acc.h, w.bottom - w.top)"
    new = f"(size(acc.out) > 0 AND w.top - acc.top > 0.5D * {tall})"
    line = f"CASE WHEN {new} THEN acc.line + 1 ELSE acc.line END"
    step = f"named_struct('h', CASE WHEN {new} THEN w.bottom - w.top ELSE {tall} END, 'top', CASE WHEN {new} OR size(acc.out) = 0 THEN w.top ELSE acc.top END, 'line', {line}, 'out', array_append(acc.out, named_struct('word', w.word, 'x0', w.x0, 'top', w.top, 'x1', w.x1, 'bottom', w.bottom, 'line', {line})))"
    start = "named_struct('h', 0D, 'top', 0D, 'line', 0, 'out', cast(array() AS array<struct<word:string,x0:double,top:double,x1:double,bottom:double,line:int>>))"
    out = pages.select("page", F.expr(f"aggregate(ws, {start}, (acc, w) -> {step}, acc -> acc.out)").alias("ws"))
    return out.select("page", F.posexplode("ws").alias("pos", "w")).select("page", "pos", "w.*")


def page_text(lined: DataFrame) -> DataFrame:
    """page, text: words of a line by spaces, lines by line ends."""
    lines = lined.groupBy("page", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]), " ").alias("t"))
    return lines.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n").alias("text"))


def boxes(hits: DataFrame, pad: float = 1.5) -> DataFrame:
    """A box a line around hit words (page, line, x0, top, x1, bottom)."""
    return hits.groupBy("page", "line").agg((F.min("x0") - pad).alias("x0"), (F.min("top") - pad).alias("top"), (F.max("x1") + pad).alias("x1"), (F.max("bottom") + pad).alias("bottom"))


def extra_ocr_words(words: DataFrame) -> DataFrame:
    """OCR words that no word of the page's text layer intersects. An equality on the page keeps the comparison within it."""
    o, t = words.where("kind = 'ocr'").alias("o"), words.where("kind = 'text'").alias("t")
    meets = (F.col("o.page") == F.col("t.page")) & (F.col("o.x0") < F.col("t.x1")) & (F.col("t.x0") < F.col("o.x1")) & (F.col("o.top") < F.col("t.bottom")) & (F.col("t.top") < F.col("o.bottom"))
    return o.join(t, meets, "left_anti").select("o.*")


def needs_ocr(mode: str, chars: int, image_share: float) -> bool:
    """always, never, or auto: little text or images over a fifth of the page."""
    return mode == "always" or mode == "auto" and (chars < 20 or image_share > 0.2)


def ocr_languages(wanted: str, available: list[str]) -> str:
    return "+".join(x for x in wanted.split("+") if x in available) or "eng"
