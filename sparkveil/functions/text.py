"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java classes that hold the same characters as Python's letters, word characters and digits.
LETTER, WORD, DIGIT = r"[\p{L}\p{Nl}\p{No}]", r"[\p{L}\p{N}_]", r"\p{Nd}"


@cache
def fold_tables() -> tuple[str, str]:
    """Characters outside Hangul and the supplementary planes whose decomposition begins with another one, and those."""
    pairs = [(c, d[0]) for c in map(chr, range(0x80, 0xFB50)) if not "가" <= c <= "힣" and not "\ud800" <= c <= "\udfff" and (d := unicodedata.normalize("NFD", c))[0] != c]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def fold_py(text: str) -> str:
    return text.translate(_fold_map())


@cache
def _fold_map() -> dict[int, str]:
    return {ord(a): b for a, b in zip(*fold_tables(), strict=True)}


def fold(c: Column) -> Column:
    """Each character without its marks; the length stays. Combining marks of their own are kept."""
    return F.translate(c, *fold_tables())


def norm_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(fold(c)), r"[^\p{L}\p{N}]", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{Nd}]", "")


# fixed values: endings of inflected surnames, in the order they are tried, and stems that lose a vowel
FEMALE_ENDINGS = ("ovej", "ovou", "ovu", "ova")
ENDINGS = ("ovia", "ovi", "eho", "emu", "ymi", "om", "ou", "ej", "ym", "a", "e", "u", "y", "i", "o")
VOWEL_STEMS = {"petr": "peter", "pavl": "pavol", "karl": "karol", "mark": "marek"}


def name_stem(c: Column) -> Column:
    """Stem of a name in any case. Women's forms keep a mark of their own, so that Nováková is not Novák.

    An ending needs two letters before it if a woman's, else three. The leftmost ending that has them is the longest, and
    the endings are listed longest first, so that one replacement does what trying them in order does."""
    w = F.regexp_replace(F.lower(fold(c)), r"^[.,]+|[.,]+\z", "")
    woman = F.regexp_replace(w, rf"(?<=..)(?:{'|'.join(FEMALE_ENDINGS)})\z", "~f")
    short = F.regexp_replace(w, rf"(?<=...)(?:{'|'.join(ENDINGS)})\z", "")
    for stem, full in VOWEL_STEMS.items():
        short = F.when(short == stem, full).otherwise(short)
    return F.when(woman != w, woman).otherwise(short)


# fixed value: titles and forms of address that are no part of a name
TITLES = "Ing|arch|Mgr|art|Bc|JUDr|MUDr|MDDr|MVDr|PhDr|RNDr|PaedDr|PharmDr|ThDr|ICDr|doc|prof|Dr|PhD|CSc|DrSc|MBA|LL|M|ArtD|MPH|DiS|pan|pani|p"


def name_tokens(c: Column) -> Column:
    """Words of a name that begin with a capital and are longer than a letter, without titles."""
    runs = F.regexp_extract_all(fold(c), F.lit(rf"{LETTER}+(?:\.)?"), 0)
    kept = F.filter(runs, lambda t: ~t.rlike(rf"^(?i:{TITLES})\.?$") & (F.length(t) > 1) & t.rlike(r"^\p{Lu}"))
    return F.transform(kept, lambda t: F.regexp_replace(t, r"\.$", ""))


def surname_stems(c: Column) -> Column:
    """Stems of the words after the first, or of the only one, of three letters at least."""
    tokens = name_tokens(c)
    last = F.when(F.size(tokens) > 1, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(1)))).otherwise(tokens)
    return F.array_distinct(F.transform(F.filter(last, lambda t: F.length(t) >= 3), name_stem))
