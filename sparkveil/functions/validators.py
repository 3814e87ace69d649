"""Checksum and format checks as Column expressions: true, or false (null for null)."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DIGIT, LETTER, digits


def _n(d: Column, at: int, size: int) -> Column:
    """Digits from a position as a number; null beyond the end."""
    part = F.substring(d, at + 1, size)
    return F.when(F.length(part) == size, part.cast("long"))


def birth_number(c: Column, as_of_year: int | None = None) -> Column:
    """Nine digits (born before 1954) or ten that 11 divides, or that were given the check digit 0 for a remainder of 10; the
    month of a woman is 50 more, and from 2004 on that of anyone may be 20 more; the day is one of its month."""
    d = digits(c)
    size, yy, mm, dd = F.length(d), _n(d, 0, 2), _n(d, 2, 2), _n(d, 4, 2)
    year = F.when((size == 9) | (yy >= 54), 1900 + yy).otherwise(2000 + yy)
    late = year >= 2004
    month = F.when((mm > 70) & late, mm - 70).when(mm > 50, mm - 50).when((mm > 20) & late, mm - 20).otherwise(mm)
    nine = (size == 9) & (yy < 54)
    first, last = _n(d, 0, 9), _n(d, 9, 1)
    ten = (size == 10) & (year <= (as_of_year or datetime.date.today().year)) & ((F.try_mod(first * 10 + last, F.lit(11)) == 0) | ((first % 11 == 10) & (last == 0)))
    days = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)), 29).otherwise(28)).otherwise(31)
    return F.coalesce((nine | ten) & month.between(1, 12) & (dd >= 1) & (dd <= days), c.isNull() & F.lit(None))


def company_number(c: Column) -> Column:
    """Eight digits, the last from the weights 8 to 2."""
    d = digits(c)
    total = sum((_n(d, i, 1) * (8 - i) for i in range(7)), F.lit(0))
    return F.when(F.length(d) == 8, (11 - total % 11) % 10 == _n(d, 7, 1)).otherwise(c.isNull() & F.lit(None))


def tax_number(c: Column) -> Column:
    return digits(c).rlike("^[1-4][0-9]{9}$")


def vat_number(c: Column) -> Column:
    d = digits(c)
    return F.when(F.length(d) == 10, _n(d, 0, 10) % 11 == 0).otherwise(c.isNull() & F.lit(None))


def iban(c: Column) -> Column:
    """15 to 34 characters, 24 for SK; two letters and two digits first; with those moved to the end and letters as 10 to 35, 1 modulo 97."""
    s = F.upper(F.regexp_replace(c, r"\s", ""))
    form = s.rlike(r"^[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}$") & (~s.startswith("SK") | (F.length(s) == 24))
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    rest = F.aggregate(F.regexp_extract_all(turned, F.lit("."), 0), F.lit(0), lambda acc, x: F.when(x.rlike("[0-9]"), (acc * 10 + x.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(x) - 55) % 97))
    return F.when(form, rest == 1).otherwise(c.isNull() & F.lit(None))


def luhn(c: Column) -> Column:
    d = digits(c)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def ipv4(c: Column) -> Column:
    """Four parts up to 255 without leading zeros; neither a loopback address nor 0.0.0.0."""
    part = r"(?:0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
    s = F.trim(c)
    return s.rlike(rf"^{part}(?:\.{part}){{3}}$") & ~s.startswith("127.") & (s != "0.0.0.0")


def digit_and_letter(c: Column) -> Column:
    return c.rlike(DIGIT) & c.rlike(LETTER)
