"""From candidates to spans: checks, context, company forms, filters, and propagation of surnames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import patterns, validators
from ..functions.text import LETTER, name_stem, norm_key, surname_stems
from ..plans.tables import small_side, written
from .ner import Model
from .resolve import resolve
from .scan import scan

PROPAGATED = "propagacia"


def java(pattern: str) -> str:
    """A pattern of the catalogue in Java's classes."""
    return pattern.replace(patterns.LET, LETTER).replace(r"\d", r"\p{Nd}")


def checked(name: Column, value: Column, as_of_year: int | None) -> Column:
    """Whether the value passes the named check; no check passes."""
    out = F.when(name.isNull(), F.lit(True)).when(name == "birth_number", validators.birth_number(value, as_of_year))
    for check in ("company_number", "tax_number", "vat_number", "iban", "luhn", "ipv4", "digit_and_letter"):
        out = out.when(name == check, getattr(validators, check)(value))
    return F.coalesce(out, F.lit(False))


def _rule_table(cfg: Config) -> Column:
    def row(entity, score, check, terms, required, company, source):
        return F.struct(F.lit(entity).alias("entity"), F.lit(float(score)).alias("score"), F.lit(check).cast("string").alias("check"), (F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")).alias("terms"), F.lit(required).alias("required"), F.lit(company).alias("company"), F.lit(source).alias("source"))

    rows = [(i, row(r.entity, r.score, r.check, patterns.CONTEXT.get(r.context, ()), r.required, r.company, r.name)) for i, r in enumerate(patterns.rules())]
    rows += [(-1 - i, row(entity, 1.0, None, (), False, False, "deny_list")) for i, (_, entity) in enumerate(cfg.deny_list)]
    return F.map_from_entries(F.array(*[F.struct(F.lit(i), r) for i, r in rows]))


def raw_spans(scanned: DataFrame, cfg: Config) -> DataFrame:
    """Adds `raw`: the candidates that pass, with their type, score and source, after the filters by type, threshold and allow list."""
    form = f"^(?:{java(patterns.COMPANY_FORM)})"

    def judge(c: Column) -> Column:
        rule = F.element_at(F.col("rules_"), c["rule"])
        hit = F.exists(rule["terms"], lambda t: F.contains(c["near"], t))
        score = F.when(hit, F.least(F.lit(1.0), rule["score"] + 0.3)).otherwise(rule["score"])
        suffix = F.regexp_extract(c["tail"], form, 0)
        company = rule["company"] & ((suffix != "") | c["value"].rlike(patterns.COMPANY_WORD))
        ok = checked(rule["check"], c["value"], cfg.as_of_year) & (hit | ~rule["required"])
        return F.struct(c["start"].alias("start"), (c["end"] + F.when(rule["company"], F.length(suffix)).otherwise(0)).alias("end"), F.when(company, "ORGANIZACIA").otherwise(rule["entity"]).alias("entity"), F.round(score, 3).alias("score"), rule["source"].alias("source"), ok.alias("ok"))

    wanted = F.array(*map(F.lit, sorted(cfg.entities))) if cfg.entities else F.array().cast("array<string>")
    keep = lambda s: s["ok"] & (F.array_contains(wanted, s["entity"]) | (s["source"] == "deny_list")) & (s["score"] >= cfg.threshold)
    other = F.transform("modelled", lambda s: F.struct(*[s[f].alias(f) for f in ("start", "end", "entity", "score", "source")], F.lit(True).alias("ok")))
    out = scanned.withColumn("rules_", _rule_table(cfg)).withColumn("raw", F.filter(F.concat(F.transform("candidates", judge), other), keep)).drop("rules_", "modelled")
    if cfg.allow_list:
        out = out.withColumn("allow_", _allowed(cfg)).withColumn("raw", F.filter("raw", lambda s: ~F.array_contains(F.col("allow_"), norm_key(_text(s))))).drop("allow_")
    return out.withColumn("raw", F.transform("raw", lambda s: F.struct(*[s[f].alias(f) for f in ("start", "end", "entity", "score", "source")])))


def _allowed(cfg: Config) -> Column:
    return F.array(*[norm_key(F.lit(a)) for a in cfg.allow_list])


def _text(s: Column) -> Column:
    return F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])


def detect(units: DataFrame, cfg: Config, known: DataFrame | None = None, model: Callable[[], Model] | None = None) -> DataFrame:
    """units (doc_seq, unit_seq, text, ..) with `spans`: resolved, by start, each with its text.

    Surnames are propagated: a capitalised word whose stem is that of a surname found in the same unit, in an earlier one, or in
    `known` (stem), is a person. Order is that of doc_seq and unit_seq. Null and blank texts have no spans."""
    found = raw_spans(scan(units, cfg, model), cfg).withColumn("spans", resolve("raw")).drop("candidates", "raw", "folded")
    if cfg.propagate_names and "OSOBA" in cfg.entities:
        found = _propagated(written(found, "found"), cfg, known)
    with_text = lambda s: F.struct(*[s[f].alias(f) for f in ("start", "end", "entity", "score", "source")], _text(s).alias("text"))
    return found.drop("words").withColumn("spans", F.transform("spans", with_text))


def _propagated(found: DataFrame, cfg: Config, known: DataFrame | None) -> DataFrame:
    persons = found.select("doc_seq", "unit_seq", "text", F.explode(F.filter("spans", lambda s: s["entity"] == "OSOBA")).alias("s"))
    stems = persons.select("doc_seq", "unit_seq", F.explode(surname_stems(_text(F.col("s")))).alias("stem")).groupBy("stem").agg(F.min(F.struct("doc_seq", "unit_seq")).alias("since"))
    if known is not None:
        early = known.select("stem", F.struct(F.lit(-1).cast("long").alias("doc_seq"), F.lit(-1).cast(found.schema["unit_seq"].dataType).alias("unit_seq")).alias("since"))
        stems = stems.union(early).groupBy("stem").agg(F.min("since").alias("since"))
    stems = written(stems, "stems")
    if not stems.limit(1).count():
        return found
    stems = small_side(stems, 64)
    words = found.select("doc_seq", "unit_seq", "text", F.explode("words").alias("w")).withColumn("surface", F.expr("substring(text, w.start + 1, w.end - w.start)")).drop("text")
    words = words.withColumn("stem", name_stem(F.col("w.word"))).join(stems, "stem").where(F.struct("doc_seq", "unit_seq") >= F.col("since"))
    if cfg.allow_list:
        words = words.where(~F.array_contains(_allowed(cfg), norm_key(F.col("surface"))))
    span = F.struct(F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.lit("OSOBA").alias("entity"), F.lit(0.7).alias("score"), F.lit(PROPAGATED).alias("source"))
    more = written(words.groupBy("doc_seq", "unit_seq").agg(F.array_sort(F.collect_list(span)).alias("more")), "more")  # of one unit
    out = found.join(small_side(more, 256), ["doc_seq", "unit_seq"], "left")
    return out.withColumn("spans", F.when(F.col("more").isNull(), F.col("spans")).otherwise(resolve("concat(spans, more)"))).drop("more")
