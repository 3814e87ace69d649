"""Entity keys, identities, token numbers and variants."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digits, name_stem, name_tokens, norm_key, surname_stems
from ..plans.tables import numbered, written

#: Types that are the same whatever stands between their digits; of a phone the last nine count.
NUMERIC = ("RODNE_CISLO", "TELEFON", "IBAN", "UCET", "KARTA", "ICO", "DIC", "IC_DPH")
TOKEN = r"\[([A-Z_]+?)_(\d{3,})(?:/(\d+))?\]"
MODES = ("reversible", "irreversible")


def entity_key(entity: Column, text: Column) -> Column:
    """Sorted distinct strings: stems of a person's names, digits of a number, else the normalised text."""
    stems = F.array_sort(F.array_distinct(F.transform(name_tokens(text), name_stem)))
    plain = F.array(norm_key(text))
    number = F.when(entity == "TELEFON", F.regexp_extract(digits(text), r"(.{0,9})$", 1)).otherwise(digits(text))
    return F.when(entity == "OSOBA", F.when(F.size(stems) > 0, stems).otherwise(plain)).when(entity.isin(*NUMERIC), F.array(number)).otherwise(plain)


def occurrences(detected: DataFrame) -> DataFrame:
    """A row a span: doc_seq, unit_seq, start, end, entity, score, source, text, key."""
    s = detected.select("doc_seq", "unit_seq", F.explode("spans").alias("s")).select("doc_seq", "unit_seq", "s.*")
    return s.withColumn("key", entity_key(F.col("entity"), F.col("text")))


class PersonIndex:
    """Clusters of persons, met in order. A key that some cluster has is that cluster; else it is that of the only
    cluster with a key that holds it or that it holds; else a new one."""

    def __init__(self, clusters: list[tuple[int, list[list[str]]]] = (), counter: int = 0):
        self.exact: dict[tuple[str, ...], int] = {}
        self.by_stem: dict[str, dict[int, list[frozenset[str]]]] = {}
        self.counter = counter
        for number, keys in clusters:
            for k in keys:
                self._add(tuple(sorted(k)), number)

    def _add(self, key: tuple[str, ...], number: int) -> None:
        self.exact.setdefault(key, number)
        for stem in key:
            self.by_stem.setdefault(stem, {}).setdefault(number, []).append(frozenset(key))

    def resolve(self, key: tuple[str, ...]) -> int:
        if key in self.exact:
            return self.exact[key]
        own = frozenset(key)
        near = {number for stem in key for number, keys in self.by_stem.get(stem, {}).items() if any(own <= k or k <= own for k in keys)}
        if len(near) == 1:
            number = near.pop()
        else:
            self.counter += 1
            number = self.counter
        self._add(key, number)
        return number


def identities(found: DataFrame, vault: dict[str, DataFrame] | None = None) -> DataFrame:
    """(entity, key, id): numbers by first occurrence, after those of the vault.

    Persons are resolved one distinct key after another, since which cluster a key joins depends on those before it. Distinct keys are as
    many as there are different people, not occurrences; other types are numbered by many tasks."""
    keys = found.groupBy("entity", "key").agg(F.min(F.struct("doc_seq", "unit_seq", (-F.size("key")).alias("r"), "start")).alias("f"))
    keys = written(keys.select("entity", "key", F.col("f.doc_seq").cast("double").alias("doc"), F.col("f.unit_seq").alias("unit"), F.col("f.r").alias("r"), F.col("f.start").alias("start")), "keys")
    spark = found.sparkSession
    known = vault["keys"] if vault else spark.createDataFrame([], "entity string, key array<string>, id long")
    counters = vault["counters"] if vault else spark.createDataFrame([], "entity string, n long")
    others = keys.where("entity != 'OSOBA'")
    old = others.join(known, ["entity", "key"]).select("entity", "key", "id")
    new = numbered(others.join(known, ["entity", "key"], "left_anti"), ["entity"], "doc", ["unit", "start", "key"], "k")
    new = new.join(F.broadcast(counters), "entity", "left").select("entity", "key", (F.col("k") + F.coalesce("n", F.lit(0))).cast("long").alias("id"))  # one counter a type
    before = [(r["id"], r["keys"]) for r in known.where("entity = 'OSOBA'").groupBy("id").agg(F.collect_list("key").alias("keys")).orderBy("id").toLocalIterator()]
    counter = next((r["n"] for r in counters.where("entity = 'OSOBA'").collect()), 0)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        index = PersonIndex(before, counter)
        pdf = pdf.sort_values(["doc", "unit", "r", "start"], kind="stable")
        return pd.DataFrame({"entity": "OSOBA", "key": pdf["key"], "id": [index.resolve(tuple(k)) for k in pdf["key"]]})

    persons = keys.where("entity = 'OSOBA'").groupBy("entity").applyInPandas(fold, "entity string, key array<string>, id long")
    return old.union(new).union(persons)


def assign(found: DataFrame, mode: str, numbered_tokens: bool = True, vault: dict[str, DataFrame] | None = None) -> DataFrame:
    """(entity, text, key, id, base, token) of each distinct surface: in reversible mode the first surface of an identity has the base token,
    the k-th `[base/k]`; in irreversible mode all have the base, or the bare type without numbers."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    ids = written(identities(found, vault), "identities")
    base = F.format_string("%s_%03d", "entity", "id")
    surfaces = found.groupBy("entity", "text", "key").agg(F.min(F.struct("doc_seq", "unit_seq", "start")).alias("f")).join(ids, ["entity", "key"]).withColumn("base", base)
    if mode == "irreversible":
        token = F.concat(F.lit("["), F.col("base") if numbered_tokens else F.col("entity"), F.lit("]"))
        return written(surfaces.select("entity", "text", "key", "id", "base", token.alias("token")), "tokens")
    had = vault["variants"] if vault else found.sparkSession.createDataFrame([], "entity string, id long, text string, k long")
    old = surfaces.join(had, ["entity", "id", "text"]).select("entity", "text", "key", "id", "base", "k")
    most = had.groupBy("entity", "id").agg(F.max("k").alias("m"))
    fresh = surfaces.join(had, ["entity", "id", "text"], "left_anti").join(most, ["entity", "id"], "left")
    # surfaces of one identity, not its occurrences
    fresh = fresh.withColumn("k", (F.expr("row_number() OVER (PARTITION BY entity, id ORDER BY f.doc_seq, f.unit_seq, f.start, text)") + F.coalesce("m", F.lit(0))).cast("long"))
    both = old.union(fresh.select("entity", "text", "key", "id", "base", "k"))
    token = F.when(F.col("k") == 1, F.concat(F.lit("["), "base", F.lit("]"))).otherwise(F.concat(F.lit("["), "base", F.lit("/"), F.col("k").cast("string"), F.lit("]")))
    return written(both.select("entity", "text", "key", "id", "base", "k", token.alias("token")), "tokens")


def surnames(tokens: DataFrame) -> DataFrame:
    """(stem): of all persons' surfaces; what later runs propagate."""
    return tokens.where("entity = 'OSOBA'").select(F.explode(surname_stems(F.col("text"))).alias("stem")).distinct()


def vault_tables(tokens: DataFrame, old: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """keys, counters, variants and stems of reversible tokens, with those of an earlier vault."""
    keys, variants, stems = tokens.select("entity", "key", "id").distinct(), tokens.select("entity", "id", "text", "k").distinct(), surnames(tokens)
    counters = tokens.groupBy("entity").agg(F.max("id").alias("n"))
    if old:
        keys, variants, stems = keys.union(old["keys"]).distinct(), variants.union(old["variants"]).distinct(), stems.union(old["stems"]).distinct()
        counters = counters.union(old["counters"]).groupBy("entity").agg(F.max("n").alias("n"))
    return {k: written(v, k) for k, v in {"keys": keys, "counters": counters, "variants": variants, "stems": stems}.items()}


def token_of(variants: DataFrame) -> DataFrame:
    """(token, original) of a vault's variants."""
    base = F.format_string("%s_%03d", "entity", "id")
    return variants.select(F.when(F.col("k") == 1, F.concat(F.lit("["), base, F.lit("]"))).otherwise(F.concat(F.lit("["), base, F.lit("/"), F.col("k").cast("string"), F.lit("]"))).alias("token"), F.col("text").alias("original"))
