"""Registered queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import patterns
from ..functions import text as tx
from ..functions import validators as va
from ..operators import detect, resolve, review, scan, tokens

from ..sources import pages
from ..sources.files import output_name, segments
from .engine import Engine, as_units
from .tables import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The year that the queries check birth numbers against.
YEAR = 2026


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(*entities: str, **more) -> Config:
    return Config(entities=frozenset(entities), as_of_year=YEAR, **more)


# ---------------------------------------------------------------- detection over documents
_EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)*\.[A-Za-z]{2,}"
_IP = r"(?:^|[^\d.])((?:\d{1,3}\.){3}\d{1,3})(?:$|[^\d.])"
_CARD = r"(\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7})(?:$|[^\d])"
_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 1 THEN (substr(d, i, 1)::INT * 2) // 10 + (substr(d, i, 1)::INT * 2) % 10 ELSE substr(d, i, 1)::INT END)) % 10 = 0"
_NEAR = "(contains({c}, 'kart') OR contains({c}, 'card') OR contains({c}, 'visa') OR contains({c}, 'mastercard'))"


def _found(spark: SparkSession, sf_dir: str, cfg: Config, name: str = "documents", key: str = "doc_id") -> DataFrame:
    return Engine(spark, cfg).scan(as_units(table(spark, sf_dir, name), key))


def _values(entity: str):
    return lambda spark, sf_dir: _found(spark, sf_dir, only(entity)).select(F.col("doc_seq").alias("doc_id"), F.col("text").alias("value"))


_EMAILS = f"SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS value FROM documents"
_IPS = f"SELECT doc_id, value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_IP}', 1)) AS value FROM documents) WHERE regexp_full_match(value, '((0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(\\.|$)){{4}}') AND value NOT LIKE '127.%' AND value != '0.0.0.0'"
_CARDS = f"SELECT doc_id, value FROM (SELECT doc_id, value, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '\\d{{20,}}', 'x', 'g'), '{_CARD}', 1)) AS value FROM documents)) WHERE length(d) BETWEEN 13 AND 19 AND {_LUHN}"
query("scan_email", _EMAILS)(_values("EMAIL"))
query("scan_ipv4", _IPS)(_values("IP_ADRESA"))
query("scan_card_luhn", _CARDS)(_values("KARTA"))


@query("entity_counts")
def _entity_counts(spark, sf_dir):
    return _found(spark, sf_dir, Config(as_of_year=YEAR)).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


@query("entity_rollup", f"SELECT coalesce(x.doc_id, -1) AS doc_id, coalesce(x.entity, '*') AS entity, count(*) AS n FROM (SELECT doc_id, 'EMAIL' AS entity FROM ({_EMAILS}) UNION ALL SELECT doc_id, 'IP_ADRESA' FROM ({_IPS}) UNION ALL SELECT doc_id, 'KARTA' FROM ({_CARDS})) x GROUP BY GROUPING SETS ((x.doc_id, x.entity), (x.entity), ())")
def _rollup(spark, sf_dir):
    found = _found(spark, sf_dir, only("EMAIL", "IP_ADRESA", "KARTA"))
    return review.entity_rollup(found).select(F.coalesce("doc_seq", F.lit(-1).cast("long")).alias("doc_id"), F.coalesce("entity", F.lit("*")).alias("entity"), "n")


@query("review_groups", f"""WITH e AS (SELECT doc_id, value, lower(regexp_replace(value, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS k FROM ({_EMAILS})),
f AS (SELECT k, min(doc_id) AS d FROM e GROUP BY k) SELECT k AS key, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS n_files, count(DISTINCT value)::BIGINT AS n_variants FROM e GROUP BY k""")
def _review(spark, sf_dir):
    found = written(_found(spark, sf_dir, only("EMAIL")), "spans")
    named = tokens.assign(found, "reversible")
    groups = review.review_groups(found, named)
    keys = named.select("base", F.col("key")[0].alias("key")).distinct()
    return groups.join(keys, "base").select("key", F.col("count").alias("n"), F.size("files").cast("long").alias("n_files"), F.size("variants").cast("long").alias("n_variants"))


# ---------------------------------------------------------------- replacing and restoring
@query("anonymize_text", f"SELECT doc_id, md5(regexp_replace(text, '{_EMAIL}', '[EMAIL]', 'g')) AS digest FROM documents")
def _anonymize(spark, sf_dir):
    run = Engine(spark, only("EMAIL", numbered_tokens=False)).anonymize(as_units(table(spark, sf_dir, "documents")), "irreversible")
    return run.units.select(F.col("doc_seq").alias("doc_id"), F.md5("text").alias("digest"))


@query("mask_conversations", f"SELECT conv_id, turn, md5(regexp_replace(text, '{_EMAIL}', '[EMAIL]', 'g')) AS digest FROM conversations")
def _mask(spark, sf_dir):
    units = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_seq"), F.col("turn").alias("unit_seq"), "text")
    run = Engine(spark, only("EMAIL", numbered_tokens=False)).anonymize(units, "irreversible")
    return run.units.select(F.col("doc_seq").alias("conv_id"), F.col("unit_seq").alias("turn"), F.md5("text").alias("digest"))


@query("restore_roundtrip", "SELECT doc_id, md5(text) AS digest FROM documents")
def _roundtrip(spark, sf_dir):
    engine = Engine(spark, Config(as_of_year=YEAR))
    run = engine.anonymize(as_units(table(spark, sf_dir, "documents")), "reversible")
    back = engine.restore(run.units.select("doc_seq", "unit_seq", "text"), run.vault)
    return back.select(F.col("doc_seq").alias("doc_id"), F.md5("text").alias("digest"))


@query("token_ids_exact", f"""WITH e AS (SELECT doc_id, position(value IN text) AS p, value, lower(regexp_replace(value, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS k FROM (SELECT doc_id, text, unnest(regexp_extract_all(text, '{_EMAIL}')) AS value FROM documents)),
f AS (SELECT k, min({{'d': doc_id, 'p': p}}) AS o FROM e GROUP BY k) SELECT k AS key, row_number() OVER (ORDER BY o.d, o.p) AS id FROM f""")
def _ids(spark, sf_dir):
    found = written(_found(spark, sf_dir, only("EMAIL")), "spans")
    return tokens.identities(found).select(F.col("key")[0].alias("key"), "id")


@query("vault_roundtrip", f"""WITH e AS (SELECT {{'d': doc_id, 'p': position(value IN text)}} AS o, value, lower(regexp_replace(value, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS k FROM (SELECT doc_id, text, unnest(regexp_extract_all(text, '{_EMAIL}')) AS value FROM documents)),
ids AS (SELECT k, row_number() OVER (ORDER BY o) AS id FROM (SELECT k, min(o) AS o FROM e GROUP BY k)), forms AS (SELECT k, value, row_number() OVER (PARTITION BY k ORDER BY o) AS i FROM (SELECT k, value, min(o) AS o FROM e GROUP BY k, value))
SELECT concat('[EMAIL_', lpad(id::VARCHAR, greatest(3, length(id::VARCHAR))::INT, '0'), CASE WHEN i > 1 THEN concat('/', i) ELSE '' END, ']') AS token, value AS original FROM forms JOIN ids USING (k)""")
def _vault(spark, sf_dir):
    from .. import vault

    run = Engine(spark, only("EMAIL")).anonymize(as_units(table(spark, sf_dir, "documents")), "reversible")
    opened = vault.opened(spark, vault.sealed(spark, run.vault, "correct horse battery"), "correct horse battery")
    return tokens.token_of(opened["variants"])


# ---------------------------------------------------------------- text functions
@query("fold_norm_key", r"SELECT doc_id, md5(strip_accents(text)) AS folded, md5(regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}]', '', 'g')) AS key, md5(regexp_replace(text, '[^0-9]', '', 'g')) AS digits FROM documents")
def _fold(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.fold(c)).alias("folded"), F.md5(tx.norm_key(c)).alias("key"), F.md5(tx.digits(c)).alias("digits"))


_SURNAMES = ["Novák", "Kováč", "Horváth", "Tóth", "Baláž", "Petr", "Karl", "Malý"]
_ENDS = ["", "a", "ovi", "om", "ová", "ovej", "ovou", "ho", "emu", "ej", "y"]


def _pick(values: list[str], n: str) -> str:
    return f"CASE {n} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_NAME = f"concat({_pick(_SURNAMES, 'c_custkey')}, {_pick(_ENDS, '(c_custkey // 8)')})"


def _cases(endings, least, mark):
    return " ".join(f"WHEN w LIKE '%{e}' AND length(w) >= {len(e) + least} THEN concat(substr(w, 1, length(w) - {len(e)}), '{mark}')" for e in endings)


_STEM_SQL = f"(CASE {_cases(tx.FEMALE_ENDINGS, 2, '~f')} ELSE (CASE CASE {_cases(tx.ENDINGS, 3, '')} ELSE w END " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in tx.VOWEL_STEMS.items()) + f" ELSE CASE {_cases(tx.ENDINGS, 3, '')} ELSE w END END) END)"


@query("name_stem", f"SELECT c_custkey, surface, {_STEM_SQL} AS stem FROM (SELECT c_custkey, {_NAME} AS surface, lower(strip_accents({_NAME})) AS w FROM customer)")
def _stem(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_NAME.replace("//", "div")).alias("surface"))
    return names.withColumn("stem", tx.name_stem(F.col("surface")))


@query("output_names", "SELECT c_custkey, concat('list.', c_custkey, '_anonym.txt') AS a, concat('list.', c_custkey, '_anonym.report.json') AS r, concat('list.', c_custkey, '_obnovene.txt') AS b FROM customer")
def _names(spark, sf_dir):
    n = F.concat(F.lit("list."), "c_custkey", F.lit(".txt"))
    a = output_name(n, "anonymized")
    return table(spark, sf_dir, "customer").select("c_custkey", a.alias("a"), output_name(n, "report").alias("r"), output_name(a, "restored").alias("b"))


# ---------------------------------------------------------------- checks over made numbers
def _check(name: str, value: str, check: Callable, sql: str) -> None:
    """value: SQL that both engines read, over o_orderkey as k; sql: the check over the value v and its digits d."""
    made = f"SELECT o_orderkey AS id, {value} AS v FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table(spark, sf_dir, "orders").createOrReplaceTempView("orders_")
        rows = spark.sql(made.replace("FROM orders)", "FROM orders_)").replace("//", "div"))
        return rows.select("id", F.col("v").alias("value"), check(F.col("v")).alias("ok"))

    query(name, f"SELECT id, v AS value, coalesce({sql}, false) AS ok FROM (SELECT id, v, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM ({made}))")(run)


def _at(i: int, n: int = 1) -> str:
    return f"substr(d, {i}, {n})::BIGINT"


_check("valid_ico", "lpad(cast((k * 7919 + 12345678) % 100000000 AS varchar(20)), 8, '0')", va.company_number, f"(11 - ({' + '.join(f'{_at(i + 1)} * {8 - i}' for i in range(7))}) % 11) % 10 = {_at(8)}")
_check("valid_dic", "lpad(cast((k * 104729) % 70000 AS varchar(20)), 10, cast(k % 7 AS varchar(20)))", va.tax_number, "substr(d, 1, 1) IN ('1', '2', '3', '4') AND length(d) = 10")
_check("valid_ic_dph", "concat('SK', lpad(cast((k * 7919 + 2020000000) % 9999999999 AS varchar(20)), 10, '0'))", va.vat_number, "d::BIGINT % 11 = 0")
_check("valid_luhn", "concat('4', lpad(cast(k * 7919 AS varchar(20)), CASE WHEN k % 5 = 0 THEN 11 ELSE 14 END, '1'), cast(k % 10 AS varchar(20)))", va.luhn, f"length(d) BETWEEN 13 AND 19 AND {_LUHN}")
_check("valid_ipv4", "concat(cast(k % 300 AS varchar(20)), '.', cast((k * 7) % 260 AS varchar(20)), '.', lpad(cast((k * 13) % 256 AS varchar(20)), CASE WHEN k % 9 = 0 THEN 3 ELSE cast(length(cast((k * 13) % 256 AS varchar(20))) AS int) END, '0'), '.', cast((k * 3) % 256 AS varchar(20)))", va.ipv4, r"regexp_full_match(v, '((0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(\.|$)){4}') AND v NOT LIKE '127.%' AND v != '0.0.0.0'")
_check("valid_iban", "concat('SK', lpad(cast(k % 97 AS varchar(20)), 2, '0'), ' 1100 0000 ', lpad(cast(k * 7919 AS varchar(20)), 12, '0'))", va.iban, "length(d) = 22 AND (substr(d, 3, 20) || '2820' || substr(d, 1, 2))::HUGEINT % 97 = 1")
_check(
    "valid_rc",
    "concat(lpad(cast(k % 100 AS varchar(20)), 2, '0'), lpad(cast(CASE k % 4 WHEN 0 THEN (k // 4) % 13 WHEN 1 THEN 50 + (k // 4) % 13 WHEN 2 THEN 20 + (k // 4) % 13 ELSE 70 + (k // 4) % 13 END AS varchar(20)), 2, '0'), lpad(cast((k // 16) % 33 AS varchar(20)), 2, '0'), '/', lpad(cast((k * 11 + k // 128) % CASE WHEN k % 3 = 0 THEN 1000 ELSE 10000 END AS varchar(20)), CASE WHEN k % 3 = 0 THEN 3 ELSE 4 END, '0'))",
    lambda c: va.birth_number(c, YEAR),
    f"""(CASE WHEN length(d) = 9 THEN {_at(1, 2)} < 54 WHEN length(d) = 10 THEN (CASE WHEN {_at(1, 2)} >= 54 THEN 1900 ELSE 2000 END + {_at(1, 2)}) <= {YEAR} AND (d::BIGINT % 11 = 0 OR (substr(d, 1, 9)::BIGINT % 11 = 10 AND substr(d, 10, 1) = '0')) ELSE false END)
    AND try_cast(concat(CASE WHEN length(d) = 9 OR {_at(1, 2)} >= 54 THEN 1900 ELSE 2000 END + {_at(1, 2)}, '-', CASE WHEN {_at(3, 2)} > 70 AND length(d) = 10 AND {_at(1, 2)} BETWEEN 4 AND 53 THEN {_at(3, 2)} - 70 WHEN {_at(3, 2)} > 50 THEN {_at(3, 2)} - 50 WHEN {_at(3, 2)} > 20 AND length(d) = 10 AND {_at(1, 2)} BETWEEN 4 AND 53 THEN {_at(3, 2)} - 20 ELSE {_at(3, 2)} END, '-', {_at(5, 2)}) AS DATE) IS NOT NULL""",
)


# ---------------------------------------------------------------- rules over made texts
#: (before, value, after, whether it is found, type, score) by rule: SQL that both engines read, over k.
def _num(factor: int, mod: int, width: int) -> str:
    return f"lpad(cast((k * {factor}) % {mod} AS varchar(20)), {width}, '0')"


def _two(expr: str) -> str:
    return f"lpad(cast({expr} AS varchar(20)), 2, '0')"


_CLUE = lambda clue, n=3: f"CASE WHEN k % {n} = 0 THEN 'udaj ' ELSE '{clue}' END"
_HIT = "k % 3 != 0"
_BIRTH = f"concat({_two('k % 54')}, {_two('CASE WHEN k % 10 = 0 THEN 13 ELSE 1 + k % 12 END')}, {_two('1 + k % 28')}"
_PERSON = f"concat({_pick(['Jan', 'Petrovi', 'Mariou', 'Zuzana', 'Marek'], 'k')}, ' ', {_pick(['Novak', 'Kovacova', 'Horvath', 'Balazom'], '(k // 5)')})"
_SURNAME = _pick(["Novak", "Kovac", "Horvath", "Balaz"], "k")
_HOUSE = f"concat({_pick(['Hlavna', 'Dlha', 'Mlynska'], 'k')}, ' ', cast(1 + k % 900 AS varchar(20)))"


def _ico() -> str:
    d = _num(7919, 10000000, 7)
    total = " + ".join(f"cast(substr({d}, {i + 1}, 1) AS int) * {8 - i}" for i in range(7))
    return f"concat(substr({d}, 1, 2), ' ', substr({d}, 3, 3), ' ', substr({d}, 6, 2), cast(((11 - ({total}) % 11) % 10 + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) % 10 AS varchar(20)))"


def _iban(country: str, letters: int) -> str:
    x = "((k * 7919) % 1000000000)"
    rest = f"((((1100000000 % 97) * (10000000000 % 97) + {x}) % 97) * (1000000 % 97) + {letters}00) % 97"
    s = f"concat('{country}', {_two(f'(98 - {rest} + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) % 100')}, '1100000000', lpad(cast({x} AS varchar(20)), 10, '0'))"
    return "concat_ws(' ', " + ", ".join(f"substr({s}, {i}, 4)" for i in range(1, 24, 4)) + ")"


_VAT = "concat('SK', cast(2020000004 + 11 * ((k * 7919) % 1000000) + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS varchar(20)))"
_DATE = "concat(cast(1 + k % 28 AS varchar(20)), '. ', " + _pick([f"{m}." for m in range(1, 13)] + ["marca"], "k") + ", ' ', cast(1930 + k % 70 AS varchar(20)))"
RULE_TEXTS = {
    "rules_birth": {
        "rc_slash": (_CLUE("rodne cislo "), f"{_BIRTH}, '/', {_num(7, 1000, 3)})", "' koniec'", "k % 10 != 0", "'RODNE_CISLO'", f"CASE WHEN {_HIT} THEN 0.9 ELSE 0.6 END"),
        "rc_plain": (_CLUE("r.c. "), f"{_BIRTH}, {_num(7, 1000, 3)})", "' koniec'", f"k % 10 != 0 AND {_HIT}", "'RODNE_CISLO'", "0.9"),
        "datum_nar": (_CLUE("nar. "), _DATE, "', trvale'", _HIT, "'DATUM_NARODENIA'", "0.9"),
    },
    "rules_company": {
        "ico": (_CLUE("ICO: "), _ico(), "' koniec'", f"k % 5 != 0 AND {_HIT}", "'ICO'", "0.9"),
        "dic": (_CLUE("DIC: "), f"concat(CASE WHEN k % 4 = 0 THEN '5' ELSE '2' END, {_num(7919, 1000000000, 9)})", "' koniec'", f"k % 4 != 0 AND {_HIT}", "'DIC'", "0.9"),
        "ic_dph": (_CLUE("IC DPH: "), _VAT, "' koniec'", "k % 5 != 0", "'IC_DPH'", f"CASE WHEN {_HIT} THEN 1.0 ELSE 0.85 END"),
        "organizacia": ("'firma '", f"concat({_SURNAME}, {_pick([' s.r.o.', ', a.s.', ' GmbH', ' spol. s r. o.'], '(k // 4)')})", "' a ine'", "true", "'ORGANIZACIA'", "0.7"),
    },
    "rules_account": {
        "iban_sk": ("'ucet '", _iban("SK", 2820), "' koniec'", "k % 5 != 0", "'IBAN'", "0.95"),
        "iban": ("'ucet '", _iban("CZ", 1235), "' koniec'", "k % 5 != 0", "'IBAN'", "0.9"),
        "ucet": (_CLUE("cislo uctu "), f"concat(CASE WHEN k % 4 = 0 THEN '19-' ELSE '' END, {_num(7919, 1000000000, 10)}, '/0200')", "' koniec'", _HIT, "'UCET'", "0.85"),
    },
    "rules_phone": {
        "tel_sk_intl": (_CLUE("tel. "), f"concat({_pick(['+421 ', '00421/', '+421'], 'k')}, '905 ', {_num(7, 1000, 3)}, ' ', {_num(13, 1000, 3)})", "' koniec'", "true", "'TELEFON'", "0.9"),
        "tel_sk_pevna": (_CLUE("tel. "), f"concat({_pick(['02/', '041 / '], 'k')}, {_num(7, 1000, 3)}, ' ', {_num(13, 1000, 3)}, ' ', {_num(3, 100, 2)})", "' koniec'", "true", "'TELEFON'", f"CASE WHEN {_HIT} THEN 0.75 ELSE 0.45 END"),
        "tel_intl": (_CLUE("kontakt "), f"concat({_pick(['+43 ', '+420-', '+1 '], 'k')}, '664 ', {_num(7, 1000, 3)}, ' ', {_num(13, 1000, 3)})", "' koniec'", "true", "'TELEFON'", f"CASE WHEN {_HIT} THEN 0.9 ELSE 0.6 END"),
    },
    "rules_document": {
        "doklad": (_CLUE("obciansky preukaz "), f"concat({_pick(['EA', 'HB', 'SL '], 'k')}, {_num(7919, 1000000, 6)})", "' koniec'", _HIT, "'DOKLAD'", "0.8"),
        "spz": (_CLUE("vozidlo "), f"concat({_pick(['BA', 'KE-', 'ZA '], 'k')}, {_num(7, 1000, 3)}, {_pick(['AB', ' XY', '-CD'], '(k // 3)')})", "' koniec'", "true", "'SPZ'", f"CASE WHEN {_HIT} THEN 0.8 ELSE 0.5 END"),
    },
    "rules_address": {
        "adresa": ("'na adrese '", f"concat({_HOUSE}, ', ', {_num(7, 900, 3)}, ' ', {_num(3, 100, 2)}, ' Bratislava')", "'.'", "true", "'ADRESA'", "0.85"),
        "ulica": ("'byva na '", f"concat({_pick(['ul. ', 'ulica '], 'k')}, {_HOUSE})", "' dnes'", "true", "'ADRESA'", "0.7"),
        "adresa_label": (_CLUE("bydlisko: "), f"CASE WHEN k % 5 = 0 THEN 'Hlavna cesta' ELSE {_HOUSE} END", "chr(10)", f"k % 5 != 0 AND {_HIT}", "'ADRESA'", "0.8"),
    },
    "rules_person": {
        "osoba_label": (_CLUE("Kupujuci: "), f"CASE WHEN k % 4 = 0 THEN concat({_SURNAME}, ' s.r.o.') ELSE {_PERSON} END", "chr(10)", _HIT, "CASE WHEN k % 4 = 0 THEN 'ORGANIZACIA' ELSE 'OSOBA' END", "0.9"),
        "osoba_zastupeny": (_CLUE("zastupeny konatelom "), _PERSON, "', dalej'", _HIT, "'OSOBA'", "0.85"),
        "osoba_titul": ("'podpisal '", f"concat({_pick(['Ing. ', 'Mgr. ', 'prof. MUDr. '], 'k')}, {_PERSON}, {_pick(['', ', PhD.'], '(k // 3)')})", "' dnes'", "true", "'OSOBA'", "0.85"),
        "osoba_krstne": ("'stretol '", _PERSON, "' vcera'", "true", "'OSOBA'", "0.8"),
    },
    "rules_letter": {
        "osoba_oslovenie": (_CLUE("vola pan "), _SURNAME, "' dnes'", _HIT, "'OSOBA'", "0.75"),
        "osoba_pozdrav": (_CLUE("Ahoj "), _SURNAME, "', pisem'", _HIT, "'OSOBA'", "0.7"),
        "osoba_podpis": (f"concat('text', chr(10), CASE WHEN {_HIT} THEN 'S pozdravom,' ELSE 'S uvahou' END, chr(10))", _PERSON, "''", _HIT, "'OSOBA'", "0.8"),
    },
}


def _rules(name: str, cases: dict[str, tuple[str, ...]]) -> None:
    def rows(wanted: Callable[..., str], source: str) -> str:
        return " UNION ALL ".join(f"SELECT k AS id, '{rule}' AS rule, {wanted(*c)}".replace("{source}", f"(SELECT c_custkey AS k FROM {source})") for rule, c in cases.items())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table(spark, sf_dir, "customer").createOrReplaceTempView("customer_")
        made = spark.sql(rows(lambda a, v, z, *_: f"concat({a}, {v}, {z}) AS text FROM {{source}}", "customer_").replace("//", "div"))
        cfg = Config(entities=frozenset(r.entity for r in patterns.rules()), threshold=0.0, propagate_names=False, as_of_year=YEAR)
        found = detect.raw_spans(scan.scan(made, cfg), cfg).select("id", "rule", "text", F.explode("raw").alias("s")).where("s.source = rule")
        return found.select("id", "rule", F.col("s.start").alias("start_"), F.col("s.end").alias("end_"), F.col("s.entity").alias("entity"), F.col("s.score").alias("score"), F.expr("substring(text, s.start + 1, s.end - s.start)").alias("value"))

    span = lambda a, v, z, ok, kind, score: f"length({a})::INT AS start_, (length({a}) + length({v}))::INT AS end_, {kind} AS entity, ({score})::DOUBLE AS score, {v} AS value FROM {{source}} WHERE {ok}"
    query(name, rows(span, "customer"))(run)


for _name, _texts in RULE_TEXTS.items():
    _rules(_name, _texts)


# ---------------------------------------------------------------- context, lists, threshold
_WORDS = ["tel", "Kontakt", "veta", "objednavka", "mobil", "cislo"]
_TEXT = f"concat({_pick(_WORDS, 'c_custkey')}, ': 0905 ', lpad(cast(c_custkey % 1000 AS varchar(20)), 3, '0'), ' 456 koniec')"


def _made(spark, sf_dir, sql: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_seq"), F.lit(0).alias("unit_seq"), F.expr(sql.replace("//", "div")).alias("text"))


@query("ctx_score", f"SELECT c_custkey, concat('0905 ', lpad(cast(c_custkey % 1000 AS varchar(20)), 3, '0'), ' 456') AS value, CASE WHEN c_custkey % 6 IN (0, 1, 4) THEN 1.0 ELSE 0.75 END::DOUBLE AS score FROM customer")
def _ctx(spark, sf_dir):
    return Engine(spark, only("TELEFON")).scan(_made(spark, sf_dir, _TEXT)).select(F.col("doc_seq").alias("c_custkey"), F.col("text").alias("value"), "score")


@query("entity_filter_threshold", f"SELECT c_custkey, 1.0::DOUBLE AS score FROM customer WHERE c_custkey % 6 IN (0, 1, 4)")
def _threshold(spark, sf_dir):
    return Engine(spark, only("TELEFON", threshold=0.9)).scan(_made(spark, sf_dir, _TEXT)).select(F.col("doc_seq").alias("c_custkey"), "score")


@query("allow_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey % 1000 NOT IN (7, 123)")
def _allow(spark, sf_dir):
    return Engine(spark, only("TELEFON", allow_list=("0905-007-456", "0905 123 456"))).scan(_made(spark, sf_dir, _TEXT)).select(F.col("doc_seq").alias("c_custkey"))


@query("deny_match", "SELECT c_custkey, 'VLASTNE' AS entity, CASE c_custkey % 6 WHEN 3 THEN 'objednavka' ELSE 'Kontakt' END AS value FROM customer WHERE c_custkey % 6 IN (1, 3)")
def _deny(spark, sf_dir):
    cfg = only(deny_list=(("Objednávka", "VLASTNE"), ("kontakt", "VLASTNE"), ("onta", "VLASTNE")))
    return Engine(spark, cfg).scan(_made(spark, sf_dir, _TEXT)).select(F.col("doc_seq").alias("c_custkey"), "entity", F.col("text").alias("value"))


# ---------------------------------------------------------------- names across units
_FULL = f"CASE WHEN c_custkey % 40 = 8 THEN concat('Ing. Peter ', {_pick(['Novák', 'Kováč', 'Horváth', 'Baláž'], '(c_custkey // 40)')}) ELSE concat('slovo ', {_pick(['Nováka', 'Kováčom', 'Horváthovi', 'Baláž', 'Hudák'], 'c_custkey')}, ' koniec') END"


@query("propagate_semi_join", f"""WITH t AS (SELECT c_custkey, {_FULL} AS x, {_pick(['novak', 'kovac', 'horvath', 'balaz', 'hudak'], 'c_custkey')} AS s, CASE WHEN c_custkey % 40 = 8 THEN {_pick(['novak', 'kovac', 'horvath', 'balaz'], '(c_custkey // 40)')} END AS f FROM customer),
since AS (SELECT f, min(c_custkey) AS k FROM t WHERE f IS NOT NULL GROUP BY f)
SELECT c_custkey, substr(x, 7, length(x) - 13) AS value FROM t JOIN since ON t.s = since.f AND t.c_custkey >= since.k WHERE t.f IS NULL""")
def _propagate(spark, sf_dir):
    found = Engine(spark, only("OSOBA")).scan(_made(spark, sf_dir, _FULL))
    return found.where("source = 'propagacia'").select(F.col("doc_seq").alias("c_custkey"), F.col("text").alias("value"))


@query("token_variants", f"""WITH t AS (SELECT c_custkey, {_FULL} AS x, CASE WHEN c_custkey % 40 = 8 THEN {_pick(['novak', 'kovac', 'horvath', 'balaz'], '(c_custkey // 40)')} ELSE {_pick(['novak', 'kovac', 'horvath', 'balaz', 'hudak'], 'c_custkey')} END AS s, c_custkey % 40 = 8 AS f FROM customer),
since AS (SELECT s, min(c_custkey) AS k FROM t WHERE f GROUP BY s),
o AS (SELECT t.s, CASE WHEN f THEN x ELSE substr(x, 7, length(x) - 13) END AS surface, c_custkey, since.k AS k0 FROM t JOIN since ON t.s = since.s AND t.c_custkey >= since.k),
ids AS (SELECT s, dense_rank() OVER (ORDER BY k) AS id FROM since),
v AS (SELECT s, surface, min(c_custkey) AS c FROM o GROUP BY s, surface)
SELECT surface, format('[OSOBA_{{:03d}}', id) || CASE row_number() OVER (PARTITION BY s ORDER BY c) WHEN 1 THEN '' ELSE '/' || row_number() OVER (PARTITION BY s ORDER BY c) END || ']' AS token FROM v JOIN ids USING (s)""")
def _variants(spark, sf_dir):
    found = written(Engine(spark, only("OSOBA")).scan(_made(spark, sf_dir, _FULL)), "spans")
    return tokens.assign(found, "reversible").select(F.col("text").alias("surface"), "token")


@query("cluster_person")
def _cluster(spark, sf_dir):
    text = f"concat('pán ', {_NAME.replace('//', 'div')}, ', Ing. Jozef ', {_NAME.replace('//', 'div')})"
    found = written(Engine(spark, only("OSOBA")).scan(_made(spark, sf_dir, text)), "spans")
    return tokens.identities(found).select(F.array_join("key", " ").alias("key"), "id")


# ---------------------------------------------------------------- intervals
_SPANS = "SELECT l_orderkey AS unit_id, l_partkey % 50 AS s, l_partkey % 50 + 1 + l_suppkey % 15 AS e, CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS entity, (cast(l_quantity AS bigint) % 7) / 10.0 AS score FROM lineitem"


def _intervals(spark, sf_dir) -> DataFrame:
    span = "struct(cast(s AS int) AS start, cast(e AS int) AS end, entity, cast(score AS double) AS score, 'x' AS source)"
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem_")
    rows = spark.sql(_SPANS.replace("FROM lineitem", "FROM lineitem_"))
    return rows.groupBy("unit_id").agg(F.array_sort(F.expr(f"collect_list({span})")).alias("spans"))


_ISLANDS = f"""SELECT unit_id, entity, min(s)::INT AS s, max(e)::INT AS e, max(score)::DOUBLE AS score FROM (SELECT *, sum(new) OVER (PARTITION BY unit_id, entity ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g
FROM (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY unit_id, entity ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM ({_SPANS}))) GROUP BY unit_id, entity, g"""


@query("merge_islands", _ISLANDS)
def _merge(spark, sf_dir):
    rows = _intervals(spark, sf_dir).select("unit_id", F.explode(F.expr(resolve.merged("spans"))).alias("x"))
    return rows.select("unit_id", "x.entity", F.col("x.start").alias("s"), F.col("x.end").alias("e"), "x.score")


@query("resolve_greedy", f"""WITH RECURSIVE m AS ({_ISLANDS}), o AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY score DESC, e - s DESC, s, e, entity) AS n FROM m),
g AS (SELECT unit_id, 0::BIGINT AS n, []::STRUCT(s INT, e INT, entity VARCHAR, score DOUBLE)[] AS kept FROM (SELECT DISTINCT unit_id FROM o)
UNION ALL SELECT o.unit_id, o.n, CASE WHEN len(list_filter(g.kept, lambda c: c.s < o.e AND o.s < c.e)) > 0 THEN g.kept ELSE list_append(g.kept, struct_pack(s := o.s, e := o.e, entity := o.entity, score := o.score)) END FROM g JOIN o ON o.unit_id = g.unit_id AND o.n = g.n + 1),
l AS (SELECT unit_id, max(n) AS n FROM g GROUP BY unit_id)
SELECT unit_id, k.s AS s, k.e AS e, k.entity AS entity, k.score AS score FROM (SELECT g.unit_id, unnest(kept) AS k FROM g JOIN l ON g.unit_id = l.unit_id AND g.n = l.n)""")
def _greedy(spark, sf_dir):
    rows = _intervals(spark, sf_dir).select("unit_id", F.explode(resolve.resolve("spans")).alias("x"))
    return rows.select("unit_id", F.col("x.start").alias("s"), F.col("x.end").alias("e"), "x.entity", "x.score")


@query("split_segments", """SELECT doc_id, (i - 1)::INT AS seg_idx, (coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS seg_from, md5(x) AS digest
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""")
def _segments(spark, sf_dir):
    return segments(as_units(table(spark, sf_dir, "documents"))).select(F.col("doc_seq").alias("doc_id"), "seg_idx", F.col("offset").alias("seg_from"), F.md5("text").alias("digest"))


# ---------------------------------------------------------------- words with places
_PLACES = "SELECT l_orderkey AS page, concat('w', l_linenumber) AS word, cast(l_partkey % 400 AS double) AS x0, cast((l_suppkey % 40) * 12 AS double) AS top, cast(l_partkey % 400 + 40 AS double) AS x1, cast((l_suppkey % 40) * 12 + 10 AS double) AS bottom, CASE l_linenumber % 2 WHEN 0 THEN 'ocr' ELSE 'text' END AS kind FROM lineitem"


def _places(spark, sf_dir) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem_")
    return spark.sql(_PLACES.replace("FROM lineitem", "FROM lineitem_"))


@query("word_box", f"SELECT page, (dense_rank() OVER (PARTITION BY page ORDER BY top) - 1)::INT AS line, min(x0) - 1.5 AS x0, top - 1.5 AS top, max(x1) + 1.5 AS x1, max(bottom) + 1.5 AS bottom FROM ({_PLACES}) GROUP BY page, top")
def _box(spark, sf_dir):
    return pages.boxes(pages.with_lines(_places(spark, sf_dir)))


@query("ocr_anti_join", f"SELECT page, word, x0, top FROM ({_PLACES}) o WHERE kind = 'ocr' AND NOT EXISTS (SELECT 1 FROM ({_PLACES}) t WHERE t.kind = 'text' AND t.page = o.page AND o.x0 < t.x1 AND t.x0 < o.x1 AND o.top < t.bottom AND t.top < o.bottom)")
def _anti(spark, sf_dir):
    return pages.extra_ocr_words(_places(spark, sf_dir)).select("page", "word", "x0", "top")
