import random

import pytest
from pyspark.sql import functions as F

from sparkveil import vault
from sparkveil.config import Config
from sparkveil.operators import resolve, tokens
from sparkveil.plans.engine import Engine

CONTRACT = "Predávajúci: Ing. Ján Novák, nar. 15. 3. 1980, r. č. 800315/1233, trvalý pobyt: Hlavná 12, 811 01 Bratislava"
MORE = "Pani Kováčová, tel. 0905 123 456, zastúpená: Jozefovi Malému."
LAW = "Podľa § 588 Občianskeho zákonníka zo dňa 1. 1. 2020 je kúpna cena 1 200 000 EUR splatná do 30 dní."
WORDS = ["Novák", "Nováka", "slovo", "Kováčová", "Kováčovej", "a", "tel. 0905 123 456", "jan@novak.sk", "Ing. Peter Malý", "pán Novák", "Ján Novák"]


def units(spark, texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_seq long, unit_seq int, text string")


def spans(spark, texts, **cfg):
    rows = Engine(spark, Config.of({"as_of_year": 2026, **cfg})).scan(units(spark, texts)).orderBy("doc_seq", "start").collect()
    return [(r["entity"], r["text"]) for r in rows]


def test_detection(spark):
    assert spans(spark, [CONTRACT, MORE]) == [
        ("OSOBA", "Ing. Ján Novák"), ("DATUM_NARODENIA", "15. 3. 1980"), ("RODNE_CISLO", "800315/1233"), ("ADRESA", "Hlavná 12, 811 01 Bratislava"),
        ("OSOBA", "Kováčová"), ("TELEFON", "0905 123 456"), ("OSOBA", "Jozefovi Malému"),
    ]


def test_nothing_in_law_blank_and_null(spark):
    assert spans(spark, [LAW, "", " \n ", None]) == []
    assert spans(spark, []) == []


def test_allow_beats_deny(spark):
    assert spans(spark, ["Projekt Orol vedie Ján Novák."], allow_list=["Ján Novák"], deny_list=["Projekt Orol"]) == [("VLASTNE", "Projekt Orol")]


def test_organisation_is_off_by_default(spark):
    text = "Predávajúci: Novák Trade s.r.o., IČO: 35757442"
    assert ("ICO", "35757442") in spans(spark, [text]) and not any(e in ("OSOBA", "ORGANIZACIA") for e, _ in spans(spark, [text]))
    assert ("ORGANIZACIA", "Novák Trade s.r.o.") in spans(spark, [text], entities={"enable": ["ORGANIZACIA"]})


def test_context_is_a_substring(spark):
    assert spans(spark, ["vydal pas EA123456"]) == [("DOKLAD", "EA123456")] == spans(spark, ["zápas EA123456"])
    assert spans(spark, ["kód EA123456"]) == []


def test_surnames_reach_later_units_only(spark):
    assert spans(spark, ["Prišla Nováka.", "Ing. Ján Novák", "Stretol Nováka, nie NOVÁKA."]) == [("OSOBA", "Ing. Ján Novák"), ("OSOBA", "Nováka")]


def test_long_repeats(spark):
    assert spans(spark, ["x@" + "a." * 20000 + "sk"], entities=["EMAIL"]) == [("EMAIL", "x@" + "a." * 20000 + "sk")]


def test_resolution_against_a_model(spark):
    rng = random.Random(1)
    cases = [[(a := rng.randint(0, 30), a + rng.randint(1, 9), rng.choice("AB"), rng.randint(1, 9) / 10, f"s{i}") for i in range(rng.randint(0, 9))] for _ in range(200)]
    df = spark.createDataFrame([(i, [dict(zip(("start", "end", "entity", "score", "source"), s, strict=True)) for s in c]) for i, c in enumerate(cases)], f"i int, spans array<{resolve.SPAN}>")
    got = {r["i"]: [tuple(s) for s in r["o"]] for r in df.select("i", resolve.resolve("spans").alias("o")).collect()}

    def model(c):
        joined = []
        for s in sorted(c, key=lambda s: (s[2], s[0])):
            last = joined[-1] if joined else None
            if last and last[2] == s[2] and s[0] < last[1]:
                joined[-1] = (last[0], max(last[1], s[1]), s[2], max(last[3], s[3]), last[4] if s[4] in last[4].split("+") else last[4] + "+" + s[4])
            else:
                joined.append(s)
        kept = []
        for s in sorted(joined, key=lambda s: (-s[3], s[0] - s[1], s[0])):
            if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
                kept.append(s)
        return sorted(kept)

    assert got == {i: model(c) for i, c in enumerate(cases)}


def test_roundtrip_and_vault(spark):
    rng = random.Random(2)
    texts = [CONTRACT, MORE, LAW, None, "", *(" ".join(rng.choice(WORDS) for _ in range(12)) for _ in range(20))]
    engine = Engine(spark, Config(as_of_year=2026))
    run = engine.anonymize(units(spark, texts), "reversible")
    out = {r["doc_seq"]: r["text"] for r in run.units.collect()}
    assert not any("Ján Novák" in (t or "") or "0905" in (t or "") for t in out.values())
    sealed = vault.sealed(spark, run.vault, "correct horse battery")
    assert "Novák".encode() not in sealed
    with pytest.raises(vault.VaultError):
        vault.opened(spark, sealed, "wrong")
    with pytest.raises(vault.VaultError):
        vault.opened(spark, b"{}", "wrong")
    opened = vault.opened(spark, sealed, "correct horse battery")
    back = engine.restore(run.units.select("doc_seq", "unit_seq", "text"), opened)
    assert {r["doc_seq"]: r["text"] for r in back.collect()} == dict(enumerate(texts))
    again = engine.anonymize(units(spark, ["Stretol pána Nováka, tel. 0905 123 456"]), "reversible", opened)
    text = again.units.first()["text"]
    known = {r["text"]: r["token"] for r in run.tokens.collect()}
    assert text == f"Stretol pána {known['Nováka']}, tel. {known['0905 123 456']}"
    unknown = engine.restore(units(spark, ["[OSOBA_999] a [EMAIL_001/9]"]), opened).first()
    assert (unknown["text"], unknown["restored"]) == ("[OSOBA_999] a [EMAIL_001/9]", 0)


def test_irreversible_keeps_nothing(spark):
    run = Engine(spark, Config(numbered_tokens=False)).anonymize(units(spark, [CONTRACT]), "irreversible")
    assert run.vault is None and "[OSOBA]" in run.units.first()["text"]
    with pytest.raises(ValueError):
        Engine(spark).anonymize(units(spark, [CONTRACT]), "other")


def test_numbers_do_not_depend_on_partitions(spark):
    texts = [f"pán {s}, mail u{i % 7}@x.sk" for i, s in enumerate(["Novák", "Malý", "Kováč", "Nováka"] * 10)]
    runs = [{r["doc_seq"]: r["text"] for r in Engine(spark).anonymize(units(spark, texts).repartition(n), "reversible").units.collect()} for n in (1, 5)]
    assert runs[0] == runs[1]


def test_persons_are_resolved_in_order():
    order = lambda *keys: [i.resolve(tuple(k.split())) for i in [tokens.PersonIndex()] for k in keys]
    assert order("jan novak", "novak", "novak peter") == [1, 1, 1]
    assert order("jan novak", "novak peter", "novak") == [1, 2, 3]


def test_review_and_second_pass(spark):
    engine = Engine(spark)
    u = units(spark, ["Ing. Ján Novák a Novák, mail a@b.sk", "a@b.sk, Projekt Orol"])
    run = engine.anonymize(u, "reversible")
    groups = {r["base"]: r for r in run.groups.collect()}
    assert (groups["EMAIL_001"]["count"], groups["EMAIL_001"]["files"], groups["OSOBA_001"]["variants"]) == (2, [0, 1], ["Ing. Ján Novák", "Novák"])
    second = engine.reviewed(run, ["EMAIL_001"], [("Projekt Orol", "VLASTNE")]).anonymize(u, "reversible")
    assert [r["text"] for r in second.units.orderBy("doc_seq").collect()] == ["[OSOBA_001] a [OSOBA_001/2], mail a@b.sk", "a@b.sk, [VLASTNE_001]"]


def test_settings():
    assert Config.of({"entities": {"enable": ["LOKALITA"], "disable": ["EMAIL"]}}).entities >= {"LOKALITA"}
    assert Config.of({"deny_list": ["x", {"text": "y", "entity": "OSOBA"}]}).deny_list == (("x", "VLASTNE"), ("y", "OSOBA"))
    with pytest.raises(ValueError):
        Config.of({"nonsense": 1})
