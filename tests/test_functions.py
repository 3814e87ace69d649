import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from sparkveil.functions import patterns
from sparkveil.functions import text as tx
from sparkveil.functions import validators as va


def values(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, v string")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_catalogue_is_whole():
    assert len(patterns.rules()) == 29
    assert (len(patterns.MEN), len(patterns.WOMEN), len(patterns.PERSON_LABELS), len(patterns.ADDRESS_LABELS)) == (96, 92, 57, 13)


def test_fold_keeps_length(spark):
    text = "Ľubomír Ďuriš, Žofia – naïve ÀÉÎÕÜ ß Ł 😀 x̌"
    assert values(spark, [text], tx.fold) == ["".join(unicodedata.normalize("NFD", c)[0] for c in text)]


def test_keys(spark):
    assert values(spark, ["Ján  Novák-Malý_3!", None], tx.norm_key) == ["jannovakmaly3", None]
    assert values(spark, ["+421 905 1"], tx.digits) == ["4219051"]


@pytest.mark.parametrize("word,stem", [("Novák", "novak"), ("Nováka", "novak"), ("Novákovi", "novak"), ("Nováková", "novak~f"), ("Novákovej", "novak~f"), ("Petra", "peter"), ("Pavlovi", "pavol"), ("Oto", "oto"), ("Ova", "ova"), ("Malého", "mal"), ("Karla.", "karol")])
def test_name_stem(spark, word, stem):
    assert values(spark, [word], tx.name_stem) == [stem]


def test_stem_is_that_of_endings_tried_in_order(spark):
    def model(word):
        w = "".join(unicodedata.normalize("NFD", c)[0] for c in word).lower().strip(".,")
        for e in tx.FEMALE_ENDINGS:
            if w.endswith(e) and len(w) >= len(e) + 2:
                return w[: -len(e)] + "~f"
        short = next((w[: -len(e)] for e in tx.ENDINGS if w.endswith(e) and len(w) >= len(e) + 3), w)
        return tx.VOWEL_STEMS.get(short, short)

    rng = random.Random(4)
    words = ["".join(rng.choice("aeiouvmkrhyj") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    assert values(spark, words, tx.name_stem) == [model(w) for w in words]


def test_surnames(spark):
    assert values(spark, ["Ing. Ján Novák, PhD.", "Novák", "pán Malý", "x"], tx.surname_stems) == [["novak"], ["novak"], ["mal"], []]


@pytest.mark.parametrize("check,good,bad", [
    (lambda c: va.birth_number(c, 2026), ["800315/1233", "856122/4562", "536231/123"], ["800315/1234", "801332/1234", "12", ""]),
    (va.company_number, ["35757442"], ["35757443", "3575744"]),
    (va.vat_number, ["SK2020123457"], ["SK2020123458", "SK202012345"]),
    (va.tax_number, ["2020123457"], ["5020123457", "202012345"]),
    (va.iban, ["SK24 1100 0000 0026 1234 5678", "DE89370400440532013000"], ["SK24 1101 0000 0026 1234 5678", "SK24", "1234567890123456"]),
    (va.luhn, ["4111 1111 1111 1111", "4111-1111-1111-1111"], ["4111 1111 1111 1112", "0"]),
    (va.ipv4, ["1.2.3.4", "255.255.255.255"], ["1.2.3.256", "127.0.0.1", "0.0.0.0", "01.2.3.4", "1.2.3"]),
    (va.digit_and_letter, ["a1", "ž٣"], ["a", "1", ""]),
])
def test_checks(spark, check, good, bad):
    assert values(spark, [*good, *bad], check) == [True] * len(good) + [False] * len(bad)
    assert values(spark, [None], check) == [None]


def test_first_names_in_all_cases():
    forms = re.compile(patterns.any_of(set().union(*map(patterns.declined, ("Jan", "Peter", "Maria", "Hana", "Hugo", "Rene")))))
    for good in ("Jana", "Petra", "Petrovi", "Marie", "Mariou", "Hane", "Hugovi", "Reneho"[:4], "Reneovi"):
        assert forms.fullmatch(good), good
    assert not forms.fullmatch("Janko") and not forms.fullmatch("Mariy")
    assert re.fullmatch(patterns.any_of(["c. op", "c. op vydany"]), "c. \t op  vydany")
