"""Language ID by hierarchical discrimination (operator 6): a linear classifier picks the language family, then one-versus-one
linear support vector machines tell the languages of that family apart.

Features are hashed character 1- to 3-grams of the whole lower-cased text, as square roots of their counts, scaled to length 1.
Models are fitted on a bounded sample of labelled documents; only their features come to the driver.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, small_batches, unused

#: Features; labelled documents a language, and in all, that are fitted on at most, those of least hash. All labelled languages are learned.
DIMS, PER_LANGUAGE, FIT_ROWS = 2048, 400, 25_600
#: The stage takes a text of a lesser score as being in none of the languages, and a label as wrong if another language has this score.
MIN_SCORE, SURE = 0.6, 0.99
#: Families by ISO 639-1 code; a language that is not listed is in the family "other".
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi", "romance": "fr es it pt ro ca gl oc la", "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "baltic": "lt lv", "uralic": "fi et hu", "turkic": "tr az kk uz ky tk", "celtic": "ga gd cy br", "indic": "hi ur bn mr gu pa ne si", "semitic": "ar he am mt", "sinitic": "zh", "japonic": "ja", "koreanic": "ko", "hellenic": "el", "iranian": "fa ps ku",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
#: Code points worked on at a time.
PIECE = 1 << 18


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").partition("-")[0], "other")


def features(text: str | None) -> np.ndarray | None:
    """None for null and for texts without a letter."""
    if not text or not any(c.isalpha() for c in text[:64]) and not any(map(str.isalpha, text)):
        return None
    total = np.zeros(DIMS, dtype=np.int64)
    low = " " + text.lower() + " "
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for a in range(0, len(c), PIECE):
        x = c[a : a + PIECE + 2]  # grams begin in the piece
        m = min(PIECE, len(x))
        one = x * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (x[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
        three = (two[:-1] ^ (x[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        for h in (one[:m], two[:m], three[:m]):
            total += np.bincount((h >> np.uint32(21)).astype(np.int64), minlength=DIMS)
    v = np.sqrt(total.astype(np.float32))
    return v / np.linalg.norm(v)


def svm(x: np.ndarray, y: np.ndarray, epochs: int = 30, lam: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM, y being -1 or 1, both classes weighing the same: averaged subgradient steps over batches in a fixed order."""
    rng = np.random.default_rng(3)
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w = np.zeros(x1.shape[1])
    mean, n, t = np.zeros_like(w), 0, 0
    for e in range(epochs):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            t += 1
            rate = 1 / (lam * (t + 200))
            hinge = y[at] * (x1[at] @ w) < 1
            grad = lam * w - ((y[at] * weight[at])[hinge] @ x1[at][hinge]) / len(at)
            w -= min(rate, 20.0) * grad
            if e >= epochs // 2:
                mean += w
                n += 1
    w = mean / max(n, 1)
    return w[:-1], float(w[-1])


@dataclass
class Model:
    families: list[str]
    languages: dict[str, list[str]]
    family_w: np.ndarray  # one row a family, one-versus-rest
    family_b: np.ndarray
    pairs: dict[str, list[tuple[int, int, np.ndarray, float]]]

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        f, p = 0, 1.0
        if len(self.families) > 1:
            z = self.family_w @ v + self.family_b
            f = int(np.argmax(z))
            p = float(1 / np.exp(np.clip(3 * (z - z[f]), -60, 0)).sum())
        langs = self.languages[self.families[f]]
        if len(langs) == 1:
            return langs[0], p
        votes = np.zeros((len(langs), 2))
        for i, j, w, b in self.pairs[self.families[f]]:
            m = float(w @ v + b)
            votes[i if m > 0 else j, 0] += 1
            votes[i, 1] += m
            votes[j, 1] -= m
        k = max(range(len(langs)), key=lambda n: (votes[n, 0], votes[n, 1], -n))
        won = [1 / (1 + np.exp(-np.clip(3 * (m if i == k else -m), -60, 60))) for i, j, m in ((i, j, float(w @ v + b)) for i, j, w, b in self.pairs[self.families[f]]) if k in (i, j)]
        return langs[k], p * float(np.mean(won))


def fit(x: np.ndarray, langs: list[str]) -> Model | None:
    """None without labelled documents."""
    if not len(langs):
        return None
    y = np.array(langs)
    by: dict[str, list[str]] = {}
    for code in sorted(set(langs)):
        by.setdefault(family(code), []).append(code)
    names = sorted(by)
    of = np.array([family(code) for code in langs])
    one = [svm(x, np.where(of == f, 1.0, -1.0)) for f in names] if len(names) > 1 else []
    pairs = {f: [(i, j, *svm(x[at], np.where(y[at] == by[f][i], 1.0, -1.0))) for i, j in itertools.combinations(range(len(by[f])), 2) for at in [np.flatnonzero((y == by[f][i]) | (y == by[f][j]))]] for f in names}
    return Model(names, by, np.array([w for w, _ in one]), np.array([b for _, b in one]), pairs)


def learn(spark: SparkSession, labelled: DataFrame) -> Model | None:
    """A model from (text, lang): of each language at most PER_LANGUAGE rows, or its even part of FIT_ROWS if there are very many, chosen by a hash of the text."""
    small_batches(spark)
    scratch = Scratch(spark, "langid")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("langid"), "text"), 11).cast("double") / float(2**53)
    labelled = labelled.select("text", "lang", draw.alias("u"))
    tally = scratch.table(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("least")), "tally")
    languages = tally.count()
    if not languages:
        return None
    per = min(PER_LANGUAGE, max(1, FIT_ROWS // languages))
    # a share of rows that gives somewhat over `per` of them, and one at least; the exact number is cut below
    share = tally.select(F.col("lang").alias("l_"), F.greatest("least", 1.31 * per / F.col("n")).alias("share"))
    some = labelled.join(bounded(share, 64), F.col("lang") == F.col("l_")).where("u <= share").select("text", "lang", "u")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(lang, u, v) for text, lang, u in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), b.column("u").to_pylist(), strict=True) if (v := features(text)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2].astype(np.float32).tobytes() for g in got], pa.binary())], ["lang", "u", "v"])

    table = scratch.table(some.mapInArrow(make, "lang string, u double, v binary"), "sample")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("u", "v"))
    rows = table.withColumn("k", place).where(F.col("k") <= per).select("lang", "v").orderBy("lang", "k").collect()
    if not rows:
        return None
    return fit(np.stack([np.frombuffer(r["v"], np.float32) for r in rows]), [r["lang"] for r in rows])


def predict(spark: SparkSession, docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs without its text, with lang_pred and score; columns of docs with these names get underscores. `und` and 0 for null, for texts without a letter, and where there is no model."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # languages^2 x DIMS numbers at most
    own = [c for c in docs.columns if c != text_col]
    names = unused(["lang_pred", "score"], *own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [("und", 0.0) if shared.value is None or (v := features(t.as_py())) is None else shared.value.predict(v) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], [*names, "lang_pred", "score"])

    schema = ", ".join([f"`{n}` {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, own, strict=True)] + ["lang_pred string, score double"])
    return docs.select(text_col, *own).mapInArrow(run, schema)


def fold(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds held_out: crc32 of the id as text, modulo 5, is 0. A null id is the empty text."""
    return docs.withColumn("held_out", F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    Learned from texts and non-null lang of documents that are not held out; lang, source and doc_id are no inputs of a prediction. Nulls: a
    null text is `und`; a null lang is not learned from. Equal texts get equal predictions; repeated rows are predicted each; ties go to the first language of a family
    by code. Empty tables give no rows. Long texts are counted whole, piece by piece."""
    docs = fold(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    model = learn(spark, docs.where("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL").select("text", "lang"))
    return predict(spark, docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are in one of the languages, as their text tells; `lang` is the predicted one where it was null or where that is sure.

    Those go that have no letter, or score below MIN_SCORE: no family claims the text, or its languages do about alike. Learned and predicted
    as by query(). Nulls: a null text goes; a null id is in no way special. Equal texts stay or go together; repeated rows each. Empty
    tables give no rows; without any label all rows go. Other columns are kept as they are, whatever their names. Long texts are counted whole."""
    folded = fold(docs.select("doc_id", "text", "lang"))
    model = learn(spark, folded.where("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL").select("text", "lang"))
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("lang")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [("und", 0.0) if shared.value is None or (v := features(t.as_py())) is None else shared.value.predict(v) for t in b.column("text")]
            lang = [p if old is None or score >= SURE else old for old, (p, score) in zip(b.column("lang").to_pylist(), found, strict=True)]
            out = b.set_column(at, b.schema.field(at), pa.array(lang, b.schema.field(at).type))
            yield out.filter(pa.array([p != "und" and score >= MIN_SCORE for p, score in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
