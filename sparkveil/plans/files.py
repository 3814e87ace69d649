"""Runs over files: anonymise, restore, scan."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import review, rewrite
from ..operators.tokens import token_of
from ..sources import documents
from ..sources.files import collect, output_name
from .engine import Engine
from .tables import apart, discard, written


def _units(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    all_ = written(documents.units(files), "units")
    return all_.where("error IS NULL"), all_.where("error IS NOT NULL").select("doc_seq", "error")


def anonymize_files(spark: SparkSession, inputs: list[str], mode: str, cfg: Config | None = None, vault: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, dict[str, DataFrame] | None]:
    """(files, findings, vault): doc_seq, name, content, warnings, error of the written files; a row a replacement; and in reversible mode the vault.
    A file that fails has an error and no content; the others go on. In irreversible mode no table with originals is left."""
    files = collect(spark, inputs)
    with apart() as texts:
        units, _ = _units(files)
    engine = Engine(spark, cfg)
    run = engine.anonymize(units.select("doc_seq", "unit_seq", "where", "text"), mode, vault)
    reps = written(run.units.where("size(reps) > 0").select("doc_seq", "unit_seq", "where", "reps"), "reps")
    out = written(documents.write(files, reps), "files")
    named = reps.join(files.select("doc_seq", "name"), "doc_seq")
    discard(spark, texts)
    if mode == "irreversible":
        run.discard()
    return out.withColumn("name", output_name(F.col("name"), "anonymized")), review.findings(named), run.vault


def restore_files(spark: SparkSession, inputs: list[str], vault: dict[str, DataFrame]) -> DataFrame:
    """doc_seq, name, content, restored, error: the files with known tokens replaced by what they stand for. A file whose SHA-256 the vault holds is replaced by its original (restored -1)."""
    files = collect(spark, inputs)
    units, _ = _units(files)
    hits = _token_places(units)
    reps = hits.join(token_of(vault["variants"]), "token").groupBy("doc_seq", "unit_seq").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("original").alias("token")))).alias("reps"))
    reps = written(reps, "reps")
    out = documents.write(files, reps, scrub=False)
    n = reps.groupBy("doc_seq").agg(F.sum(F.size("reps")).alias("restored"))
    out = out.join(n, "doc_seq", "left").withColumn("restored", F.coalesce("restored", F.lit(0)).cast("long"))
    if "originals" in vault:
        whole = files.select("doc_seq", F.sha2("content", 256).alias("sha256")).join(vault["originals"].withColumnRenamed("content", "original"), "sha256").drop("sha256")
        out = out.join(whole, "doc_seq", "left").withColumn("restored", F.when(F.col("original").isNotNull(), -1).otherwise(F.col("restored")).cast("long")).withColumn("error", F.expr("CASE WHEN original IS NULL THEN error END")).withColumn("content", F.coalesce("original", "content")).drop("original")
    return out.withColumn("name", output_name(F.col("name"), "restored"))


def _token_places(units: DataFrame) -> DataFrame:
    """doc_seq, unit_seq, token, start, end of what looks like a token."""
    hits = f"regexp_extract_all(text, r'{rewrite._JAVA_TOKEN}', 0)"
    gaps = f"split(text, r'{rewrite._JAVA_TOKEN}', -1)"
    rows = units.select("doc_seq", "unit_seq", F.expr(f"transform({hits}, (h, i) -> struct(h AS token, aggregate(slice({gaps}, 1, i + 1), 0, (a, g) -> a + length(g)) + aggregate(slice({hits}, 1, i), 0, (a, x) -> a + length(x)) AS start))").alias("hs"))
    return rows.select("doc_seq", "unit_seq", F.explode("hs").alias("h")).select("doc_seq", "unit_seq", "h.token", "h.start", F.expr("h.start + length(h.token)").alias("end"))


def with_originals(vault: dict[str, DataFrame], files: DataFrame, out: DataFrame) -> dict[str, DataFrame]:
    """The vault with the originals of rewritten files that cannot be restored by tokens, under the SHA-256 of what was written."""
    pairs = out.where("content IS NOT NULL").select("doc_seq", F.sha2("content", 256).alias("sha256")).join(files.select("doc_seq", "content"), "doc_seq")
    return {**vault, "originals": pairs.select("sha256", "content")}


def protocol(findings: DataFrame) -> DataFrame:
    """name, entity, n: replacements by file and type, by type (name null) and of all, the most frequent first within each."""
    return findings.groupingSets([["name", "entity"], ["entity"], []], "name", "entity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("name").asc_nulls_last(), F.desc("n"), "entity")


def archive(out: DataFrame, findings: DataFrame, path: str) -> None:
    """A ZIP with the written files and protokol.txt, the counts by file and type. Files are added one by one as they come."""
    lines: dict[str | None, list[str]] = {}
    for r in protocol(findings).toLocalIterator():
        lines.setdefault(r["name"], []).append(f"  {r['entity'] or 'spolu'}: {r['n']}")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for r in out.toLocalIterator():
            if r["content"] is not None:
                z.writestr(r["name"], bytes(r["content"]))
        z.writestr("protokol.txt", "\n".join(x for name, rows in lines.items() for x in [name or "Spolu", *rows]))


def save(out: DataFrame, folder: str) -> list[tuple[str, str | None, list[str]]]:
    """Writes files one by one as they come, never all at once; (name, error, warnings) of each."""
    where = Path(folder)
    where.mkdir(parents=True, exist_ok=True)
    told = []
    for r in out.toLocalIterator():
        if r["error"] is None and r["content"] is not None:
            (where / r["name"]).write_bytes(bytes(r["content"]))
        told.append((r["name"], r["error"], list(r["warnings"] or ())))
    return told

