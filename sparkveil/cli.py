"""Command line: anonymize, restore, scan, selftest, entities."""

from __future__ import annotations

import argparse
import getpass
import json
import os
import sys
from dataclasses import replace
from itertools import groupby
from pathlib import Path

from pyspark.sql import SparkSession

from . import vault as vaults
from .config import ENTITY_LABELS, Config
from .plans import files as runs
from .plans.engine import Engine

#: The variable that may hold the passphrase; a typed one has this many characters at least.
PASSPHRASE, LEAST = "VEIL_PASSPHRASE", 12
SAMPLE = "Predávajúci: Ing. Ján Novák, nar. 15. 3. 1980, r. č. 800315/1233, trvalý pobyt: Hlavná 12, 811 01 Bratislava, tel. +421 905 123 456, e-mail jan.novak@example.sk"
EXPECTED = {"OSOBA", "DATUM_NARODENIA", "RODNE_CISLO", "ADRESA", "TELEFON", "EMAIL"}


def passphrase(twice: bool) -> str:
    if given := os.environ.get(PASSPHRASE):
        return given
    typed = getpass.getpass("Passphrase: ")
    if twice and typed != getpass.getpass("Again: "):
        sys.exit("the passphrases differ")
    if len(typed) < LEAST:
        sys.exit(f"a passphrase needs {LEAST} characters")
    return typed


def settings(a: argparse.Namespace) -> Config:
    cfg = Config.load(a.config)
    if a.threshold is not None:
        cfg = replace(cfg, threshold=a.threshold)
    return replace(cfg, numbered_tokens=False) if getattr(a, "no_numbers", False) else cfg


def anonymize(spark: SparkSession, a: argparse.Namespace) -> int:
    path = Path(a.vault or Path(a.output) / "vault.json")
    word, old = None, None
    if a.mode == "reversible":
        word = passphrase(not path.exists())
        old = vaults.load(spark, path, word) if path.exists() else None
    out, findings, new = runs.anonymize_files(spark, a.inputs, a.mode, settings(a), old)
    told = runs.save(out, a.output)
    total = 0
    for name, rows in groupby(findings.orderBy("name", "doc_seq", "unit_seq", "start").toLocalIterator(), lambda r: r["name"]):  # of one file at a time
        found = [{k: r[k] for k in ("where", "entity", "score", "source", "token")} for r in rows]
        total += len(found)
        (Path(a.output) / f"{Path(name).stem}_anonym.report.json").write_text(json.dumps({"file": name, "engine": "rules", "mode": a.mode, "findings": found}, ensure_ascii=False, indent=1), encoding="utf-8")
    if new is not None:
        vaults.save(spark, new, path, word)
    for name, error, warnings in told:
        print(f"{name}: {error or 'written'}", *[f"  ! {w}" for w in warnings], sep="\n", file=sys.stderr if error else sys.stdout)
    print(f"{total} replacements")
    return int(any(error for _, error, _ in told))


def restore(spark: SparkSession, a: argparse.Namespace) -> int:
    out = runs.restore_files(spark, a.inputs, vaults.load(spark, a.vault, passphrase(False)))
    told = runs.save(out, a.output)
    for name, error, _ in told:
        print(f"{name}: {error or 'restored'}")
    return 0


def scan(spark: SparkSession, a: argparse.Namespace) -> int:
    files = runs.collect(spark, a.inputs)
    units = runs.documents.units(files).where("error IS NULL").select("doc_seq", "unit_seq", "text")
    for r in Engine(spark, settings(a)).scan(units).orderBy("doc_seq", "unit_seq", "start").toLocalIterator():
        print(f"{r['doc_seq']:4} {r['entity']:16} {r['score']:.2f} {r['text']!r} [{r['source']}]")
    return 0


def selftest(spark: SparkSession, a: argparse.Namespace) -> int:
    units = spark.createDataFrame([(0, 0, SAMPLE)], "doc_seq long, unit_seq int, text string")
    missing = EXPECTED - {r["entity"] for r in Engine(spark, settings(a)).scan(units).collect()}
    print("OK" if not missing else f"missing: {', '.join(sorted(missing))}")
    return int(bool(missing))


def entities(spark: SparkSession | None, a: argparse.Namespace) -> int:
    print("\n".join(f"{k:16} {v}" for k, v in ENTITY_LABELS.items()))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="sparkveil")
    sub = top.add_subparsers(dest="command", required=True)
    for name, run in (("anonymize", anonymize), ("restore", restore), ("scan", scan), ("selftest", selftest), ("entities", entities)):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("--config")
        p.add_argument("--threshold", type=float)
        if name in ("anonymize", "restore", "scan"):
            p.add_argument("inputs", nargs="+")
        if name in ("anonymize", "restore"):
            p.add_argument("-o", "--output", required=True)
            p.add_argument("--vault", required=name == "restore")
        if name == "anonymize":
            p.add_argument("--mode", choices=["reversible", "irreversible"], required=True)
            p.add_argument("--no-numbers", action="store_true")
    a = top.parse_args(argv)
    return a.run(spark or (None if a.run is entities else SparkSession.builder.appName("sparkveil").getOrCreate()), a)


if __name__ == "__main__":
    sys.exit(main())
