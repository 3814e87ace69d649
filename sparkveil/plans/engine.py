"""The engine: scan, anonymise, restore and review DataFrames of text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import review, rewrite, tokens
from ..operators.detect import detect
from ..operators.ner import Model
from .tables import apart, discard, spread, written


def as_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_seq, unit_seq, text from a table of texts with integer ids: one unit a document."""
    return spread(docs.select(F.col(id_col).cast("long").alias("doc_seq"), F.lit(0).alias("unit_seq"), F.col(text_col).alias("text")))


@dataclass
class Run:
    units: DataFrame
    spans: DataFrame
    tokens: DataFrame
    vault: dict[str, DataFrame] | None
    folder: str

    def discard(self) -> None:
        """Removes the run's tables of spans, keys and tokens, which hold originals. What is read from the run, the vault too, must be written before."""
        discard(self.units.sparkSession, self.folder)

    @property
    def findings(self) -> DataFrame:
        return review.findings(self.units)

    @property
    def groups(self) -> DataFrame:
        return review.review_groups(self.spans, self.tokens)


class Engine:
    def __init__(self, spark: SparkSession, cfg: Config | None = None, model: Callable[[], Model] | None = None):
        self.spark, self.cfg, self.model = spark, cfg or Config(), model

    def scan(self, units: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """A row a span with its key."""
        return tokens.occurrences(detect(units, self.cfg, known, self.model))

    def anonymize(self, units: DataFrame, mode: str, vault: dict[str, DataFrame] | None = None) -> Run:
        """units with tokens for spans. reversible: the run's vault continues the given one; irreversible: no vault, and no table of originals is kept beyond the run's own tables, which discard() removes."""
        with apart() as folder:
            found = written(self.scan(units, vault["stems"] if vault else None), "spans")
            named = tokens.assign(found, mode, self.cfg.numbered_tokens, vault)
            out = rewrite.apply_tokens(units, found, named)
            kept = tokens.vault_tables(named, vault) if mode == "reversible" else None
        return Run(out, found, named, kept, folder)

    def restore(self, units: DataFrame, vault: dict[str, DataFrame]) -> DataFrame:
        return rewrite.restore(units, tokens.token_of(vault["variants"]))

    def reviewed(self, run: Run, excluded: list[str] = (), added: list[tuple[str, str]] = ()) -> Engine:
        """An engine that leaves alone all variants of the excluded groups (base tokens) and looks for the added terms."""
        off = run.tokens.where(F.col("base").isin(list(excluded))).select("text").distinct().collect()  # of the groups that a person named
        cfg = self.cfg
        return Engine(self.spark, Config(**{**cfg.__dict__, "allow_list": (*cfg.allow_list, *(r["text"] for r in off)), "deny_list": (*cfg.deny_list, *added)}), self.model)
