"""Settings of a run, and the catalogue of entity types."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

# fixed values: entity types in the order of reviews, and the names they are shown by
ENTITY_LABELS = {
    "OSOBA": "Meno osoby", "RODNE_CISLO": "Rodné číslo", "DATUM_NARODENIA": "Dátum narodenia", "ADRESA": "Adresa", "TELEFON": "Telefón", "EMAIL": "E-mail", "IBAN": "IBAN", "UCET": "Číslo účtu", "KARTA": "Platobná karta", "ICO": "IČO", "DIC": "DIČ",
    "IC_DPH": "IČ DPH", "DOKLAD": "Číslo dokladu (OP, pas)", "SPZ": "EČV / ŠPZ", "IP_ADRESA": "IP adresa", "ORGANIZACIA": "Organizácia", "LOKALITA": "Lokalita", "VLASTNE": "Vlastný výraz (deny-list)",
}
#: Not data of natural persons: off unless asked for.
OFF_BY_DEFAULT = frozenset({"ORGANIZACIA", "LOKALITA"})
CUSTOM = "VLASTNE"


@dataclass(frozen=True)
class Config:
    threshold: float = 0.5
    entities: frozenset[str] = frozenset(ENTITY_LABELS) - OFF_BY_DEFAULT
    allow_list: tuple[str, ...] = ()
    deny_list: tuple[tuple[str, str], ...] = ()  # (text, entity)
    engine: str = "rules"
    ner_model: str = "crabz/slovakbert-ner"
    ocr_lang: str = "slk+eng"
    pdf_dpi: int = 200
    pdf_ocr: str = "auto"
    pdf_text_layer: bool = True
    numbered_tokens: bool = True
    propagate_names: bool = True
    as_of_year: int | None = None  # the year that birth numbers are checked against; None: today's

    @classmethod
    def of(cls, data: dict | None) -> Config:
        """Settings from a mapping. `entities` is a list, or a mapping with enabled, enable and disable; a plain deny term is of the custom type."""
        got = dict(data or {})
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(got) - known):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        if "entities" in got:
            e = got["entities"]
            on = set(e.get("enabled", cls.entities)) | set(e.get("enable", [])) if isinstance(e, dict) else set(e)
            got["entities"] = frozenset(on - set(e.get("disable", [])) if isinstance(e, dict) else on)
        if "allow_list" in got:
            got["allow_list"] = tuple(got["allow_list"])
        if "deny_list" in got:
            got["deny_list"] = tuple((d["text"], d.get("entity", CUSTOM)) if isinstance(d, dict) else (d, CUSTOM) if isinstance(d, str) else tuple(d) for d in got["deny_list"])
        return cls(**got)

    @classmethod
    def load(cls, path: str | Path | None) -> Config:
        if not path:
            return cls()
        import yaml

        return cls.of(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
