"""Logical columns and their physical names."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# Logical columns with their default physical names.
DEFAULT_NAMES = {
    "BaseDate": "BASE_DT",
    "PortfolioId": "PORTFOLIO_ID",
    "RiskFactor": "RISK_FACTOR",
    "ExposureAmount": "EXPOSURE_AMT",
    "LimitAmount": "LIMIT_AMT",
    "UseYn": "USE_YN",
    "CurrencyCode": "CCY_CD",
    "UnitCode": "UNIT_CD",
}
REQUIRED = ("BaseDate", "PortfolioId", "RiskFactor", "ExposureAmount", "LimitAmount", "UseYn")
# Optional descriptive exposure columns; their names are not mapped.
DESK = "DESK_CD"
PRODUCT = "PRODUCT_TYPE"


@dataclass(frozen=True)
class ColumnMapping:
    names: dict[str, str] = field(default_factory=lambda: dict(DEFAULT_NAMES))
    used_fallback: bool = False
    warnings: tuple[str, ...] = ()

    def physical(self, logical: str) -> str:
        name = self.find(logical)
        if name is None:
            raise ValueError(f"logical column {logical} is not mapped")
        return name

    def find(self, logical: str) -> str | None:
        return (self.names.get(logical) or "").strip() or None


def has_column(df: DataFrame, name: str | None) -> bool:
    return name is not None and name.lower() in {c.lower() for c in df.columns}


def missing_columns(df: DataFrame, names: list[str]) -> list[str]:
    present = {c.lower() for c in df.columns}
    return list(dict.fromkeys(n for n in names if n.lower() not in present))


def mapping_from_json(text: str, label: str = "column mapping") -> ColumnMapping:
    """Mapping from a JSON document ``{"Mappings": {...}}``; defaults plus a warning if unusable."""
    try:
        pairs = json.loads(_relaxed(text), object_pairs_hook=list)
    except ValueError as error:
        return _fallback(f"{label} could not be read: {error}")
    if not isinstance(pairs, list) or not all(isinstance(p, tuple) for p in pairs):
        return _fallback(f"{label} must hold a JSON object")
    body = next((value for name, value in pairs if name.lower() == "mappings"), None)
    if not isinstance(body, list) or not all(isinstance(p, tuple) for p in body):
        return _fallback(f"{label} has no Mappings object")

    known = {name.lower(): name for name in DEFAULT_NAMES}
    names: dict[str, str] = {}
    for logical, physical in body:
        name = known.get(logical.lower())
        if name is None:
            return _fallback(f"{label}: unknown logical column {logical!r}")
        if name in names:
            return _fallback(f"{label}: duplicate logical column {logical!r}")
        if not isinstance(physical, str):
            return _fallback(f"{label}: {logical} must be a string")
        names[name] = physical.strip()
    for required in REQUIRED:
        if not names.get(required):
            return _fallback(f"{label}: required logical column {required} is missing")
    seen: set[str] = set()
    for physical in (p.lower() for p in names.values() if p):
        if physical in seen:
            return _fallback(f"{label}: physical column {physical!r} is mapped twice")
        seen.add(physical)
    return ColumnMapping(names)


def mapping_from_file(path: str) -> ColumnMapping:
    """Mapping from a small JSON file on the driver."""
    try:
        with open(path, encoding="utf-8-sig") as handle:
            return mapping_from_json(handle.read(), path)
    except OSError as error:
        return _fallback(f"{path} was not found: {error.strerror}")


def _fallback(warning: str) -> ColumnMapping:
    return ColumnMapping(dict(DEFAULT_NAMES), True, (warning,))


def _relaxed(text: str) -> str:
    """Drop comments, then trailing commas, outside strings."""
    string = r'"(?:\\.|[^"\\])*"'
    keep = lambda m: m.group(0) if m.group(0).startswith('"') else " "
    plain = re.sub(string + r"|//[^\n]*|/\*.*?\*/", keep, text, flags=re.S)
    return re.sub(string + r"|,(?=\s*[}\]])", keep, plain)
