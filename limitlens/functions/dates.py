"""Strict date parsing and base-date normalisation."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, functions as F

from limitlens.functions.text import WHITE_SPACE, clean


def strict_date(value: Column | str, fmt: str = "yyyy-MM-dd") -> Column:
    """Date in exactly ``fmt``, NULL otherwise."""
    return F.try_to_date(clean(value), fmt)


def normalize_base_date(value: Column | str) -> Column:
    """``yyyyMMdd`` from ``yyyyMMdd`` or ``yyyy-MM-dd``; other text is kept as it is."""
    text = clean(value)
    parsed = F.coalesce(F.try_to_date(text, "yyyyMMdd"), F.try_to_date(text, "yyyy-MM-dd"))
    return F.coalesce(F.date_format(parsed, "yyyyMMdd"), text)


@dataclass(frozen=True)
class BaseDate:
    """A requested base date (a parameter of the job, so it is checked on the driver)."""

    requested: str
    normalized: str
    valid: bool

    @staticmethod
    def of(text: str) -> "BaseDate":
        requested = (text or "").strip(WHITE_SPACE)
        if not requested:
            raise ValueError("base date is blank")
        parsed = _parse_parameter(requested)
        if parsed is None:
            return BaseDate(requested, requested, False)
        return BaseDate(requested, parsed.strftime("%Y%m%d"), True)


def _parse_parameter(text: str) -> date | None:
    for shape, fmt in ((r"[0-9]{8}", "%Y%m%d"), (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "%Y-%m-%d")):
        if re.fullmatch(shape, text):
            try:
                return datetime.strptime(text, fmt).date()
            except ValueError:
                return None
    return None


def search_date(as_of: str | None, today: date | None = None) -> tuple[date, bool]:
    """Search date and whether the request was usable (``yyyy-MM-dd``); today otherwise."""
    fallback = today or date.today()
    text = (as_of or "").strip(WHITE_SPACE)
    if not text:
        return fallback, True
    parsed = _parse_parameter(text) if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text) else None
    return (parsed, True) if parsed else (fallback, False)
