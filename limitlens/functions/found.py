"""Arrays of what a row was found to hold, and their rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def found_array(items: Sequence[tuple[Column, Column]], element: str) -> Column:
    """The structs whose condition holds, as an array of ``element`` (a DDL type).

    Built by concatenation, which stays in generated code; filtering an array of NULLs
    would be interpreted, and expressions the conditions share would run once per item.
    """
    none = F.array().cast(f"array<{element}>")
    if not items:
        return none
    parts = [F.when(holds, F.array(item)).otherwise(none) for holds, item in items]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def explode_rows(df: DataFrame, keep: Sequence[str], array: Column | str, name: str) -> DataFrame:
    """One row per array element.

    A plain explode would add a filter on the array's size ahead of it, and compute the
    array a second time for that filter.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
