"""Column checks shared by every operator (the data model is by convention)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, cols: Iterable[str], role: str = "column") -> None:
    """Raise ``ValueError`` naming the first missing column."""
    present = set(df.columns)
    for col in cols:
        if col not in present:
            raise ValueError(f"The {role} {col!r} does not exist (have {sorted(present)})")


def as_list(cols) -> list[str]:
    """``None`` -> ``[]``, a single name -> ``[name]``, any iterable -> list."""
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of the same names where NULL matches NULL; the left's columns, then the
    right's others."""
    names = [f"__on_{i}" for i in range(len(on))]
    other = right.withColumnsRenamed(dict(zip(on, names, strict=True)))
    cond = None
    for a, b in zip(on, names, strict=True):
        part = left[a].eqNullSafe(other[b])
        cond = part if cond is None else cond & part
    return left.join(other, cond, how).drop(*names)
