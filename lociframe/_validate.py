"""Typed argument checks; every failure is a ValueError that names the argument."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def columns(df: DataFrame, names: Iterable[str | None], arg: str = "data") -> None:
    missing = [n for n in names if n is not None and n not in df.columns]
    if missing:
        raise ValueError(f"{arg}: missing columns {missing}")


def choice(value: str, allowed: Sequence[str], arg: str) -> str:
    if value not in allowed:
        raise ValueError(f"{arg} must be one of {list(allowed)}, not {value!r}")
    return value


def number(value, arg: str, low: float | None = None, high: float | None = None, null_ok: bool = False) -> None:
    if value is None and null_ok:
        return
    if isinstance(value, bool) or not isinstance(value, int | float) or (low is not None and value < low) or (high is not None and value > high):
        raise ValueError(f"{arg} must be a number" + (f" from {low}" if low is not None else "") + (f" to {high}" if high is not None else ""))


def string(value, arg: str, null_ok: bool = False) -> None:
    if not (value is None and null_ok) and (not isinstance(value, str) or not value):
        raise ValueError(f"{arg} must be a non-empty string")


def key_pair(key: str | tuple[str, str] | None) -> tuple[str, str] | None:
    """A join key: one name for both sides, or (left name, right name)."""
    return None if key is None else (key, key) if isinstance(key, str) else (key[0], key[1])


def empty(bad: DataFrame, message: str) -> None:
    """Raise if ``bad`` has a row (an eager check of one row)."""
    row = bad.limit(1).collect()
    if row:
        raise ValueError(f"{message}: {row[0].asDict()}")


def determines(df: DataFrame, child: Sequence[str], parent: Sequence[str], arg: str = "data") -> None:
    """Each value of ``child`` has one value of ``parent`` (a functional dependency)."""
    key = [F.col(c) for c in child] or [F.lit(1)]
    n = df.groupBy(*key).agg(F.count_distinct(F.struct(*parent)).alias("n")).where("n > 1")
    empty(n, f"{arg}: {list(child)} must determine {list(parent)}")


def integer_indices(use, names: Sequence[str], arg: str = "use", bool_ok: bool = True) -> list[int]:
    """1-based places in ``names`` chosen by True (all), False (none), names or numbers (one or several)."""
    if isinstance(use, bool):
        if not bool_ok:
            raise ValueError(f"{arg} must be names or numbers")
        return list(range(1, len(names) + 1)) if use else []
    items = [use] if isinstance(use, str | int | float) else list(use)
    if any(x is None or x != x for x in items):
        raise ValueError(f"{arg} cannot contain missing values")
    if items and all(isinstance(x, str) for x in items):
        place = {n: i for i, n in reversed(list(enumerate(names, 1)))}
        if unknown := [x for x in items if x not in place]:
            raise ValueError(f"{arg} contains invalid values {unknown}")
        return [place[x] for x in items]
    if any(isinstance(x, bool | str) or not isinstance(x, int | float) for x in items):
        raise ValueError(f"{arg} must be {'one bool, ' if bool_ok else ''}names or numbers")
    if any(not 1 <= x <= len(names) for x in items):
        raise ValueError(f"{arg} contains out-of-bounds places")
    return [int(x) for x in items]
