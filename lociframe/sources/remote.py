"""Thin interfaces to annotation services; the transport is a function of the caller, so nothing here needs a network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def batched(items: Sequence[str], size: int = 10) -> Iterable[list[str]]:
    for at in range(0, len(items), size):
        yield list(items[at : at + size])


def retry(f: Callable, times: int = 10, wait: float = 0.0):
    """``f()`` with up to ``times`` attempts; the last error is raised."""
    for left in range(times - 1, -1, -1):
        try:
            return f()
        except Exception:
            if not left:
                raise
            time.sleep(wait)


def keggdb(spark: SparkSession, ids: Sequence[str], fetch: Callable[[list[str]], list[dict]], size: int = 10) -> DataFrame:
    """Records of ``fetch`` for batches of ids, row-bound with missing columns filled; lists become arrays of strings."""
    out = None
    for part in batched(ids, size):
        rows = fetch(part)
        if not rows:
            continue
        names = list(dict.fromkeys(k for r in rows for k in r))
        kinds = {n: "array<string>" if any(isinstance(r.get(n), list | tuple) for r in rows) else "string" for n in names}
        val = lambda r, n: None if r.get(n) is None else [str(x) for x in r[n]] if kinds[n].startswith("array") and isinstance(r[n], list | tuple) else [str(r[n])] if kinds[n].startswith("array") else str(r[n])  # noqa: B023, E731
        d = spark.createDataFrame([tuple(val(r, n) for n in names) for r in rows], ", ".join(f"`{n}` {kinds[n]}" for n in names))
        if out is not None:
            for n in set(out.columns) & set(d.columns):
                if dict(out.dtypes)[n] != dict(d.dtypes)[n]:
                    out, d = (x if dict(x.dtypes)[n].startswith("array") else x.withColumn(n, F.when(F.col(n).isNotNull(), F.array(n))) for x in (out, d))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing was fetched")
    return out


def get_bm(query: Callable[..., DataFrame], attributes: Sequence[str], split: Sequence[str] | None = None, times: int = 10) -> DataFrame:
    """One query, or one for each attribute of ``split`` (with the others), tried again on failure and bound by position."""
    if not split:
        return retry(lambda: query(list(attributes)), times)
    rest = [a for a in attributes if a not in split]
    out = None
    for s in split:
        d = retry(lambda s=s: query([*rest, s]), times)
        out = d if out is None else out.union(d)
    return out


def snapshot(dates: DataFrame, release: str, column: str = "date") -> DataFrame:
    """One row: the latest date not after ``release``."""
    return dates.agg(F.max(F.when(F.col(column) <= F.lit(release), F.col(column))).alias(column))
