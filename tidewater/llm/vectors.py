"""What the vector operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: str) -> Column:
    """Not null, finite in every component and not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vec).isNotNull() & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64) if len(column) else np.zeros((0, 0))


def lengths(rows: DataFrame, vec: str) -> list[int]:
    """The vector lengths there are, the most common first; vectors are compared with those of their own length, one run a length."""
    return [r["n"] for r in rows.groupBy(F.size(vec).alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").collect()]


def groups(parts: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of a partition that is sorted by ``keys``; a group may go over several batches."""
    held: list[pd.DataFrame] = []
    for part in parts:
        if not len(part):
            continue
        changes = np.flatnonzero((part[keys] != part[keys].shift()).any(axis=1).to_numpy())
        if held and (part[keys].iloc[0] == held[-1][keys].iloc[-1]).all():
            changes = changes[1:]
        cuts = [0, *[c for c in changes.tolist() if c or held], len(part)]
        cuts = sorted(set(cuts))
        if held and changes.size and changes[0] == 0:
            yield pd.concat(held)
            held = []
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low and held:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part.iloc[low:high])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]
