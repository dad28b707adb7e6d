"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_by_class(rows: DataFrame, label: str, key: Column, per_class: int, most: int | None = None) -> DataFrame:
    """About ``per_class`` rows of each class (all of a smaller one) and ``most`` of all, chosen by a hash of ``key``.

    The classes are counted over all rows; a row is in if its hash, as a share of the hash range, is under
    per_class / count of its class. No sort and no window: a class may hold any share of the rows.
    """
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect() if r[label] is not None}
    if most is not None and counts:
        per_class = max(1, min(per_class, most // len(counts)))
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = F.lit(False)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        chosen = F.when(F.col(label) == F.lit(value), place < F.lit(per_class / n)).otherwise(chosen)
    return rows.where(chosen)
