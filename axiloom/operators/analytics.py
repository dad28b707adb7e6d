"""Analyses on results: constraint fields, sustainable area and index, modal lines, presence, indicators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axiloom.functions.distributions import Distribution, column_cdf, poisson_cdf, student_ppf


def satisfaction(usage: Column, capacity: Distribution | Column | float) -> Column:
    """The probability that usage stays within capacity: 1 - cdf for a distribution, else 1 or 0."""
    if hasattr(capacity, "cdf"):
        return F.lit(1.0) - column_cdf(capacity, usage)
    return (usage <= capacity).cast("double")


def field(frame: DataFrame, keys: Sequence[str], weight: str, satisfied: Sequence[str], out: str = "field") -> DataFrame:
    """Per grid point, each constraint's weighted satisfaction over scenarios, and ``out``, their product.

    One groupBy for all constraints, with sums combined before the shuffle."""
    total = F.sum(weight)
    df = frame.groupBy(*keys).agg(*[(F.sum(F.col(weight) * F.col(c)) / total).alias(c) for c in satisfied])
    product = F.col(satisfied[0])
    for c in satisfied[1:]:
        product = product * F.col(c)
    return df.withColumn(out, product)


def sustainable_area(grid: DataFrame, value: str, steps: Sequence[tuple[float, int]]) -> DataFrame:
    """The sum of the field times the size of a grid cell: for each axis, (largest value, number of points)."""
    cell = float(np.prod([top / (n - 1) + 1 for top, n in steps]))
    return grid.agg((F.sum(value) * cell).alias("area"))


def bilinear(grid: DataFrame, samples: DataFrame, x: str, y: str, value: str, steps: tuple[float, float], sizes: tuple[int, int]) -> DataFrame:
    """``samples`` with ``value`` interpolated from a regular grid (i, j, value) that starts at 0; 0 outside of it."""
    gx, gy = F.col(x) / steps[0], F.col(y) / steps[1]
    inside = (gx >= 0) & (gy >= 0) & (gx <= sizes[0] - 1) & (gy <= sizes[1] - 1)
    at = samples.withColumns({"_id": F.monotonically_increasing_id(), "_in": inside})
    at = at.withColumns({"_i": F.least(F.floor(gx), F.lit(sizes[0] - 2)).cast("int"), "_j": F.least(F.floor(gy), F.lit(sizes[1] - 2)).cast("int")})
    at = at.withColumns({"_fx": gx - F.col("_i"), "_fy": gy - F.col("_j")})
    corner = F.inline(F.array(*[F.struct(F.lit(a).alias("_a"), F.lit(b).alias("_b")) for a in (0, 1) for b in (0, 1)]))
    each = at.select("*", corner)
    part = F.when(F.col("_a") == 1, F.col("_fx")).otherwise(1 - F.col("_fx")) * F.when(F.col("_b") == 1, F.col("_fy")).otherwise(1 - F.col("_fy"))
    named = grid.select(F.col("i").alias("_gi"), F.col("j").alias("_gj"), F.col(value).alias("_g"))
    met = each.join(named, (F.col("_gi") == F.col("_i") + F.col("_a")) & (F.col("_gj") == F.col("_j") + F.col("_b")), "left")
    summed = met.groupBy("_id", *samples.columns).agg(F.coalesce(F.sum(F.when(F.col("_in"), part * F.col("_g"))), F.lit(0.0)).alias(value))
    return summed.drop("_id")


def index_with_confidence(samples: DataFrame, value: str, n: int, confidence: float = 0.9) -> DataFrame:
    """The mean of ``value`` over n samples and half the width of its confidence interval."""
    t = student_ppf((1 + confidence) / 2, n - 1)
    return samples.agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value)) * t).alias("half_width"))


def boundary(grid: DataFrame, value: str, level: float = 0.5) -> DataFrame:
    """The cells (i, j) at or under the level that have a neighbour above it, along either axis."""
    above = (F.col(value) > level).cast("int")
    rows, columns = Window.partitionBy("j").orderBy("i"), Window.partitionBy("i").orderBy("j")
    near = F.greatest(*[F.coalesce(f("_above").over(w), F.lit(0)) for w in (rows, columns) for f in (F.lag, F.lead)])
    return grid.withColumn("_above", above).withColumn("_near", near).where("_above = 0 and _near = 1").select("i", "j")


def principal_line(points: DataFrame, x: str = "i", y: str = "j") -> DataFrame:
    """Centre and direction of the first principal axis of the points, in closed form; none for fewer than three."""
    s = points.agg(F.count("*").alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.var_pop(x).alias("sxx"), F.var_pop(y).alias("syy"), F.covar_pop(x, y).alias("sxy"))
    angle = F.atan2(F.col("sxy") * 2, F.col("sxx") - F.col("syy")) / 2
    return s.where("n >= 3").select("n", "cx", "cy", F.cos(angle).alias("dx"), F.sin(angle).alias("dy"))


def modal_line(grid: DataFrame, value: str, steps: tuple[float, float], bounds: tuple[float, float], level: float = 0.5) -> DataFrame:
    """(x0, y0, x1, y1): the first principal axis of the field's boundary cells, clipped to the box from 0 to ``bounds``.

    Cells (i, j) lie ``steps`` apart. No row for fewer than three cells, or if the line misses the box.
    """
    points = boundary(grid, value, level).select((F.col("i") * steps[0]).alias("x"), (F.col("j") * steps[1]).alias("y"))
    line = principal_line(points, "x", "y")
    lows, highs = [], []
    for c, d, top in (("cx", "dx", bounds[0]), ("cy", "dy", bounds[1])):
        slope = F.when(F.abs(d) > 1e-10, F.col(d))  # null along the other axis, which this one does not bound
        ta, tb = -F.col(c) / slope, (F.lit(float(top)) - F.col(c)) / slope
        lows.append(F.least(ta, tb))
        highs.append(F.greatest(ta, tb))
    line = line.withColumns({"_lo": F.greatest(*lows), "_hi": F.least(*highs)}).where("_lo < _hi")
    at = {f"{k}{n}": F.col(f"c{k}") + F.col(t) * F.col(f"d{k}") for n, t in ((0, "_lo"), (1, "_hi")) for k in "xy"}
    return line.select(*[e.alias(k) for k, e in at.items()])


def saturated(presence: Column, level: float, k: float = 3.0) -> Column:
    """Presence that bends off towards ``level``: p * s / (p^k + s^k)^(1/k)."""
    return presence * level / F.pow(F.pow(presence, k) + float(level) ** k, 1 / k)


def share_at_most(mean: Column, k: Column) -> Column:
    """P(X <= k) for a Poisson variable, in Arrow batches."""

    @F.pandas_udf("double")
    def cdf(k: pd.Series, mu: pd.Series) -> pd.Series:
        return pd.Series(poisson_cdf(k.to_numpy(float), mu.to_numpy(float)))

    return cdf(k, mean)


def indicator(value: Column) -> Column:
    """A value as whole number, cut towards zero."""
    return value.cast("bigint")


def split_by_guard(df: DataFrame, selector: str, branches: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each branch on the rows whose selector is its key, and nothing on others; put together by column name."""
    out: DataFrame | None = None
    for key, branch in branches.items():
        part = branch(df.where(F.col(selector) == key))
        out = part if out is None else out.unionByName(part)
    return out
