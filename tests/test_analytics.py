import numpy as np
import pytest
from pyspark.sql import functions as F

import axiloom
from axiloom.functions import distributions as dist
from axiloom.operators import analytics


def test_everything_public_is_there():
    assert all(hasattr(axiloom, n) for n in axiloom.__all__)


def test_field_and_satisfaction(spark):
    df = spark.createDataFrame([(p, w, float(p * u)) for p in (1, 2) for w, u in ((0.25, 1.0), (0.75, 3.0))], "p int, w double, u double")
    df = df.withColumns({"a": analytics.satisfaction(F.col("u"), 2.5), "b": analytics.satisfaction(F.col("u"), dist.uniform(0, 8))})
    got = {r["p"]: (r["a"], r["b"], r["field"]) for r in analytics.field(df, ["p"], "w", ["a", "b"]).collect()}
    for p in (1, 2):
        u = np.array([1.0, 3.0]) * p
        a, b = np.average(u <= 2.5, weights=[0.25, 0.75]), np.average(1 - u / 8, weights=[0.25, 0.75])
        np.testing.assert_allclose(got[p], (a, b, a * b))


def test_bilinear(spark):
    grid = spark.createDataFrame([(i, j, float(i * 10 + j)) for i in range(4) for j in range(3)], "i int, j int, v double")
    samples = spark.createDataFrame([(0.0, 0.0), (15.0, 3.0), (30.0, 4.0), (31.0, 0.0), (-1.0, 1.0)], "x double, y double")
    got = {(r["x"], r["y"]): r["v"] for r in analytics.bilinear(grid, samples, "x", "y", "v", (10.0, 2.0), (4, 3)).collect()}
    assert got == {(0.0, 0.0): 0.0, (15.0, 3.0): pytest.approx(16.5), (30.0, 4.0): pytest.approx(32.0), (31.0, 0.0): 0.0, (-1.0, 1.0): 0.0}


def test_modal_line_is_clipped_to_the_box(spark):
    """A field that falls along a slanted line, one that falls along an axis, and one that never falls."""
    for rule in (lambda i, j: 2 * i + j < 14, lambda i, j: j < 4, lambda i, j: True):
        cells = [(i, j, 1.0 if rule(i, j) else 0.0) for i in range(11) for j in range(11)]
        up = {(i, j) for i, j, v in cells if v > 0.5}
        edge = [(i, j) for i, j, _ in cells if (i, j) not in up and up & {(i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)}]
        got = analytics.modal_line(spark.createDataFrame(cells, "i int, j int, v double"), "v", (10.0, 5.0), (100.0, 50.0)).collect()
        if not edge:
            assert not got
            continue
        points = np.array(edge) * [10.0, 5.0]
        centre = points.mean(axis=0)
        axis = np.linalg.svd(points - centre, full_matrices=False)[2][0]
        ends = [sorted((-c / d, (top - c) / d)) for c, d, top in zip(centre, axis, (100.0, 50.0)) if abs(d) > 1e-10]
        want = [tuple(centre + t * axis) for t in (max(e[0] for e in ends), min(e[1] for e in ends))]
        (r,) = got
        np.testing.assert_allclose(sorted([(r["x0"], r["y0"]), (r["x1"], r["y1"])]), sorted(want), atol=1e-6)


def test_boundary_and_line(spark):
    cells = spark.createDataFrame([(i, j, 1.0 if i + j <= 6 else 0.0) for i in range(10) for j in range(10)], "i int, j int, v double")
    edge = analytics.boundary(cells, "v")
    assert {(r["i"], r["j"]) for r in edge.collect()} == {(i, 7 - i) for i in range(8)}
    (line,) = analytics.principal_line(edge).collect()
    assert line["n"] == 8 and line["dx"] * line["dy"] == pytest.approx(-0.5)
    assert analytics.principal_line(edge.limit(2)).count() == 0


def test_interval_presence_and_poisson(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 12)], "v double")
    r = analytics.index_with_confidence(df, "v", 11, 0.95).first()
    x = np.arange(1.0, 12)
    assert r["mean"] == 6 and r["half_width"] == pytest.approx(x.std(ddof=1) / np.sqrt(11) * 2.2281388519649385)
    r = df.select(F.sum(analytics.saturated(F.col("v"), 5.0)).alias("s"), F.sum(analytics.share_at_most(F.col("v"), F.lit(3.0))).alias("p"), analytics.indicator(F.lit(-2.7)).alias("k")).first()
    assert r["s"] == pytest.approx((x * 5 / (x**3 + 125) ** (1 / 3)).sum()) and r["p"] == pytest.approx(dist.poisson_cdf(3.0, x).sum()) and r["k"] == -2
    area = analytics.sustainable_area(df, "v", [(100, 101), (50, 11)]).first()["area"]
    assert area == pytest.approx(66 * 2 * 6)


def test_branches_see_their_rows(spark):
    df = spark.range(6).withColumn("k", F.when(F.col("id") < 2, "a").otherwise("b"))
    out = analytics.split_by_guard(df, "k", {"a": lambda d: d.withColumn("v", F.lit(1)), "b": lambda d: d.withColumn("v", -F.col("id").cast("int"))})
    assert sorted(r["v"] for r in out.collect()) == [-5, -4, -3, -2, 1, 1]
