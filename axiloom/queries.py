"""Queries over the driver's tables: each operator of the engine on data, with the SQL that gives the same rows.

Mapping: line items, suppliers, customers and orders are scenarios (ENSEMBLE) with values bound to columns; hours and
days of events are time; lists of prices, discounts and thresholds are parameters; flags and segments are categories.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axiloom.axes import ENSEMBLE, PARAMETER, TIME, Axis
from axiloom.functions import distributions as dist
from axiloom.functions.registry import adapt
from axiloom.index import CategoricalIndex, ConditionalCategoricalIndex, ConditionalDistributionIndex, ConstIndex, DistributionIndex, GenericIndex, Index, TimeseriesIndex
from axiloom.model import Model, ModelVariant
from axiloom.operators import analytics
from axiloom.operators.evaluate import Evaluation, EvaluationResult
from axiloom.plans import expr
from axiloom.plans.expr import REDUCTIONS, exp, function_call, guards_to_selector, log, maximum, multi_clause_where, piecewise, where
from axiloom.scenario import Scenario
from axiloom.sources.ensembles import CrossProductEnsemble, DistributionEnsemble, EnsembleAxisSpec, FrameEnsemble, PartitionedEnsemble, RowsEnsemble, SideBySide, sample_frame
from axiloom.sources.frames import BoundFrame
from axiloom.streaming.handles import evaluate_incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KIND = Axis("kind", PARAMETER)


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _model(*indexes: GenericIndex) -> Model:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", DeprecationWarning)
        return Model("query", list(indexes))


def _r(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


class Items:
    """Line items as an ensemble: q, p, d, t and the two flags; key is order and line."""

    def __init__(self, spark: SparkSession, sf: str):
        self.q, self.p, self.d, self.t = (Index(n, None) for n in "qpdt")
        self.flag, self.status = (Index(n, None) for n in ("flag", "status"))
        df = _t(spark, sf, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
        names = {self.q: "l_quantity", self.p: "l_extendedprice", self.d: "l_discount", self.t: "l_tax", self.flag: "l_returnflag", self.status: "l_linestatus"}
        self.ensemble = FrameEnsemble(df, "k", None, names, "item")

    def table(self, overrides=None, functions=None, **named) -> DataFrame:
        indexes = {k: v if isinstance(v, GenericIndex) else Index(k, v) for k, v in named.items()}
        model = _model(*self.ensemble.columns, *indexes.values())
        result = Evaluation(Scenario(model, overrides)).evaluate(list(indexes.values()), ensemble=self.ensemble, functions=functions)
        return result.table(**indexes).withColumnRenamed("e_item", "k").drop("w_e_item")


_KEY = "l_orderkey * 10 + l_linenumber AS k"


@query(f"SELECT {_KEY}, round(l_extendedprice * (1 - l_discount) + l_tax - l_quantity, 6) AS a, round(-(l_extendedprice - 2 * l_quantity), 6) AS b FROM lineitem")
def q_arithmetic(spark, sf):
    i = Items(spark, sf)
    return i.table(a=i.p * (1 - i.d) + i.t - i.q, b=-(i.p - 2 * i.q)).select("k", _r("a").alias("a"), _r("b").alias("b"))


@query(f"SELECT {_KEY}, l_extendedprice / (l_quantity - 1) AS ratio, (l_quantity - 2) / (l_quantity - 1) AS small FROM lineitem")
def q_divide_ieee(spark, sf):
    i = Items(spark, sf)
    return i.table(ratio=i.p / (i.q - 1), small=(i.q - 2) / (i.q - 1))


@query(f"SELECT {_KEY}, round(pow(l_quantity, 2), 6) AS square, round(exp(l_extendedprice / 1000.0 * ln(0.5)), 9) AS half_life, CASE WHEN l_discount = 0 THEN '-inf'::DOUBLE ELSE round(ln(l_discount), 9) END AS logged, greatest(l_discount, l_tax) AS larger FROM lineitem")
def q_power_exp_log_max(spark, sf):
    i = Items(spark, sf)
    df = i.table(square=i.q**2, half_life=exp(i.p / 1000.0 * math.log(0.5)), logged=log(i.d), larger=maximum(i.d, i.t))
    logged = F.when(F.col("logged") == float("-inf"), F.col("logged")).otherwise(_r("logged", 9))
    return df.select("k", _r("square").alias("square"), _r("half_life", 9).alias("half_life"), logged.alias("logged"), "larger")


@query(f"SELECT {_KEY}, (l_quantity = 10)::INT AS eq, (l_quantity <> 10)::INT AS ne, (l_discount < l_tax)::INT AS lt, (l_discount <= l_tax)::INT AS le, (l_discount > l_tax)::INT AS gt, (l_discount >= l_tax)::INT AS ge, (l_returnflag = 'R')::INT AS returned FROM lineitem")
def q_compare(spark, sf):
    i = Items(spark, sf)
    df = i.table(eq=i.q == 10, ne=i.q != 10, lt=i.d < i.t, le=i.d <= i.t, gt=i.d > i.t, ge=i.d >= i.t, returned=i.flag == "R")
    return df.select("k", *[F.col(c).cast("int").alias(c) for c in df.columns if c != "k"])


@query(f"""WITH x AS (SELECT {_KEY}, CASE WHEN l_quantity = 1 THEN 'nan'::DOUBLE ELSE l_discount END AS v FROM lineitem)
    SELECT k, (NOT isnan(v) AND v = v)::INT AS eq, (isnan(v) OR v <> v)::INT AS ne, (NOT isnan(v) AND v > 0.05)::INT AS gt, (isnan(v) OR v <> 0)::INT AS truth FROM x""")
def q_compare_nan(spark, sf):
    i = Items(spark, sf)
    v = where(i.q == 1, float("nan"), i.d)
    df = i.table(eq=v == v, ne=v != v, gt=v > 0.05, truth=v & True)
    return df.select("k", *[F.col(c).cast("int").alias(c) for c in ("eq", "ne", "gt", "truth")])


@query(f"SELECT {_KEY}, (l_quantity > 25 AND l_discount > 0.05)::INT AS both, (l_quantity > 25 OR l_discount > 0.05)::INT AS some, ((l_quantity > 25) <> (l_discount > 0.05))::INT AS one, (NOT (l_discount <> 0))::INT AS none FROM lineitem")
def q_logical(spark, sf):
    i = Items(spark, sf)
    a, b = i.q > 25, i.d > 0.05
    df = i.table(both=a & b, some=a | b, one=a ^ b, none=~i.d.node)
    return df.select("k", *[F.col(c).cast("int").alias(c) for c in ("both", "some", "one", "none")])


@query(f"SELECT {_KEY}, CASE WHEN l_quantity > 25 THEN l_extendedprice ELSE -1 END AS v FROM lineitem")
def q_where(spark, sf):
    i = Items(spark, sf)
    return i.table(v=where(i.q > 25, i.p, -1))


@query(f"SELECT {_KEY}, CASE WHEN l_quantity < 10 THEN 1.0::DOUBLE WHEN l_quantity < 30 THEN l_discount ELSE l_tax END AS v, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS name FROM lineitem")
def q_piecewise(spark, sf):
    i = Items(spark, sf)
    name = guards_to_selector([("low", i.q < 10), ("mid", i.q < 30), ("high", True)])
    return i.table(v=piecewise((1.0, i.q < 10), (i.d, i.q < 30), (i.t, True), (99.0, i.q > 0)), name=name)


@query(f"SELECT {_KEY}, CASE WHEN l_discount > 0.08 THEN 3 WHEN l_discount > 0.04 THEN 2 ELSE 1 END::BIGINT AS v FROM lineitem")
def q_multi_clause(spark, sf):
    i = Items(spark, sf)
    return i.table(v=multi_clause_where([(i.d > 0.08, 3), (i.d > 0.04, 2)], 1))


@query(f"SELECT {_KEY}, CASE WHEN l_quantity < 10 THEN l_tax ELSE 'nan'::DOUBLE END AS v FROM lineitem")
def q_piecewise_nan_default(spark, sf):
    i = Items(spark, sf)
    return i.table(v=piecewise((i.t, i.q < 10)))


# time


def _hours(spark: SparkSession, sf: str) -> tuple[TimeseriesIndex, BoundFrame]:
    """Hourly sums of events by kind: a series over 24 hours for each kind."""
    e = _t(spark, sf, "events")
    df = e.groupBy(F.col("event_type").alias("kind"), F.hour("ts").alias("hour")).agg(F.round(F.sum("value"), 2).alias("value"))
    return TimeseriesIndex("hourly", None), BoundFrame(df, {KIND: "kind", TIME: "hour"})


_HOURS = "h AS (SELECT event_type AS kind, hour(ts)::INT AS hour, round(sum(value), 2) AS v FROM events GROUP BY 1, 2)"


def _series_result(spark: SparkSession, sf: str, **named) -> EvaluationResult:
    s, bound = named.pop("_source")
    return Evaluation(Scenario(_model(s, *named.values()))).evaluate(list(named.values()), frames={s: bound})


_REDUCE_SQL = {
    "sum": "round(sum(v), 6)", "mean": "round(avg(v), 6)", "min": "round(min(v), 6)", "max": "round(max(v), 6)", "std": "round(stddev_pop(v), 6)", "var": "round(var_pop(v), 3)",
    "median": "round(median(v), 6)", "prod": "round(product(1 + v / 100000.0), 6)", "any": "bool_or(v > 900)::INT", "all": "bool_and(v > 100)::INT", "count_nonzero": "count_if(v > 500)::BIGINT", "quantile": "round(quantile_cont(v, 0.9), 6)",
}


def _register_reduction(kind: str) -> None:
    @query(f"WITH {_HOURS} SELECT kind, {_REDUCE_SQL[kind]} AS value FROM h GROUP BY kind", name=f"q_ts_{kind}")
    def run(spark, sf):
        s, bound = _hours(spark, sf)
        of = {"prod": 1 + s / 100000.0, "any": s > 900, "all": s > 100, "count_nonzero": s > 500}.get(kind, s.node)
        out = Index("out", expr.reduce(kind, of, TIME, 0.9 if kind == "quantile" else None))
        df = _series_result(spark, sf, out=out, _source=(s, bound)).frame(out)
        value = F.col("value").cast("int") if kind in ("any", "all") else F.col("value") if kind == "count_nonzero" else _r("value", 3 if kind == "var" else 6)
        return df.select(F.col("p_kind").alias("kind"), value.alias("value"))


for _kind in REDUCTIONS:
    _register_reduction(_kind)


@query(f"WITH {_HOURS} SELECT kind, hour, round(v / sum(v) OVER (PARTITION BY kind), 9) AS share FROM h")
def q_keepdims_share(spark, sf):
    s, bound = _hours(spark, sf)
    share = Index("share", s / s.sum())
    df = _series_result(spark, sf, share=share, _source=(s, bound)).frame(share)
    return df.select(F.col("p_kind").alias("kind"), F.col("d_time").alias("hour"), _r("value", 9).alias("share"))


@query(f"WITH {_HOURS}, m AS (SELECT kind, median(v) AS m, max(v) AS x FROM h GROUP BY kind) SELECT kind, round(sum(greatest(v - m, 0)), 5) AS over_median, round(max(x), 6) AS top FROM h JOIN m USING (kind) GROUP BY kind")
def q_nested_reduction(spark, sf):
    s, bound = _hours(spark, sf)
    over = Index("over_median", expr.reduce("sum", maximum(s - s.median(), 0), TIME))
    top = Index("top", expr.reduce("median", s.max(), TIME))
    df = _series_result(spark, sf, over=over, top=top, _source=(s, bound)).table(over_median=over, top=top)
    return df.select(F.col("p_kind").alias("kind"), _r("over_median", 5).alias("over_median"), _r("top").alias("top"))


@query(f"WITH {_HOURS}, x AS (SELECT kind, hour, v, lag(v) OVER w AS a, lead(v) OVER w AS b FROM h WINDOW w AS (PARTITION BY kind ORDER BY hour)) SELECT kind, hour, round((coalesce(a, 0) + v + coalesce(b, 0)) / 3, 6) AS smooth FROM x")
def q_udf_series(spark, sf):
    s, bound = _hours(spark, sf)
    smooth = Index("smooth", function_call("smooth", s))
    r = Evaluation(Scenario(_model(s, smooth))).evaluate([smooth], frames={s: bound}, functions={"smooth": adapt(lambda a: np.convolve(a, np.ones(3) / 3, "same"), "series")})
    return r.frame(smooth).select(F.col("p_kind").alias("kind"), F.col("d_time").alias("hour"), _r("value").alias("smooth"))


def solve_circular(x: np.ndarray, rounds: int = 50) -> np.ndarray:
    """A load that spills to the next time step, around the day, until it settles."""
    s = x.astype(float)
    for _ in range(rounds):
        mu = 1 + 3 * s.sum() / 2_200_368.245435709
        s = x + np.roll(s, 1) * (mu - 1) / mu
    return s


_MU = "(1 + 3 * list_sum(s) / 2200368.245435709::DOUBLE)"


@query(f"""WITH RECURSIVE {_HOURS}, it(kind, n, hours, x, s) AS (
    SELECT kind, 0, list(hour ORDER BY hour), list(v::DOUBLE ORDER BY hour), list(v::DOUBLE ORDER BY hour) FROM h GROUP BY kind
    UNION ALL SELECT kind, n + 1, hours, x, list_transform(x, lambda v, i: v + s[CASE WHEN i = 1 THEN len(s) ELSE i - 1 END] * ({_MU} - 1) / {_MU}) FROM it WHERE n < 50),
    r AS (SELECT kind, unnest(hours) AS hour, unnest(s) AS s FROM it WHERE n = 50) SELECT kind, hour, round(s, 4) AS load FROM r""")
def q_udf_series_solver(spark, sf):
    s, bound = _hours(spark, sf)
    out = Index("load", function_call("solve", s))
    r = Evaluation(Scenario(_model(s, out))).evaluate([out], frames={s: bound}, functions={"solve": adapt(solve_circular, "series")})
    return r.frame(out).select(F.col("p_kind").alias("kind"), F.col("d_time").alias("hour"), _r("value", 4).alias("load"))


# parameters and ensembles


class Suppliers:
    """Suppliers as scenarios weighted by their number of line items; price and quantity are averages."""

    def __init__(self, spark: SparkSession, sf: str):
        df = _t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").cast("double").alias("w"), F.round(F.avg("l_extendedprice"), 2).alias("price"), F.round(F.avg("l_quantity"), 4).alias("qty"))
        self.price, self.qty, self.discount, self.threshold = (Index(n, None) for n in ("price", "qty", "discount", "threshold"))
        self.ensemble = FrameEnsemble(df, "l_suppkey", "w", {self.price: "price", self.qty: "qty"}, "supplier")


_SUPP = "s AS (SELECT l_suppkey AS k, count(*)::DOUBLE AS w, round(avg(l_extendedprice), 2) AS price, round(avg(l_quantity), 4) AS qty FROM lineitem GROUP BY 1)"


@query(f"WITH {_SUPP}, p(i, d) AS (VALUES (0, 0.0), (1, 0.05), (2, 0.1)) SELECT i AS discount_pos, round(sum(w * price * (1 - d)) / sum(w), 6) AS value FROM s, p GROUP BY i")
def q_expected_value(spark, sf):
    s = Suppliers(spark, sf)
    revenue = Index("revenue", s.price * (1 - s.discount))
    r = Evaluation(Scenario(_model(s.price, s.discount, revenue))).evaluate([revenue], ensemble=s.ensemble, parameters={s.discount: [0.0, 0.05, 0.1]})
    return r.expected_frame(revenue).select(F.col("p_discount").alias("discount_pos"), _r("value").alias("value"))


@query(f"WITH {_SUPP}, p(i, d) AS (VALUES (0, 0.0), (1, 0.05), (2, 0.1)) SELECT i AS discount_pos, k, round(price * (1 - d), 6) AS value FROM s, p")
def q_param_grid_1d(spark, sf):
    s = Suppliers(spark, sf)
    revenue = Index("revenue", s.price * (1 - s.discount))
    r = Evaluation(Scenario(_model(s.price, s.discount, revenue))).evaluate([revenue], ensemble=s.ensemble, parameters={s.discount: [0.0, 0.05, 0.1]})
    return r.frame(revenue).select(F.col("p_discount").alias("discount_pos"), F.col("e_supplier").alias("k"), _r("value").alias("value"))


@query(f"WITH {_SUPP}, p(i, d) AS (VALUES (0, 0.0), (1, 0.05), (2, 0.1)), t(j, x) AS (VALUES (0, 24000.0), (1, 25000.0), (2, 26000.0), (3, 27000.0)) SELECT i AS discount_pos, j AS threshold_pos, round(sum(w * (price * (1 - d) <= x)::INT) / sum(w), 9) AS value FROM s, p, t GROUP BY i, j")
def q_param_grid_2d(spark, sf):
    s = Suppliers(spark, sf)
    met = Index("met", s.price * (1 - s.discount) <= s.threshold)
    r = Evaluation(Scenario(_model(s.price, s.discount, s.threshold, met))).evaluate([met], ensemble=s.ensemble, parameters={s.discount: [0.0, 0.05, 0.1], s.threshold: [24000.0, 25000.0, 26000.0, 27000.0]})
    df = r.frame(met).withColumn("value", F.col("value").cast("int"))
    w = F.col("w_e_supplier")
    df = df.groupBy("p_discount", "p_threshold").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("value"))
    return df.select(F.col("p_discount").alias("discount_pos"), F.col("p_threshold").alias("threshold_pos"), _r("value", 9).alias("value"))


@query("WITH b(i, base) AS (VALUES (0, 4.0), (1, 5.5), (2, 7.0), (3, 8.5), (4, 10.0)), g(j, slope) AS (VALUES (0, 0.1), (1, 0.2), (2, 0.4)), o AS (SELECT o_orderpriority AS pr, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT pr, n, left(pr, 1)::INT AS e FROM o) SELECT i AS base_pos, j AS slope_pos, round(sum((base - slope * e) * n), 6) AS total FROM b, g, e GROUP BY i, j")
def q_named_axes_callable(spark, sf):
    """Costs base - slope * e of five priorities, each an index bound to a function of two named axes."""
    n = {r["o_orderpriority"]: r["n"] for r in _t(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).collect()}
    costs = {k: Index(f"cost_{k[0]}", None) for k in sorted(n)}
    total = Index("total", sum((costs[k] * n[k] for k in costs), start=expr.constant(0)))
    values = {costs[k]: (lambda base, slope, e=int(k[0]): base - slope * e) for k in costs}
    r = Evaluation(Scenario(_model(*costs.values(), total))).evaluate([total], parameters=values, parameter_axes={"base": np.linspace(4, 10, 5), "slope": np.array([0.1, 0.2, 0.4])})
    return r.frame(total).select(F.col("p_base").alias("base_pos"), F.col("p_slope").alias("slope_pos"), _r("value").alias("total"))


@query(f"WITH {_HOURS}, c AS (SELECT event_type AS kind, count(*)::DOUBLE AS w FROM events GROUP BY 1) SELECT hour, round(sum(w * v) / sum(w), 6) AS value FROM h JOIN c USING (kind) GROUP BY hour")
def q_expected_value_ts(spark, sf):
    """Event kinds as scenarios weighted by frequency; time stays."""
    axis = Axis("kind", ENSEMBLE)
    s, bound = _hours(spark, sf)
    counts = _t(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("w"))
    known = Index("known", None)
    ensemble = FrameEnsemble(counts.withColumn("one", F.lit(1.0)), "kind", "w", {known: "one"}, "kind")
    out = Index("out", s * known)
    r = Evaluation(Scenario(_model(s, known, out))).evaluate([out], ensemble=ensemble, frames={s: BoundFrame(bound.df, {axis: "kind", TIME: "hour"})})
    return r.expected_frame(out).select(F.col("d_time").alias("hour"), _r("value").alias("value"))


def _segments(spark, sf):
    c = _t(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").cast("double").alias("w"), F.round(F.avg("c_acctbal"), 2).alias("bal"))
    balance = Index("balance", None)
    return balance, FrameEnsemble(c, "c_mktsegment", "w", {balance: "bal"}, "segment")


_SEG = "c AS (SELECT c_mktsegment AS seg, count(*)::DOUBLE AS cw, round(avg(c_acctbal), 2) AS bal FROM customer GROUP BY 1)"


@query(f"WITH {_SUPP}, {_SEG} SELECT round(sum(w * cw * (price / 100 + bal * qty / 50)) / sum(w * cw), 5) AS value FROM s, c")
def q_expected_two_axes(spark, sf):
    s = Suppliers(spark, sf)
    balance, segments = _segments(spark, sf)
    out = Index("out", s.price / 100 + balance * s.qty / 50)
    r = Evaluation(Scenario(_model(s.price, s.qty, balance, out))).evaluate([out], ensemble=SideBySide(s.ensemble, segments))
    return r.expected_frame(out).select(_r("value", 5).alias("value"))


@query(f"WITH {_SUPP}, {_SEG} SELECT k, seg, w * cw AS weight FROM s, c")
def q_joint_weights(spark, sf):
    s = Suppliers(spark, sf)
    balance, segments = _segments(spark, sf)
    r = Evaluation(Scenario(_model(s.price, s.qty, balance))).evaluate([balance], ensemble=SideBySide(s.ensemble, segments))
    return r.weights.select(F.col("e_supplier").alias("k"), F.col("e_segment").alias("seg"), "weight")


def _shares(df: DataFrame, column: str) -> dict[str, float]:
    """Relative frequencies of the few keys of a category, in order of the keys."""
    rows = df.groupBy(column).agg(F.count("*").alias("n")).collect()
    total = sum(r["n"] for r in rows)
    return {r[column]: r["n"] / total for r in sorted(rows, key=lambda r: r[column])}


def _categories(spark, sf):
    segment = CategoricalIndex("segment", _shares(_t(spark, sf, "customer"), "c_mktsegment"))
    priority = CategoricalIndex("priority", _shares(_t(spark, sf, "orders"), "o_orderpriority"))
    return segment, priority


def _combinations(*indexes: GenericIndex, **kwargs) -> DataFrame:
    """The scenarios of an evaluation over all combinations: each index's key, and the weight."""
    e = CrossProductEnsemble(Scenario(_model(*indexes)), **kwargs)
    r = Evaluation(e.scenario).evaluate(list(indexes), ensemble=e)
    return r.table(**{i.name: i for i in indexes}).select(*[i.name for i in indexes], _r("w_e__cross_product", 12).alias("weight"))


_CROSS = "a AS (SELECT c_mktsegment AS segment, count(*) / sum(count(*)) OVER () AS p FROM customer GROUP BY 1), b AS (SELECT o_orderpriority AS priority, count(*) / sum(count(*)) OVER () AS q FROM orders GROUP BY 1)"


@query(f"WITH {_CROSS} SELECT segment, priority, round(p * q, 12) AS weight FROM a, b")
def q_cross_product_weights(spark, sf):
    return _combinations(*_categories(spark, sf))


@query(f"WITH {_CROSS}, r AS (SELECT segment, p / sum(p) OVER () AS p FROM a WHERE segment IN ('BUILDING', 'MACHINERY')) SELECT segment, priority, round(p * q, 12) AS weight FROM r, b")
def q_restriction_renormalised(spark, sf):
    segment, priority = _categories(spark, sf)
    keep = [k for k in ("BUILDING", "MACHINERY") if k in segment.support]
    return _combinations(segment, priority, restrictions={segment: keep})


def _conditional(spark, sf):
    """P(status | priority) of orders, as a table the factory looks up."""
    o = _t(spark, sf, "orders")
    priority = CategoricalIndex("priority", _shares(o, "o_orderpriority"))
    n: dict[str, dict[str, int]] = {}
    for r in o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n")).collect():
        n.setdefault(r["o_orderpriority"], {})[r["o_orderstatus"]] = r["n"]
    support = sorted({k for v in n.values() for k in v})
    status = ConditionalCategoricalIndex("status", [priority], support, lambda priority: {k: n[priority][k] / sum(n[priority].values()) for k in support})
    return priority, status


@query("SELECT o_orderpriority AS priority, o_orderstatus AS status, round(count(*) / sum(count(*)) OVER (), 12) AS weight FROM orders GROUP BY 1, 2")
def q_conditional_categorical(spark, sf):
    return _combinations(*_conditional(spark, sf))


@query("SELECT o_orderpriority AS priority, greatest(1, round_even(count(*) / sum(count(*)) OVER () * 200, 0))::BIGINT AS n FROM orders GROUP BY 1")
def q_sample_across_counts(spark, sf):
    """Draws in place for each weighted scenario, counted; each lies where its priority's distribution does."""
    priority, _ = _conditional(spark, sf)
    load = ConditionalDistributionIndex("load", [priority], lambda priority: dist.uniform(float(priority[0]), 0.5))
    e = CrossProductEnsemble(Scenario(_model(priority, load)), exclude=[load])
    (t,) = e.tables(spark)
    drawn = sample_frame(spark, e, [load], 200, seed=2).join(t.df.withColumnRenamed(f"n{priority.node.id}", "priority"), t.axis.key)
    at = F.col("priority").substr(1, 1).cast("double")
    return drawn.where((F.col("load") >= at) & (F.col("load") <= at + 0.5)).groupBy("priority").agg(F.count("*").alias("n"))


@query("SELECT i AS a, j AS b, round(1.0 / (n * m), 12) AS weight, 30.0::DOUBLE AS value FROM (SELECT count(*) AS n FROM nation), (SELECT count(*) AS m FROM region), range((SELECT count(*) FROM nation)) x(i), range((SELECT count(*) FROM region)) y(j)")
def q_partitioned_ensemble(spark, sf):
    """Two axes of draws, crossed by the one formula that mixes them; distributions without width, so that values are known."""
    a, b = DistributionIndex("a", dist.uniform, {"loc": 10.0, "scale": 0.0}), DistributionIndex("b", dist.uniform, {"loc": 3.0, "scale": 0.0})
    out = Index("out", a * b)
    s = Scenario(_model(a, b, out))
    axes = [EnsembleAxisSpec("a", _t(spark, sf, "nation").count(), [a]), EnsembleAxisSpec("b", _t(spark, sf, "region").count(), [b])]
    r = Evaluation(s).evaluate([out], ensemble=PartitionedEnsemble(s, axes))
    both = r.frame(out).join(r.weights, ["e_a", "e_b"])
    return both.select(F.col("e_a").alias("a"), F.col("e_b").alias("b"), _r("weight", 12).alias("weight"), "value")


def _unit(spark, sf) -> DataFrame:
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return _t(spark, sf, "lineitem").select(k.alias("k"), (k.cast("double") * F.lit(0.6180339887498949) % 1).alias("u"))


@query("WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS k FROM lineitem) SELECT k, round(10 + 5 * fmod(k::DOUBLE * 0.6180339887498949::DOUBLE, 1::DOUBLE), 6) AS v FROM x")
def q_dist_uniform_ppf(spark, sf):
    return _unit(spark, sf).select("k", _r(dist.uniform(10, 5).ppf(F.col("u"))).alias("v"))


@query("WITH z AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_quantity / 50 AS z FROM lineitem) SELECT k, round(CASE WHEN z <= 0 THEN 0 WHEN z >= 1 THEN 1 WHEN z < 0.5 THEN z * z / 0.5 ELSE 1 - (1 - z) * (1 - z) / 0.5 END, 9) AS v FROM z")
def q_triang_cdf(spark, sf):
    i = _t(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_quantity")
    return i.select("k", _r(dist.triang(0.5, 0, 50).cdf(F.col("l_quantity")), 9).alias("v"))


def _sql_normal_cdf(x: str) -> str:
    top = low = None
    for c in dist._TAIL_TOP:
        top = f"{c!r}" if top is None else f"({top} * abs({x}) + {c!r})"
    for c in dist._TAIL_LOW:
        low = f"{c!r}" if low is None else f"({low} * abs({x}) + {c!r})"
    tail = f"(exp(-{x} * {x} / 2) * {top}::DOUBLE / {low}::DOUBLE)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


@query(f"WITH z AS (SELECT l_orderkey * 10 + l_linenumber AS k, (ln(l_extendedprice / 25000) / 0.5)::DOUBLE AS z FROM lineitem) SELECT k, round({_sql_normal_cdf('z')}, 8) AS v FROM z")
def q_lognorm_cdf(spark, sf):
    i = _t(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_extendedprice")
    return i.select("k", _r(dist.lognorm(0.5, 0, 25000).cdf(F.col("l_extendedprice")), 8).alias("v"))


def _near(value: Column, mean: float, std: float) -> Column:
    """1 if the average of value is within five standard errors of the mean."""
    return (F.abs(F.avg(value) - mean) <= 5 * std / F.sqrt(F.count(value))).cast("int")


@query("SELECT count(*) AS n, count(*) AS scenarios, 1 AS a_mean, 1 AS b_mean, 1 AS b_inside, 1 AS mode_share, count(*) AS chosen FROM customer")
def q_distribution_ensemble(spark, sf):
    """Draws on the executors, keyed by scenario number: as many scenarios as there are customers."""
    n = _t(spark, sf, "customer").count()
    a, b = DistributionIndex("a", dist.norm, {"loc": 5, "scale": 2}), DistributionIndex("b", dist.truncnorm, {"a": -1, "b": 1})
    mode = CategoricalIndex("mode", {"AIR": 0.3, "SHIP": 0.7})
    out = Index("out", where(mode == "AIR", a, b * 2))
    m = _model(a, b, mode, out)
    r = Evaluation(Scenario(m)).evaluate(ensemble=DistributionEnsemble(Scenario(m), n, seed=7))
    air = (F.col("mode") == "AIR").cast("double")
    chosen = F.col("out") == F.when(F.col("mode") == "AIR", F.col("a")).otherwise(F.col("b") * 2)
    narrow = dist.truncnorm(-1, 1)
    return r.table(a=a, b=b, mode=mode, out=out).agg(
        F.count("*").alias("n"), F.count_distinct("e__ensemble").alias("scenarios"), _near(F.col("a"), 5, 2).alias("a_mean"), _near(F.col("b"), 0, narrow.std()).alias("b_mean"),
        (F.max(F.abs("b")) <= 1).cast("int").alias("b_inside"), _near(air, 0.3, (0.3 * 0.7) ** 0.5).alias("mode_share"), F.count_if(chosen).alias("chosen"),
    )


@query("SELECT o_orderpriority AS priority, o_orderstatus AS status, round(count(*) / sum(count(*)) OVER (), 12) AS weight, left(o_orderpriority, 1)::DOUBLE AS base, 1 AS inside FROM orders GROUP BY 1, 2")
def q_conditional_distribution(spark, sf):
    """Random indexes whose distribution depends on an order's priority, one draw per combination; one of them without width."""
    priority, status = _conditional(spark, sf)
    load = ConditionalDistributionIndex("load", [priority], lambda priority: dist.triang(0.5, float(priority[0]), 2.0))
    base = ConditionalDistributionIndex("base", [priority], lambda priority: dist.uniform(float(priority[0]), 0.0))
    e = CrossProductEnsemble(Scenario(_model(priority, status, load, base)), seed=3)
    r = Evaluation(e.scenario).evaluate([load, base, status, priority], ensemble=e)
    df = r.table(load=load, base=base, status=status, priority=priority)
    inside = (F.col("load") >= F.col("base")) & (F.col("load") <= F.col("base") + 2)
    return df.select("priority", "status", _r("w_e__cross_product", 12).alias("weight"), "base", inside.cast("int").alias("inside"))


@query(f"WITH {_SUPP} SELECT k, round(price * (1 - 0.05), 6) AS base, round(price * (1 - 0.2), 6) AS what_if FROM s")
def q_scenario_override(spark, sf):
    s = Suppliers(spark, sf)
    rebate = Index("rebate", 0.05)
    net = Index("net", s.price * (1 - rebate))
    frames = []
    for name, overrides in (("base", None), ("what_if", {rebate: 0.2})):
        r = Evaluation(Scenario(_model(s.price, rebate, net), overrides)).evaluate([net], ensemble=s.ensemble)
        frames.append(r.frame(net).select(F.col("e_supplier").alias("k"), _r("value").alias(name)))
    return frames[0].join(frames[1], "k")


def _variants(i: Items, selector):
    def model(name, formula):
        return Model(name, inputs={"p": i.p, "q": i.q}, outputs={"cost": Index("cost", formula)})

    return ModelVariant("cost", {"R": model("R", i.p * 0.5), "A": model("A", i.p - i.q), "N": model("N", i.p * 1.0)}, selector)


@query(f"SELECT {_KEY}, round(l_extendedprice - l_quantity, 6) AS cost FROM lineitem")
def q_variant_static(spark, sf):
    i = Items(spark, sf)
    return i.table(cost=_variants(i, "A").outputs.cost).select("k", _r("cost").alias("cost"))


_VARIANT = "round(CASE l_returnflag WHEN 'R' THEN l_extendedprice * 0.5 WHEN 'A' THEN l_extendedprice - l_quantity WHEN 'N' THEN l_extendedprice * 1.0 END, 6)"


@query(f"SELECT {_KEY}, {_VARIANT} AS cost FROM lineitem")
def q_variant_runtime(spark, sf):
    i = Items(spark, sf)
    return i.table(cost=_variants(i, i.flag).outputs.cost).select("k", _r("cost").alias("cost"))


@query(f"SELECT {_KEY}, round(CASE WHEN l_quantity < 10 THEN l_extendedprice * 0.5 WHEN l_quantity < 30 THEN l_extendedprice - l_quantity ELSE l_extendedprice END, 6) AS cost FROM lineitem")
def q_variant_guard(spark, sf):
    i = Items(spark, sf)
    v = _variants(i, [("R", i.q < 10), ("A", i.q < 30), ("N", True)])
    return i.table(cost=v.outputs.cost).select("k", _r("cost").alias("cost"))


@query(f"WITH m(i, mode) AS (VALUES (0, 'R'), (1, 'A'), (2, 'N')), {_SUPP} SELECT i AS mode_pos, round(sum(w * CASE mode WHEN 'R' THEN price * 0.5 WHEN 'A' THEN price - qty ELSE price END) / sum(w), 6) AS value FROM s, m GROUP BY i")
def q_variant_sweep(spark, sf):
    """The selector as a parameter axis of text."""
    s = Suppliers(spark, sf)
    mode = CategoricalIndex("mode", {"R": 0.2, "A": 0.3, "N": 0.5})
    make = lambda name, f: Model(name, inputs={"price": s.price, "qty": s.qty}, outputs={"cost": Index("cost", f)})
    v = ModelVariant("v", {"R": make("R", s.price * 0.5), "A": make("A", s.price - s.qty), "N": make("N", s.price * 1.0)}, mode)
    r = Evaluation(Scenario(v)).evaluate([v.outputs.cost], ensemble=s.ensemble, parameters={mode: ["R", "A", "N"]})
    return r.expected_frame(v.outputs.cost).select(F.col("p_mode").alias("mode_pos"), _r("value").alias("value"))


@query(f"SELECT {_KEY}, {_VARIANT} AS cost FROM lineitem")
def q_variant_guarded_union(spark, sf):
    """Filter, evaluate each branch on its own rows, put together: a plan by regions."""
    i = Items(spark, sf)
    v = _variants(i, i.flag)
    r = Evaluation(Scenario(v)).evaluate([v.outputs.cost], "regional", ensemble=i.ensemble)
    return r.table(cost=v.outputs.cost).select(F.col("e_item").alias("k"), _r("cost").alias("cost"))


def _only(flag_is: str):
    """A function that fails on any row but those of its own branch, which are told by the sign of q."""

    def call(q: np.ndarray) -> np.ndarray:
        if not (q > 0 if flag_is == "R" else q < 0).all():
            raise ValueError("called with rows of another branch")
        return np.sqrt(np.abs(q))

    return call


@query(f"SELECT {_KEY}, round(sqrt(l_quantity) + CASE l_returnflag WHEN 'R' THEN 1 ELSE 2 END, 6) AS v, round(2 * (sqrt(l_quantity) + CASE l_returnflag WHEN 'R' THEN 1 ELSE 2 END) + l_tax, 6) AS after FROM lineitem")
def q_variant_regional(spark, sf):
    """Branches whose functions fail on foreign rows, and a formula that follows their meeting."""
    i = Items(spark, sf)
    signed = Index("signed", where(i.flag == "R", i.q, i.q * -1.0))
    make = lambda name, fn, more: Model(name, inputs={"q": i.q}, outputs={"v": Index("v", function_call(fn, signed) + more)})
    v = ModelVariant("v", {"root": make("root", "root", 1), "other": make("other", "other", 2)}, [("root", i.flag == "R"), ("other", True)])
    after = Index("after", v.outputs.v * 2 + i.t)
    functions = {"root": adapt(_only("R"), "vector"), "other": adapt(_only("N"), "vector")}
    r = Evaluation(Scenario(v)).evaluate([v.outputs.v, after], "regional", ensemble=i.ensemble, functions=functions)
    return r.table(v=v.outputs.v, after=after).select(F.col("e_item").alias("k"), _r("v").alias("v"), _r("after").alias("after"))


@query(f"SELECT {_KEY}, round(CASE l_returnflag WHEN 'R' THEN sqrt(l_quantity) ELSE l_quantity * l_quantity END, 6) AS v FROM lineitem")
def q_variant_guarded_udf(spark, sf):
    """Functions in branches: each is called with its own branch's rows only."""
    i = Items(spark, sf)
    make = lambda name, fn: Model(name, inputs={"q": i.q}, outputs={"v": Index("v", function_call(fn, i.q))})
    v = ModelVariant("v", {"root": make("root", "root"), "square": make("square", "square")}, [("root", i.flag == "R"), ("square", True)])
    functions = {"root": adapt(np.sqrt, "vector"), "square": adapt(np.square, "vector")}
    return i.table(functions=functions, v=v.outputs.v).select("k", _r("v").alias("v"))


@query(f"WITH {_SUPP}, t(i, t) AS (VALUES (0, 20000.0), (1, 25000.0), (2, 30000.0)), e(j, e) AS (VALUES (0, 24.0), (1, 25.5), (2, 27.0)) SELECT i, j, round(sum(w * (price <= t)::INT) / sum(w) * (sum(w * (qty <= e)::INT) / sum(w)), 9) AS field FROM s, t, e GROUP BY i, j")
def q_sustainability_field(spark, sf):
    s = Suppliers(spark, sf)
    t, e = Index("t", None), Index("e", None)
    a, b = Index("a", where(s.price <= t, 1.0, 0.0)), Index("b", where(s.qty <= e, 1.0, 0.0))
    both = Index("both", a + b)
    r = Evaluation(Scenario(_model(s.price, s.qty, t, e, a, b, both))).evaluate([a, b, both], ensemble=s.ensemble, parameters={t: [20000.0, 25000.0, 30000.0], e: [24.0, 25.5, 27.0]})
    # each constraint varies along its own axis: averaged there, and crossed only after
    fa, fb = r.expected_frame(a), r.expected_frame(b)
    df = fa.withColumnRenamed("value", "x").crossJoin(fb.withColumnRenamed("value", "y"))
    return df.select(F.col("p_t").alias("i"), F.col("p_e").alias("j"), _r(F.col("x") * F.col("y"), 9).alias("field"))


@query(f"WITH {_SUPP} SELECT round(sum(least(greatest((price - 20000) / 10000, 0), 1)) * (10000 / 100.0 + 1) * (50 / 10.0 + 1), 4) AS area FROM s")
def q_sustainable_area(spark, sf):
    df = Suppliers(spark, sf).ensemble.df.select(F.least(F.greatest((F.col("price") - 20000) / 10000, F.lit(0)), F.lit(1)).alias("f"))
    return analytics.sustainable_area(df, "f", [(10000, 101), (50, 11)]).select(_r("area", 4).alias("area"))


@query("WITH x AS (SELECT 3 * l_quantity / 10 + 2 * round(l_discount * 100) / 2 + l_quantity / 10 * round(l_discount * 100) / 2 AS v FROM lineitem) SELECT round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(*)), 6) AS sem FROM x")
def q_index_ci(spark, sf):
    """The mean, with its error, of a field on a grid, interpolated at samples: line items by quantity and discount."""
    grid = spark.range(36).select((F.col("id") / 6).cast("int").alias("i"), (F.col("id") % 6).cast("int").alias("j"))
    grid = grid.withColumn("v", (3 * F.col("i") + 2 * F.col("j") + F.col("i") * F.col("j")).cast("double"))
    samples = _t(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.round(F.col("l_discount") * 100).alias("y"))
    n = samples.count()
    out = analytics.index_with_confidence(analytics.bilinear(grid, samples, "x", "y", "v", (10.0, 2.0), (6, 6)), "v", n)
    return out.select(_r("mean").alias("mean"), _r(F.col("half_width") / dist.student_ppf(0.95, n - 1)).alias("sem"))


@query(f"WITH {_SUPP}, g AS (SELECT floor(price / 1000)::INT AS i, floor(qty)::INT AS j, count(*)::DOUBLE AS v FROM s GROUP BY 1, 2), x AS (SELECT i, j, v > 3 AS up, lag(v > 3) OVER a OR lead(v > 3) OVER a OR lag(v > 3) OVER b OR lead(v > 3) OVER b AS near FROM g WINDOW a AS (PARTITION BY j ORDER BY i), b AS (PARTITION BY i ORDER BY j)), y AS (SELECT i, j, coalesce(lag(up) OVER a, false) OR coalesce(lead(up) OVER a, false) OR coalesce(lag(up) OVER b, false) OR coalesce(lead(up) OVER b, false) AS near, up FROM x WINDOW a AS (PARTITION BY j ORDER BY i), b AS (PARTITION BY i ORDER BY j)) SELECT i, j FROM y WHERE NOT up AND near")
def q_modal_boundary(spark, sf):
    s = Suppliers(spark, sf).ensemble.df
    grid = s.groupBy(F.floor(F.col("price") / 1000).cast("int").alias("i"), F.floor("qty").cast("int").alias("j")).agg(F.count("*").cast("double").alias("v"))
    return analytics.boundary(grid, "v", 3)


@query("SELECT count(*) AS n, round(avg(s_acctbal), 6) AS cx, round(avg(s_nationkey), 6) AS cy, round(abs(cos(atan2(2 * covar_pop(s_acctbal, s_nationkey), var_pop(s_acctbal) - var_pop(s_nationkey)) / 2)), 6) AS dx FROM supplier")
def q_modal_line(spark, sf):
    line = analytics.principal_line(_t(spark, sf, "supplier"), "s_acctbal", "s_nationkey")
    return line.select("n", _r("cx").alias("cx"), _r("cy").alias("cy"), _r(F.abs("dx")).alias("dx"))


_GRID = "n AS (SELECT count(*)::DOUBLE AS n FROM lineitem), g AS (SELECT floor(l_extendedprice / 10000)::INT AS i, floor(l_quantity / 5)::INT AS j, count(*) / max(n) AS v FROM lineitem, n GROUP BY 1, 2)"


@query(f"""WITH {_GRID}, x AS (SELECT i, j, v > 0.01 AS up FROM g),
    y AS (SELECT i, j, up, coalesce(lag(up) OVER a, false) OR coalesce(lead(up) OVER a, false) OR coalesce(lag(up) OVER b, false) OR coalesce(lead(up) OVER b, false) AS near FROM x WINDOW a AS (PARTITION BY j ORDER BY i), b AS (PARTITION BY i ORDER BY j)),
    m AS (SELECT count(*) AS n, avg(i * 10.0) AS cx, avg(j * 5.0) AS cy, atan2(2 * covar_pop(i * 10.0, j * 5.0), var_pop(i * 10.0) - var_pop(j * 5.0)) / 2 AS a FROM y WHERE NOT up AND near),
    d AS (SELECT cx, cy, cos(a) AS dx, sin(a) AS dy FROM m WHERE n >= 3),
    t AS (SELECT *, greatest(least(-cx / dx, (100 - cx) / dx), least(-cy / dy, (50 - cy) / dy)) AS lo, least(greatest(-cx / dx, (100 - cx) / dx), greatest(-cy / dy, (50 - cy) / dy)) AS hi FROM d)
    SELECT round(cx + lo * dx, 5) AS x0, round(cy + lo * dy, 5) AS y0, round(cx + hi * dx, 5) AS x1, round(cy + hi * dy, 5) AS y1 FROM t WHERE lo < hi""")
def q_modal_line_clipped(spark, sf):
    """The boundary of where line items are frequent, its main axis, and that clipped to the box."""
    li = _t(spark, sf, "lineitem")
    total = float(li.count())
    grid = li.groupBy(F.floor(F.col("l_extendedprice") / 10000).cast("int").alias("i"), F.floor(F.col("l_quantity") / 5).cast("int").alias("j")).agg((F.count("*") / total).alias("v"))
    line = analytics.modal_line(grid, "v", (10.0, 5.0), (100.0, 50.0), 0.01)
    return line.select(*[_r(c, 5).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(f"SELECT {_KEY}, round(l_extendedprice * 30000.0 / pow(pow(l_extendedprice, 3) + pow(30000.0, 3), 1 / 3.0::DOUBLE), 4) AS v FROM lineitem")
def q_presence_saturation(spark, sf):
    i = Items(spark, sf)
    functions = {"saturated": adapt(lambda p: analytics.saturated(p, 30000.0), "column")}
    return i.table(functions=functions, v=function_call("saturated", i.p)).select("k", _r("v", 4).alias("v"))


@query(f"WITH {_SUPP} SELECT trunc(sum(w * price) / sum(w))::BIGINT AS price, trunc(sum(w * -qty) / sum(w))::BIGINT AS qty FROM s")
def q_indicators(spark, sf):
    s = Suppliers(spark, sf)
    loss = Index("loss", -s.qty.node)
    r = Evaluation(Scenario(_model(s.price, s.qty, loss))).evaluate([s.price, loss], ensemble=s.ensemble)
    a, b = r.expected_frame(s.price), r.expected_frame(loss)
    return a.select(analytics.indicator(F.col("value")).alias("price")).crossJoin(b.select(analytics.indicator(F.col("value")).alias("qty")))


@query(f"WITH {_HOURS}, g AS (SELECT hour, v / 100.0 AS mu, x::BIGINT AS x FROM h, range(0, 30, 5) r(x)) SELECT hour AS d_time, x, round(avg(list_sum(list_transform(range(0, x + 1), lambda i: exp(i * ln(mu) - mu - lgamma(i + 1))))), 6) AS share FROM g GROUP BY 1, 2")
def q_poisson_field(spark, sf):
    """The mean share of scenarios in which at most x events come, per hour and x."""
    s, bound = _hours(spark, sf)
    mean = Index("mean", s / 100.0)
    df = _series_result(spark, sf, mean=mean, _source=(s, bound)).frame(mean)
    grid = df.crossJoin(spark.range(0, 30, 5).withColumnRenamed("id", "x"))
    return grid.groupBy("d_time", "x").agg(_r(F.avg(analytics.share_at_most(F.col("value"), F.col("x").cast("double")))).alias("share"))


@query("SELECT 4 * count(*) AS n, round(10.0 * 3.0, 6) AS value, round(1.0 / (4 * count(*)), 12) AS weight FROM nation")
def q_incremental_merge(spark, sf):
    """Batches of scenarios merged into one result: its average, size and weights. Without width, values are known."""
    n = _t(spark, sf, "nation").count()
    a, b = DistributionIndex("a", dist.uniform, {"loc": 10.0, "scale": 0.0}), DistributionIndex("b", dist.uniform, {"loc": 3.0, "scale": 0.0})
    out = Index("out", a * b)
    h = evaluate_incremental(Evaluation(Scenario(_model(a, b, out))), n, [out], seed=1)
    h.extend(2 * n)
    r = h.extend(n)
    averaged = r.expected_frame(out).select(_r("value").alias("value"))
    return r.frame(out).agg(F.count_distinct("e__ensemble").alias("n"), _r(F.max("w_e__ensemble"), 12).alias("weight")).crossJoin(averaged).select("n", "value", "weight")


@query("SELECT k, 1 AS same FROM range(2 * (SELECT count(*) FROM customer)) r(k)")
def q_incremental_extend(spark, sf):
    """As many scenarios as customers, extended by as many: the value of each is that of all evaluated at once."""
    n = _t(spark, sf, "customer").count()
    a, b = DistributionIndex("a", dist.uniform, {"scale": 3.0}), DistributionIndex("b", dist.norm, {})
    out = Index("out", a * 2 + b)
    s = Scenario(_model(a, b, out))
    h = evaluate_incremental(Evaluation(s), n, [out], seed=99)
    grown = h.extend(n).frame(out).select(F.col("e__ensemble").alias("k"), F.col("value").alias("grown"))
    whole = Evaluation(s).evaluate([out], ensemble=DistributionEnsemble(s, 2 * n, seed=99)).frame(out)
    met = grown.join(whole.select(F.col("e__ensemble").alias("k"), "value"), "k")
    return met.select("k", (F.col("grown") == F.col("value")).cast("int").alias("same"))


@query(f"SELECT {_KEY}, round(ln(1 + l_quantity), 9) AS v FROM lineitem")
def q_udf_column(spark, sf):
    i = Items(spark, sf)
    return i.table(functions={"f": adapt(F.log1p, "column")}, v=function_call("f", i.q)).select("k", _r("v", 9).alias("v"))


@query(f"SELECT {_KEY}, round(l_quantity * l_discount, 6) AS v FROM lineitem")
def q_udf_vector(spark, sf):
    i = Items(spark, sf)
    return i.table(functions={"f": adapt(lambda a, b: a * b, "vector")}, v=function_call("f", i.q, b=i.d)).select("k", _r("v").alias("v"))


@query("WITH r(w, x) AS (VALUES (1.0, 10.0), (3.0, 20.0)), n AS (SELECT count(*) AS n FROM region) SELECT round(sum(w * x * n) / sum(w), 6) AS value FROM r, n")
def q_rows_ensemble(spark, sf):
    x, n = Index("x", None), ConstIndex("n", _t(spark, sf, "region").count())
    out = Index("out", x * n)
    r = Evaluation(Scenario(_model(x, n, out))).evaluate([out], ensemble=RowsEnsemble([(1.0, {x: 10.0}), (3.0, {x: 20.0})]))
    return r.expected_frame(out).select(_r("value").alias("value"))


@query(f"WITH {_HOURS}, w(hour, f) AS (SELECT range::INT, 1 + range / 24.0::DOUBLE FROM range(24)) SELECT kind, round(sum(v * f), 2) AS value FROM h JOIN w USING (hour) GROUP BY kind")
def q_series_constant(spark, sf):
    """A constant series against a series from data: joined on time."""
    s, bound = _hours(spark, sf)
    from axiloom.index import ConstTimeseriesIndex

    f = ConstTimeseriesIndex("f", 1 + np.arange(24) / 24.0)
    out = Index("out", expr.reduce("sum", s * f, TIME))
    df = Evaluation(Scenario(_model(s, f, out))).evaluate([out], frames={s: bound}).frame(out)
    return df.select(F.col("p_kind").alias("kind"), _r("value", 2).alias("value"))


@query(f"WITH {_HOURS} SELECT kind, hour, round(sum(v) OVER (PARTITION BY kind), 4) AS total, round(v - lag(v, 1, 0) OVER (PARTITION BY kind ORDER BY hour), 4) AS step FROM h")
def q_window_over_axes(spark, sf):
    """A whole-axis total beside each value, and the step from the value before."""
    s, bound = _hours(spark, sf)
    total, step = Index("total", s.sum() + s * 0.0), Index("step", function_call("step", s))
    functions = {"step": adapt(lambda a: np.diff(a, prepend=0.0), "series")}
    r = Evaluation(Scenario(_model(s, total, step))).evaluate([total, step], frames={s: bound}, functions=functions)
    return r.table(total=total, step=step).select(F.col("p_kind").alias("kind"), F.col("d_time").alias("hour"), _r("total", 4).alias("total"), _r("step", 4).alias("step"))
