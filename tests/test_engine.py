"""Evaluation against NumPy."""

import concurrent.futures
import itertools
import math
import threading

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from axiloom.axes import PARAMETER, TIME, Axis
from axiloom.errors import FunctionNotFound, PlaceholderValueNotProvided, UnsupportedOperation
from axiloom.functions import distributions as dist
from axiloom.functions.registry import adapt
from axiloom.index import CategoricalIndex, ConstIndex, ConstTimeseriesIndex, DistributionIndex, Index, TimeseriesIndex
from axiloom.model import Model, ModelVariant
from axiloom.operators.evaluate import Evaluation
from axiloom.plans import expr
from axiloom.plans.expr import exp, function_call, log, maximum, multi_clause_where, piecewise, where
from axiloom.scenario import Scenario
from axiloom.sources.ensembles import DistributionEnsemble, EnsembleAxisSpec, PartitionedEnsemble, RowsEnsemble
from axiloom.streaming.handles import evaluate_incremental, running_expectation, submit_evaluate

pytestmark = pytest.mark.filterwarnings("ignore::DeprecationWarning", "ignore::RuntimeWarning", "ignore::axiloom.model.ModelContractWarning")
SPECIAL = [0.0, 1.0, -1.0, 2.5, -3.0, float("nan"), float("inf"), float("-inf")]


def model(*indexes):
    return Model("m", list(indexes))


def pairs(spark, build):
    """Values of build(a, b) over all pairs of special numbers, by columns of one ensemble."""
    a, b = Index("a", None), Index("b", None)
    grid = list(itertools.product(SPECIAL, SPECIAL))
    outs = [Index(f"o{k}", n) for k, n in enumerate(build(a, b))]
    ens = RowsEnsemble([(1.0, {a: x, b: y}) for x, y in grid])
    r = Evaluation(Scenario(model(a, b, *outs))).evaluate(outs, ensemble=ens, spark=spark)
    rows = r.table(**{o.name: o for o in outs}).orderBy("e__ensemble").collect()
    x, y = (np.array(v) for v in zip(*grid))
    return x, y, [np.array([row[o.name] for row in rows]) for o in outs]


def test_binary_operators_on_special_numbers(spark):
    x, y, got = pairs(spark, lambda a, b: [a + b, a - b, a * b, a / b, maximum(a, b), a == b, a != b, a < b, a <= b, a > b, a >= b])
    with np.errstate(all="ignore"):
        want = [x + y, x - y, x * y, x / y, np.maximum(x, y), x == y, x != y, x < y, x <= y, x > y, x >= y]
    for g, w in zip(got, want):
        np.testing.assert_array_equal(g, w)


def test_unary_and_logical_operators_on_special_numbers(spark):
    x, y, got = pairs(spark, lambda a, b: [exp(a), log(a), -a.node, ~a.node, a.node & b.node, a.node | b.node, a.node ^ b.node, where(a, b, 7.0)])
    with np.errstate(all="ignore"):
        want = [np.exp(x), np.log(x), -x, np.logical_not(x), np.logical_and(x, y), np.logical_or(x, y), np.logical_xor(x, y), np.where(x, y, 7.0)]
    for g, w in zip(got, want):
        np.testing.assert_allclose(g.astype(float), w.astype(float), rtol=1e-14)


def test_power_and_kinds(spark):
    i, f, b = Index("i", 3), Index("f", 0.5), Index("b", True)
    outs = [Index(f"o{k}", n) for k, n in enumerate([i**2, i / 2, i * f, b.node + b.node, b.node + i.node, i - 1])]
    r = Evaluation(Scenario(model(i, f, b, *outs))).evaluate(outs, spark=spark)
    got = [r[o].item() for o in outs]
    assert got == [9, 1.5, 1.5, True, 4, 2] and isinstance(got[0], int) and isinstance(got[3], bool)
    with pytest.raises(TypeError):
        Evaluation(Scenario(model(b, Index("x", b.node - b.node)))).evaluate(spark=spark)


def test_clauses(spark):
    x = Index("x", None)
    outs = [Index("m", multi_clause_where([(x > 2, 3), (x > 1, 2)], 1)), Index("p", piecewise((x * 10, x > 2))), Index("t", piecewise((expr.constant("a"), x > 1), (expr.constant("b"), True)))]
    r = Evaluation(Scenario(model(x, *outs))).evaluate(outs, parameters={x: [1.0, 2.0, 3.0]}, spark=spark)
    assert r[outs[0]].tolist() == [1, 2, 3] and r[outs[2]].tolist() == ["b", "a", "a"]
    np.testing.assert_array_equal(r[outs[1]], [np.nan, np.nan, 30.0])


@pytest.mark.parametrize("kind", expr.REDUCTIONS)
def test_reductions(spark, kind):
    data = np.array([[1.0, 5.0, 0.0, -2.0], [2.0, float("nan"), 4.0, 6.0], [0.0, 0.0, 0.0, 0.0]])
    p, t = Index("p", None), TimeseriesIndex("t", np.arange(4.0))
    nodes = [piecewise(*[(float(v), (p == float(i)) & (t == float(k))) for i in range(3) for k, v in enumerate(data[i])])]
    x = Index("x", nodes[0])
    q = 0.3 if kind == "quantile" else None
    out = Index("out", expr.reduce(kind, x, TIME, q))
    again = Index("again", expr.reduce(kind, out, TIME, q))
    r = Evaluation(Scenario(model(p, t, x, out, again))).evaluate([x, out, again], parameters={p: [0.0, 1.0, 2.0]}, spark=spark)
    f = {"quantile": lambda v, **k: np.quantile(v, 0.3, **k)}.get(kind) or getattr(np, kind)
    want = f(data, axis=-1, keepdims=True)
    np.testing.assert_allclose(r[out].astype(float), np.asarray(want, float), rtol=1e-12)
    np.testing.assert_allclose(r[again].astype(float), np.asarray(f(want, axis=-1, keepdims=True), float), rtol=1e-12)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=6), st.floats(0, 1))
def test_reductions_of_any_series(spark, values, q):
    t = TimeseriesIndex("t", np.array(values))
    outs = [Index(k, expr.reduce(k, t, TIME, q if k == "quantile" else None)) for k in ("sum", "mean", "std", "median", "quantile")]
    r = Evaluation(Scenario(model(t, *outs))).evaluate(outs, spark=spark)
    want = [np.sum(values), np.mean(values), np.std(values), np.median(values), np.quantile(values, q)]
    np.testing.assert_allclose([r[o].item() for o in outs], want, rtol=1e-9, atol=1e-4)


def test_parameters_ensemble_and_time(spark):
    x, i, ts = DistributionIndex("x", dist.uniform, {"scale": 2.0}), Index("i", None), TimeseriesIndex("ts", np.arange(5.0))
    z = Index("z", ts * x + i)
    share = Index("share", z / z.sum())
    m = model(x, i, ts, z, share)
    r = Evaluation(Scenario(m)).evaluate(parameters={i: [1.0, 2.0, 3.0]}, ensemble=DistributionEnsemble(Scenario(m), 5, exclude=[i]), spark=spark)
    assert r.full_shape == (3, 5, 5) and r[x].shape == (1, 5, 1) and r[ts].shape == (1, 1, 5)
    want = r[ts] * r[x] + r[i]
    np.testing.assert_allclose(r[z], want)
    np.testing.assert_allclose(r[share], want / want.sum(-1, keepdims=True))
    np.testing.assert_allclose(r.expected_value(z), want.mean(1))
    assert r.expected_value(i).shape == (3,) and r.parameter_values_for(i).tolist() == [1, 2, 3]
    with pytest.warns(DeprecationWarning):
        r.marginalize(i)


def test_axes_keep_the_order_in_which_they_are_given(spark):
    z, a = Index("z", None), Index("a", None)
    out = Index("out", z * 10 + a)
    r = Evaluation(Scenario(model(z, a, out))).evaluate(parameters={z: [1.0, 2.0], a: [3.0, 4.0, 5.0]}, spark=spark)
    assert r[out].tolist() == [[13, 14, 15], [23, 24, 25]] and r.expected_value(out).shape == (2, 3)


def test_as_many_scenarios_as_time_steps(spark):
    x, ts = DistributionIndex("x", dist.norm), TimeseriesIndex("ts", np.arange(4.0))
    y = Index("y", x + ts)
    m = model(x, ts, y)
    r = Evaluation(Scenario(m)).evaluate(ensemble=DistributionEnsemble(Scenario(m), 4), spark=spark)
    assert r.expected_value(ts).shape == (4,) and r.expected_value(x).shape == () and r[y].shape == (4, 4)


def test_two_ensemble_axes(spark):
    a, b = DistributionIndex("a", dist.uniform), DistributionIndex("b", dist.norm)
    c = Index("c", a * b)
    m = model(a, b, c)
    e = PartitionedEnsemble(Scenario(m), [EnsembleAxisSpec("u", 3, [a])], EnsembleAxisSpec("v", 4))
    r = Evaluation(Scenario(m)).evaluate(ensemble=e, spark=spark)
    np.testing.assert_allclose(r[c], r[a] * r[b])
    assert r[c].shape == (3, 4) and r[a].shape == (3, 1)
    np.testing.assert_allclose(r.expected_value(c), r[a].mean() * r[b].mean())
    np.testing.assert_allclose([w["weight"] for w in r.weights.collect()], np.full(12, 1 / 12))


def test_named_axes_and_functions_of_them(spark):
    base, n, cost = (Index(k, None) for k in ("base_", "n", "cost"))
    total = Index("total", cost * n + base)
    b, g = np.linspace(4, 10, 5), np.linspace(0.1, 0.5, 4)
    m = model(base, n, cost, total)

    def run(f):
        return Evaluation(Scenario(m, {base: 1.0})).evaluate([total], parameters={n: [1.0, 2.0], cost: f}, parameter_axes={"b": b, "g": g}, spark=spark)[total]

    want = ((b[:, None] - 2 * g[None, :])[:, :, None]) * np.array([1.0, 2.0]) + 1
    np.testing.assert_allclose(run(lambda b, g: b - 2 * g), want)
    np.testing.assert_allclose(run(lambda b, g: np.asarray(b) - 2 * np.asarray(g)), want)
    np.testing.assert_allclose(run(lambda b, k=2.0: b * k).ravel(), (np.array([1.0, 2.0]) * b[:, None] * 2 + 1).ravel())
    for f, error in ((lambda *a: 1, TypeError), (lambda b, x: b, ValueError)):
        with pytest.raises(error):
            run(f)


def test_contracts_of_parameters(spark):
    i, c, d = Index("i", 1.0), ConstIndex("c", 2.0), Index("d", None)
    e = Evaluation(Scenario(model(i, c, d), {i: 3.0}))
    for kwargs in ({"parameters": {i: [1.0], d: [1.0]}}, {"parameters": {c: [1.0], d: [1.0]}}, {"parameters": {d: lambda x: x}}, {}):
        with pytest.raises(ValueError):
            e.evaluate(spark=spark, **kwargs)
    with pytest.raises(ValueError, match="named"):
        Evaluation(Scenario(model(d, d2 := Index("d", None)))).evaluate(parameters={d: [1.0], d2: [2.0]}, spark=spark)
    assert e.evaluate([i], parameters={d: [1.0]}, spark=spark)[i].item() == 3.0


def test_functions(spark):
    s, k = TimeseriesIndex("s", np.array([1.0, 2.0, 3.0])), Index("k", None)
    o = Index("o", function_call("roll", s, by=k))
    m = model(s, k, o)
    r = Evaluation(Scenario(m)).evaluate(parameters={k: [1.0, 10.0]}, functions={"roll": lambda a, by: np.roll(a, 1) * by}, spark=spark)
    np.testing.assert_array_equal(r[o], [[3, 1, 2], [30, 10, 20]])
    with pytest.raises(FunctionNotFound):
        Evaluation(Scenario(m)).evaluate(parameters={k: [1.0]}, spark=spark)
    with pytest.raises(ValueError):
        adapt(abs, "row")


def test_values_must_be_given(spark):
    p = expr.placeholder("free")
    with pytest.raises(PlaceholderValueNotProvided):
        Evaluation(Scenario(model(Index("x", p + 1)))).evaluate(spark=spark)
    assert Evaluation(Scenario(model(x := Index("x", expr.placeholder("d", 4.0) + 1)))).evaluate(spark=spark)[x].item() == 5.0
    a, b = TimeseriesIndex("a", np.arange(3.0)), ConstTimeseriesIndex("b", np.arange(4.0))
    with pytest.raises(ValueError, match="lengths"):
        Evaluation(Scenario(model(a, b, Index("c", a + b)))).evaluate(spark=spark)


def test_shared_values_are_not_recomputed_exponentially(spark):
    x = Index("x", 1.0)
    n = x + 1
    for _ in range(40):
        n = n * 0.5 + n * 0.5
    p = Index("p", None)
    out = Index("out", n * p)
    r = Evaluation(Scenario(model(x, p, out))).evaluate([out], parameters={p: [1.0, 2.0]}, spark=spark)
    np.testing.assert_allclose(r[out], [2.0, 4.0])


def variant(q, selector, functions=("fa", "fb")):
    def make(f):
        return Model(f, inputs={"q": q}, outputs={"o": Index("o", function_call(f, q))})

    return ModelVariant("v", {"a": make(functions[0]), "b": make(functions[1])}, selector)


def test_functions_in_branches_see_their_own_rows(spark):
    def strict(x):
        assert (x > 0).all()
        return np.sqrt(x)

    q, sel = Index("q", None), CategoricalIndex("sel", {"a": 0.5, "b": 0.5})
    v = variant(q, sel)
    rows = [(0.25, {sel: "a", q: 4.0}), (0.25, {sel: "b", q: -3.0}), (0.5, {sel: "a", q: 9.0})]
    r = Evaluation(Scenario(v)).evaluate([v.outputs.o, sel], ensemble=rows, functions={"fa": strict, "fb": np.square}, spark=spark)
    np.testing.assert_array_equal(r[v.outputs.o], [2, 9, 3])
    assert r[sel].tolist() == ["a", "b", "a"] and r.expected_value(v.outputs.o) == 4.25
    plan = Evaluation(Scenario(v)).build_plan([v.outputs.o], strategy="regional")
    assert plan.strategy == "regional" and [g.guard.key for g in plan.regions if g.guard] == ["a", "b"]
    np.testing.assert_array_equal(Evaluation(Scenario(v)).execute_plan(plan, ensemble=rows, functions={"fa": strict, "fb": np.square}, spark=spark)[v.outputs.o], [2, 9, 3])


def test_regions_evaluate_branches_on_their_own_scenarios(spark):
    def positive(x):
        assert (x > 0).all()
        return np.sqrt(x)

    def negative(x):
        assert (x < 0).all()
        return -x

    functions = {"fa": adapt(positive, "vector"), "fb": adapt(negative, "vector")}
    q, p, sel = Index("q", None), Index("p", None), CategoricalIndex("sel", {"a": 0.5, "b": 0.5})
    v = variant(q, sel)
    after, twice = Index("after", v.outputs.o * p), Index("twice", q * 2)
    inner = v.variants["a"].outputs.o
    rows = [(0.25, {sel: "a", q: 4.0}), (0.25, {sel: "b", q: -3.0}), (0.5, {sel: "a", q: 9.0})]
    r = Evaluation(Scenario(v)).evaluate([after, v.outputs.o, twice, inner, p], "regional", ensemble=rows, functions=functions, parameters={p: [1.0, 10.0]}, spark=spark)
    np.testing.assert_array_equal(r[after], [[2, 3, 3], [20, 30, 30]])
    np.testing.assert_array_equal(r[v.outputs.o], [[2, 3, 3]])
    np.testing.assert_array_equal(r[twice], [[8, -6, 18]])
    np.testing.assert_array_equal(r[inner], [[2, np.nan, 3]])
    assert r[p].shape == (2, 1) and r.expected_value(v.outputs.o) == 0.25 * 2 + 0.25 * 3 + 0.5 * 3
    plan = r.frame(v.outputs.o)._jdf.queryExecution().optimizedPlan().toString()
    python = [k for k, line in enumerate(plan.split("\n")) if "ArrowEvalPython" in line]
    assert len(python) == 2 and plan.count("Union") == 1  # one call a branch, each on rows that were filtered before
    # no key holds: no value
    v = variant(q, [("a", q > 5), ("b", q < 0)])
    r = Evaluation(Scenario(v)).evaluate([v.outputs.o], "regional", ensemble=[(1.0, {q: 9.0}), (1.0, {q: -1.0}), (1.0, {q: 2.0})], functions=functions, spark=spark)
    np.testing.assert_array_equal(r[v.outputs.o], [3, 1, np.nan])


def test_regions_that_are_refused(spark):
    q, p, sel = Index("q", None), Index("p", None), CategoricalIndex("sel", {"a": 0.5, "b": 0.5})
    functions = {"fa": np.sqrt, "fb": np.square}
    v = variant(q, sel)
    with pytest.raises(NotImplementedError):
        Evaluation(Scenario(v)).evaluate([v.outputs.o], "regional", functions=functions, parameters={q: [1.0], sel: ["a"]}, spark=spark)
    w = variant(q, [("a", p > 1), ("b", True)])
    with pytest.raises(NotImplementedError, match="PARAMETER axes"):
        Evaluation(Scenario(w)).evaluate([w.outputs.o, p], "regional", ensemble=[(1.0, {q: 1.0})], functions=functions, parameters={p: [1.0, 2.0]}, spark=spark)
    with pytest.raises(ValueError, match="No variant_selector found"):
        Evaluation(Scenario(model(q))).build_plan(strategy="regional")
    s, grown = DistributionIndex("s", dist.uniform), CategoricalIndex("sel", {"a": 0.5, "b": 0.5})
    x = variant(s, grown)
    e = Evaluation(Scenario(x))
    one = e.evaluate([x.outputs.o], ensemble=DistributionEnsemble(Scenario(x), 30, seed=4), functions=functions, spark=spark)
    h = evaluate_incremental(e, 20, [x.outputs.o], "regional", seed=4, functions=functions, spark=spark)
    np.testing.assert_allclose(h.extend(10)[x.outputs.o], one[x.outputs.o])


def test_functions_that_shrink_time(spark):
    s, k, c = TimeseriesIndex("s", np.array([1.0, 5.0, 3.0])), Index("k", None), ConstTimeseriesIndex("c", np.array([0.0, 1.0, 2.0]))
    o = Index("o", function_call("at", s * k, c, limit=k) + 1)
    share = Index("share", s / function_call("peak", s))
    functions = {"at": adapt(lambda x, t, limit: t[x.argmax()] + limit, "summary"), "peak": adapt(np.max, "summary")}
    r = Evaluation(Scenario(model(s, k, c, o, share))).evaluate([o, share], parameters={k: [1.0, -1.0]}, functions=functions, spark=spark)
    assert r[o].tolist() == [[3.0], [0.0]]
    np.testing.assert_allclose(r[share], [[0.2, 1.0, 0.6]])


def test_only_domain_axes_are_reduced(spark):
    x = Index("x", None)
    with pytest.raises(UnsupportedOperation):
        Evaluation(Scenario(model(x, o := Index("o", expr.reduce("sum", x, Axis("x", PARAMETER)))))).evaluate([o], parameters={x: [1.0]}, spark=spark)


def test_marginalize_and_deprecated_names(spark):
    x = Index("x", None)
    e = Evaluation(Scenario(model(x)))
    r = e.evaluate([x], ensemble=[(1.0, {x: 1.0}), (3.0, {x: 5.0})], spark=spark)
    with pytest.warns(DeprecationWarning):
        assert r.marginalize(x) == r.expected_value(x) == 4.0
    with pytest.warns(DeprecationWarning):
        assert e.evaluate([x], axes={x: [7.0]}, spark=spark)[x].tolist() == [7.0]


def test_variant_by_guards_and_as_parameter(spark):
    x = Index("x", None)
    make = lambda k, f: Model(k, inputs={"x": x}, outputs={"y": Index("y", f)})
    v = ModelVariant("v", {"low": make("low", x * 1), "high": make("high", x * 10)}, [("low", x < 150), ("high", True)])
    r = Evaluation(Scenario(v)).evaluate([v.outputs.y], parameters={x: [100.0, 200.0, 300.0]}, spark=spark)
    assert r[v.outputs.y].tolist() == [100, 2000, 3000]
    sel = CategoricalIndex("sel", {"low": 0.5, "high": 0.5})
    v = ModelVariant("v", {"low": make("low", x * 1), "high": make("high", x * 10)}, sel)
    r = Evaluation(Scenario(v, {x: 2.0})).evaluate([v.outputs.y], parameters={sel: ["low", "high"]}, spark=spark)
    assert r[v.outputs.y].tolist() == [2, 20]


def test_growing_equals_one_evaluation(spark):
    a, b = DistributionIndex("a", dist.uniform), DistributionIndex("b", dist.norm)
    o = Index("o", a * 2 + b)
    m = model(a, b, o)
    e = Evaluation(Scenario(m))
    h = evaluate_incremental(e, 30, [o], seed=5, spark=spark)
    assert h.extend(0) is h.result and h.result[o].shape == (30,)
    assert h.extend(20) is h.result and h.result.full_shape == (50,)
    one = e.evaluate([o], ensemble=DistributionEnsemble(Scenario(m), 50, seed=5), spark=spark)
    np.testing.assert_allclose(h.result[o], one[o])
    np.testing.assert_allclose(h.result.expected_value(o), one.expected_value(o))
    assert {r["weight"] for r in h.result.weights.collect()} == {1 / 50} and h.result.table(o=o).count() == 50
    with pytest.raises(NotImplementedError):
        h.extend(3, extra_parameters={a: 1})
    with pytest.raises(ValueError):
        evaluate_incremental(e, 3, [o], ensemble=RowsEnsemble([(1.0, {a: 100.0})]))
    with pytest.raises(NotImplementedError):
        evaluate_incremental(e, 3, [o], ensemble=PartitionedEnsemble(Scenario(m), [EnsembleAxisSpec("x", 2, [a]), EnsembleAxisSpec("y", 2, [b])]))
    h.release()
    np.testing.assert_allclose(h.result[o], one[o])


def test_growing_with_a_generator_and_parameters(spark):
    a, p = DistributionIndex("a", dist.uniform), Index("p", None)
    o, c = Index("o", a * p), Index("c", p + 1)
    e = Evaluation(Scenario(model(a, p, o, c)))
    h = evaluate_incremental(e, 3, [o, c], rng=np.random.default_rng(2), parameters={p: [1.0, 10.0]}, spark=spark)
    r = h.extend(4)
    g = np.random.default_rng(2)
    u = np.concatenate([g.uniform(0, 1, 3), g.uniform(0, 1, 4)])
    np.testing.assert_allclose(r[o], [u, 10 * u])
    assert r[c].tolist() == [[2.0], [11.0]] and r.expected_value(c).tolist() == [2.0, 11.0]


def test_growing_in_the_background(spark):
    a = DistributionIndex("a", dist.uniform)
    o = Index("o", function_call("slow", a))
    m = model(a, o)
    calls = spark.sparkContext.accumulator(0)

    def slow(x):
        calls.add(len(x))
        return x * 2

    functions = {"slow": adapt(slow, "vector")}
    free = threading.Event()
    with concurrent.futures.ThreadPoolExecutor(max_workers=1) as pool:
        pool.submit(free.wait)
        h = submit_evaluate(Evaluation(Scenario(m)), 20, [o], seed=5, spark=spark, pool=pool, functions=functions)
        assert h.poll() == (False, None)
        with pytest.raises(RuntimeError, match="still running"):
            h.result
        with pytest.raises(RuntimeError, match="cannot extend"):
            h.extend(3)
        free.set()
        assert h.get(120)[o].shape == (20,)
    assert calls.value == 20  # computed in the background, and kept
    done, r = h.poll()
    assert done and r is h.result and h.extend(10)[o].shape == (30,) and h.result.full_shape == (30,)
    bad = submit_evaluate(Evaluation(Scenario(m)), 5, [o], spark=spark, functions={})
    with pytest.raises(FunctionNotFound):
        bad.get(60)


def test_streamed_scenarios(spark, tmp_path):
    spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 4.0), ("b", 1.0, 5.0)], "k string, w double, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, w double, v double").parquet(str(tmp_path / "in"))
    q = running_expectation(stream, ["k"], "v", "w", "running_test")
    q.processAllAvailable()
    q.stop()
    assert {r["k"]: r["value"] for r in spark.sql("select * from running_test").collect()} == {"a": 3.25, "b": 5.0}


def test_constraint_fields_of_a_resort(spark):
    """One scenario of a tourism model: four constraints on a grid of presences, against known values."""
    grid = [1000.0, 2000.0, 5000.0, 10000.0, 20000.0, 50000.0]
    t, e, x = Index("t", None), Index("e", None), ConstIndex("x", 1 + 2 * float(np.random.default_rng(4).uniform()))
    usage = {
        "parking": (t * 0.02 / (2.5 * 1.02) + e * 0.80 / (2.5 * 3.5), dist.uniform(350, 100)),
        "beach": (t * 0.50 / x + e * 0.80 / 1.02, dist.uniform(6000, 1000)),
        "beds": (t * 0.90 / 1.05, dist.lognorm(0.125, 0, 5000)),
        "food": ((t * 0.20 + e * 0.40) / (0.9 * 2), dist.triang(0.5, 3000, 1000)),
    }
    indexes = {k: Index(k, n) for k, (n, _) in usage.items()}
    r = Evaluation(Scenario(model(t, e, x, *indexes.values()))).evaluate(list(indexes.values()), parameters={t: grid, e: grid}, spark=spark)
    got = {k: 1 - d.cdf(np.broadcast_to(r[indexes[k]], (6, 6))) for k, (_, d) in usage.items()}
    two, three = [1, 1, 0, 0, 0, 0], [1, 1, 1, 0, 0, 0]
    np.testing.assert_allclose(got["parking"], [[1, 1, 0, 0, 0, 0]] * 5 + [[0] * 6], rtol=1e-5, atol=1e-8)
    np.testing.assert_allclose(got["beach"], [three] * 4 + [two, [0] * 6], rtol=1e-5, atol=1e-8)
    np.testing.assert_allclose(got["beds"][:, 0], [1, 1, 0.891250437, 8.09024620e-06, 0, 0], rtol=1e-5, atol=1e-8)
    food = [[1, 1, 1, 1, 0, 0]] * 3 + [[1, 1, 1, 7 / 9, 0, 0], [1, 1, 7 / 9, 0, 0, 0], [0] * 6]
    np.testing.assert_allclose(got["food"], food, rtol=1e-5, atol=1e-8)


def test_pricing_model_against_numpy(spark):
    """A day of traffic with a price window: sampled half-value price, shifted trips, totals; all against NumPy."""
    rng = np.random.RandomState(42)
    inflow = 500 + 100 * np.sin(np.arange(48) / 7) ** 2
    ts = np.arange(48) * 1800.0
    p50, flow, clock = DistributionIndex("p50", dist.uniform, {"loc": 4, "scale": 7}), TimeseriesIndex("inflow", inflow), TimeseriesIndex("ts", ts)
    h, start, end = -math.log(2), 27000.0, 70200.0
    rigid = exp(5.0 / p50 * h) * 0.85
    inside = (clock >= start) & (clock <= end)
    early = exp(piecewise(((clock - start) / 3600, clock >= start), (float("inf"), True)) / 0.5 * h) * (0.85 - rigid) * flow
    moved = Index("moved", early.sum() if hasattr(early, "sum") else expr.reduce("sum", early, TIME))
    modified = Index("modified", where(inside, (0.15 + rigid) * flow, flow + moved / 48))
    total = Index("total", modified.sum())
    m = model(p50, flow, clock, moved, modified, total)
    r = Evaluation(Scenario(m)).evaluate([total, modified, p50], ensemble=DistributionEnsemble(Scenario(m), 5, rng=rng), spark=spark)
    u = 4 + 7 * np.random.RandomState(42).uniform(0, 1, 5)
    np.testing.assert_allclose(r[p50].ravel(), u)
    ri = 0.85 * np.exp(5 / u * h)[:, None]
    ins = (ts >= start) & (ts <= end)
    mv = (np.exp(np.where(ts >= start, (ts - start) / 3600, np.inf) / 0.5 * h) * (0.85 - ri) * inflow).sum(1, keepdims=True)
    mod = np.where(ins, (0.15 + ri) * inflow, inflow + mv / 48)
    np.testing.assert_allclose(r[modified], mod)
    np.testing.assert_allclose(r.expected_value(total), mod.sum(1).mean())
