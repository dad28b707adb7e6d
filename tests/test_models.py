import dataclasses
import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from axiloom.functions import distributions as dist
from axiloom.index import CategoricalIndex, ConditionalCategoricalIndex, ConditionalDistributionIndex, ConstIndex, ConstTimeseriesIndex, DistributionIndex, Index, TimeseriesIndex
from axiloom.model import AbstractIndexNotInInputsWarning, InputsContractWarning, Model, ModelVariant
from axiloom.operators import analytics
from axiloom.scenario import Scenario
from axiloom.sources.ensembles import CrossProductEnsemble, DistributionEnsemble, EnsembleAxisSpec, PartitionedEnsemble, RowsEnsemble, sample_across

pytestmark = pytest.mark.filterwarnings("ignore::DeprecationWarning", "ignore::axiloom.model.ModelContractWarning")


def m(*i):
    return Model("m", list(i))


def test_contract():
    @dataclasses.dataclass
    class Inputs:
        a: Index
        many: list

    a, b, c = Index("a", 1.0), Index("b", 2.0), Index("c", 3.0)
    model = Model("x", inputs=Inputs(a, [b, a]), outputs={"c": c, "d": {"k": c}})
    assert [i.name for i in model.indexes] == ["a", "b", "c"]
    assert model.inputs.a is a and len(model.inputs) == 2 and b in model.inputs and c not in model.inputs
    with pytest.raises(AttributeError):
        model.inputs.a = b
    with pytest.raises(AttributeError):
        model.outputs.nothing
    with pytest.raises(ValueError):
        Model("x", [a], inputs={"a": a})
    with pytest.warns(AbstractIndexNotInInputsWarning):
        Model("x", outputs={"d": Index("d", None)})
    with pytest.warns(DeprecationWarning):
        Model("x", [a])
    assert model.is_instantiated() and m(Index("n", None)).abstract_indexes()[0].name == "n"


def test_index_kinds():
    with pytest.raises(TypeError):
        Index("x", dist.uniform())
    for bad in ({}, {"a": 0.0, "b": 1.0}, {"a": 0.4}):
        with pytest.raises(ValueError):
            CategoricalIndex("c", bad)
    c = CategoricalIndex("c", {"a": 0.25, "b": 0.75})
    drawn = c.sample(np.random.default_rng(1), 4000)
    assert abs((drawn == "b").mean() - 0.75) < 0.03
    child = ConditionalCategoricalIndex("d", [c], ["x", "y"], lambda c: {"x": 1.0} if c == "a" else {"x": 0.5, "y": 0.5})
    with pytest.raises(ValueError):
        child.outcomes_for(c="a")
    assert child.outcomes_for(c="b") == {"x": 0.5, "y": 0.5}
    with pytest.raises(TypeError):
        ConditionalDistributionIndex("e", [Index("i", 1.0)], lambda i: dist.norm())


ARRAY, D = np.arange(3.0), dist.norm()
CAT = {"a": 0.5, "b": 0.5}


@pytest.mark.parametrize(
    ("kind", "value", "error"),
    [
        ("index", 1.0, None), ("index", D, TypeError), ("index", ARRAY, TypeError), ("index", CAT, TypeError),
        ("series", ARRAY, None), ("series", 1.0, TypeError), ("series", np.ones((2, 2)), TypeError),
        ("const", 1.0, TypeError), ("const_series", ARRAY, TypeError),
        ("random", D, None), ("random", 1.0, TypeError), ("random", "a", TypeError), ("given", D, TypeError), ("given", 1.0, TypeError),
        ("cat", "a", None), ("cat", "z", ValueError), ("cat", {"a": 1.0}, None), ("cat", {}, ValueError), ("cat", {"z": 1.0}, ValueError), ("cat", {"a": 0.4}, ValueError), ("cat", {"a": 1.5, "b": -0.5}, ValueError), ("cat", 1.0, TypeError),
        ("given_cat", "x", None), ("given_cat", "z", ValueError), ("given_cat", CAT, TypeError),
    ],
)
def test_overrides(kind, value, error):
    cat = CategoricalIndex("cat", CAT)
    made = {
        "index": Index("i", 2.0), "series": TimeseriesIndex("s", ARRAY), "const": ConstIndex("c", 1.0), "const_series": ConstTimeseriesIndex("cs", ARRAY), "random": DistributionIndex("r", dist.uniform),
        "given": ConditionalDistributionIndex("g", [cat], lambda cat: D), "cat": cat, "given_cat": ConditionalCategoricalIndex("gc", [cat], ["x"], lambda cat: {"x": 1.0}),
    }
    i = made[kind]
    if error:
        with pytest.raises(error):
            Scenario(m(*made.values()), {i: value})
        return
    s = Scenario(m(*made.values()), {i: value})
    abstract = any(x is i for x in s.abstract_indexes())
    assert abstract == (isinstance(value, dict) or value is D)
    if kind == "random":
        assert s.effective_distribution(i) is D
    if kind == "cat":
        assert s.effective_outcomes(i) == (value if isinstance(value, dict) else {"a": 1.0})


def test_cross_product(spark):
    line = CategoricalIndex("line", {"north": 0.25, "south": 0.75})
    delay = ConditionalCategoricalIndex("delay", [line], ["none", "long"], lambda line: {"none": 0.6, "long": 0.4} if line == "north" else {"none": 0.9, "long": 0.1})
    wait = ConditionalDistributionIndex("wait", [delay], lambda delay: dist.uniform(20 if delay == "long" else 0, 5))
    s = Scenario(m(line, delay, wait))
    e = CrossProductEnsemble(s, seed=1)
    assert len(e) == e.size == 4 and abs(e.ensemble_weights[0].sum() - 1) < 1e-12
    (t,) = e.tables(spark)
    rows = t.df.orderBy(t.axis.key).collect()
    at = {i.name: f"n{i.node.id}" for i in (line, delay, wait)}
    assert [(r[at["line"]], r[at["delay"]]) for r in rows] == [("north", "none"), ("north", "long"), ("south", "none"), ("south", "long")]
    np.testing.assert_allclose([r[t.weight] for r in rows], [0.15, 0.1, 0.675, 0.075])
    assert all((r[at["wait"]] >= 20) == (r[at["delay"]] == "long") for r in rows)
    have = e.assignments()
    assert have[line].tolist() == ["north", "north", "south", "south"] and have[wait].tolist() == [r[at["wait"]] for r in rows]
    assert "Join" in t.df._jdf.queryExecution().optimizedPlan().toString()
    r = CrossProductEnsemble(s, restrictions={delay: ["none"]})
    assert len(r) == 2
    np.testing.assert_allclose(r.ensemble_weights[0], [0.25, 0.75])
    for rng in (None, np.random.default_rng(0)):
        assert len(CrossProductEnsemble(s, max_categorical_size=1, rng=rng)) == len(CrossProductEnsemble(s, max_categorical_size=1, rng=rng).ensemble_weights[0]) == 1
    pinned = CrossProductEnsemble(Scenario(m(line, delay, wait), {line: "south"}))
    np.testing.assert_allclose(pinned.ensemble_weights[0], [0.9, 0.1])
    changed = CrossProductEnsemble(Scenario(m(line, delay, wait), {line: {"north": 0.9, "south": 0.1}}))
    assert abs(changed.ensemble_weights[0][:2].sum() - 0.9) < 1e-12
    seeded = CrossProductEnsemble(s, rng=np.random.default_rng(2))
    np.testing.assert_allclose(seeded.ensemble_weights[0], e.ensemble_weights[0])
    drawn = sample_across(seeded, [wait], total=100, rng=np.random.default_rng(3))[wait]
    assert len(drawn) == 15 + 10 + 68 + 8
    in_place = sample_across(e, [wait], total=100)[wait]
    assert len(in_place) == 15 + 10 + 68 + 8 and len(set(in_place.tolist())) == len(in_place) and ((in_place[:15] < 5).all() and (in_place[15:25] >= 20).all())
    free = DistributionIndex("free", dist.uniform)
    with pytest.raises(ValueError, match="not in the ensemble"):
        sample_across(DistributionEnsemble(Scenario(m(free)), 2), [wait])


def test_foreign_distributions(spark):
    class Dice:
        """A distribution that can be sampled and knows its cdf on arrays, and no more."""

        def cdf(self, x):
            return np.clip(np.floor(x) / 6, 0, 1)

        def rvs(self, size=None, random_state=None):
            return random_state.integers(1, 7, size)

        def mean(self):
            return 3.5

        def std(self):
            return (35 / 12) ** 0.5

    a, b = DistributionIndex("a", Dice), DistributionIndex("b", dist.uniform)
    s = Scenario(m(a, b))
    read = lambda n, start: {r["e__ensemble"]: (r[f"n{a.node.id}"], r[f"n{b.node.id}"]) for r in DistributionEnsemble(s, n, seed=3, start=start).tables(spark)[0].df.collect()}
    whole = read(9000, 0)
    assert sorted(whole) == list(range(9000)) and {v for v, _ in whole.values()} == {1, 2, 3, 4, 5, 6} and abs(np.mean([v for v, _ in whole.values()]) - 3.5) < 0.1
    assert read(5000, 0) | read(4000, 5000) == whole
    kind = CategoricalIndex("kind", {"x": 0.5, "y": 0.5})
    e = CrossProductEnsemble(Scenario(m(a, kind)), seed=3)
    assert len(e.assignments()[a]) == 2
    df = spark.createDataFrame([(0.0,), (2.5,), (9.0,)], "u double").withColumn("p", analytics.satisfaction(F.col("u"), Dice()))
    assert [round(r["p"], 9) for r in df.collect()] == [1.0, round(2 / 3, 9), 0.0]


def test_samples_of_indexes():
    rng = np.random.default_rng(1)
    a = DistributionIndex("a", dist.norm, {"loc": 3})
    c = CategoricalIndex("c", {"x": 0.9, "y": 0.1})
    given = ConditionalDistributionIndex("g", [c], lambda c: dist.uniform(10 if c == "x" else 0))
    key = ConditionalCategoricalIndex("k", [c], ["l", "r"], lambda c: {"l": 0.99, "r": 0.01} if c == "x" else {"l": 0.01, "r": 0.99})
    assert abs(a.sample(rng, 4000).mean() - 3) < 0.1 and isinstance(a.sample(rng), float)
    assert (given.sample_for(rng, 10, c="x") >= 10).all() and (given.sample_for(rng, 10, c="y") < 1).all()
    assert (key.sample_for(rng, 100, c="x") == "l").mean() > 0.8 > 0.2 > (key.sample_for(rng, 100, c="y") == "l").mean()


def test_arguments_that_are_no_inputs():
    class Shop(Model):
        def __init__(self, price, rates, named, label="shop"):
            super().__init__(label, inputs={"price": price}, outputs={"o": Index("o", price * 2)})

    p, q, r = Index("p", 1.0), Index("q", 2.0), Index("r", 3.0)
    with pytest.warns(InputsContractWarning) as seen:
        Shop(p, [q], named={"r": r})
    said = [str(w.message) for w in seen if issubclass(w.category, InputsContractWarning)]
    assert len(said) == 2 and "rates[0]" in said[0] and "named['r']" in said[1]
    with warnings.catch_warnings():
        warnings.simplefilter("error", InputsContractWarning)
        Shop(p, [], {})


def test_flat_models_name_indexes_by_attribute():
    class Flat(Model):
        def __init__(self, ins, outs, both=False):
            self.first, self.second = Index("x", 1.0), Index("y", 2.0)
            super().__init__("flat", [self.first, self.second], inputs=ins(self), outputs=outs(self))

    f = Flat(lambda s: [s.first], lambda s: [s.second])
    assert f.inputs.first is f.first and f.outputs.second is f.second and f.outputs.names() == ["second"]
    for ins, said in ((lambda s: [Index("z", 1.0)], "not in the model's indexes"), (lambda s: [s.first, s.first], "collision")):
        with pytest.raises(ValueError, match=said):
            Flat(ins, lambda s: [])
    loose = Index("l", 1.0)
    with pytest.raises(ValueError, match="not assigned"):
        Model("m", [loose], inputs=[loose])


def test_draws_do_not_depend_on_partitions_and_replay_follows_the_generator(spark):
    a, b = DistributionIndex("a", dist.uniform), DistributionIndex("b", dist.norm, {"loc": 3})
    s = Scenario(m(a, b))
    one = sorted(map(tuple, DistributionEnsemble(s, 100, seed=4).tables(spark)[0].df.collect()))
    two = sorted(map(tuple, DistributionEnsemble(s, 100, seed=4).tables(spark)[0].df.repartition(7).collect()))
    assert one == two
    assert 0.4 < np.mean([r[2] for r in one]) < 0.6 and 2.7 < np.mean([r[3] for r in one]) < 3.3
    (t,) = DistributionEnsemble(s, 3, rng=np.random.default_rng(8)).tables(spark)
    g = np.random.default_rng(8)
    want = [g.uniform(0, 1, 3), dist.norm(3).ppf(g.uniform(0, 1, 3))]
    np.testing.assert_allclose(np.array([[r[2], r[3]] for r in t.df.orderBy("e__ensemble").collect()]).T, want)


def test_ensembles_check_what_they_cover():
    a, n = DistributionIndex("a", dist.uniform), Index("n", None)
    with pytest.raises(ValueError):
        DistributionEnsemble(Scenario(m(a, n)), 3)
    (only,) = DistributionEnsemble(Scenario(m(a, n)), 3, exclude=[n]).indexes
    assert only is a
    for axes, default in (([], None), ([EnsembleAxisSpec("x", 2, [a]), EnsembleAxisSpec("y", 2, [a])], None), ([EnsembleAxisSpec("x", 2, [Index("o", None)])], None)):
        with pytest.raises(ValueError):
            PartitionedEnsemble(Scenario(m(a)), axes, default)
    with pytest.raises(ZeroDivisionError):
        RowsEnsemble([(0.0, {a: 1.0})])


def test_variants():
    x = Index("x", 1.0)
    make = lambda k, *names: Model(k, inputs={"x": x}, outputs={n: Index(n, x * 2) for n in names})
    with pytest.raises(ValueError):
        ModelVariant("v", {"a": make("a", "y"), "b": make("b", "z")}, "a")
    with pytest.raises(ValueError):
        ModelVariant("v", {"a": make("a", "y")}, "c")
    v = ModelVariant("v", {"a": make("a", "y"), "b": make("b", "y")}, "b")
    assert v.outputs.y is v.variants["b"].outputs.y and v.is_instantiated()


def test_distributions():
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        for d in (dist.uniform(2, 3), dist.norm(1, 2), dist.lognorm(0.4, 1, 2), dist.triang(0.3, 1, 4), dist.truncnorm(-1, 2, 5, 2)):
            u = np.linspace(0.01, 0.99, 33)
            np.testing.assert_allclose(d.cdf(d.ppf(u)), u, atol=1e-9)
            sample = d.ppf((np.arange(100_000) + 0.5) / 100_000)
            np.testing.assert_allclose([sample.mean(), sample.std()], [d.mean(), d.std()], rtol=5e-3)
    assert abs(dist.poisson_cdf(3, 2.5) - 0.7575761331330662) < 1e-12 and abs(dist.student_ppf(0.975, 10) - 2.2281388519649385) < 1e-9
    k, mu = np.meshgrid([-1.0, 0.0, 0.5, 3.0, 40.0, 300.0], [0.0, 1e-3, 2.5, 39.0, 41.0, 280.0, np.nan])
    want = [[np.nan if np.isnan(y) else sum(np.exp(i * np.log(y) - y - math.lgamma(i + 1)) if y else float(i == 0) for i in range(int(np.floor(x)) + 1)) for x in k[0]] for y in mu[:, 0]]
    np.testing.assert_allclose(dist.poisson_cdf(k, mu), want, rtol=1e-9, atol=1e-12)
