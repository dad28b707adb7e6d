"""Evaluation of a scenario over parameters, ensembles and time, and its results."""

from __future__ import annotations

import inspect
import os
import sys
import warnings
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axiloom.axes import ENSEMBLE, PARAMETER, TIME, Axis, layout
from axiloom.errors import NodeValueNotFound
from axiloom.functions.numeric import kind_of
from axiloom.functions.registry import Function, adapt
from axiloom.index import CategoricalIndex, ConstIndex, ConstTimeseriesIndex, GenericIndex
from axiloom.plans.expr import LEAVES, Node, as_node, constant, linearize
from axiloom.plans.lower import Binding, Lowering
from axiloom.scenario import Scenario
from axiloom.sources.ensembles import RowsEnsemble
from axiloom.sources.frames import SPARK_TYPE, AxisTable, BoundFrame, array_table, local_frame, value_kind


@dataclass(frozen=True)
class RegionGuard:
    """Rows whose selector has this key."""

    selector: Node
    key: str


@dataclass(frozen=True)
class Region:
    """Nodes evaluated together, under a guard or under none, after the regions they depend on."""

    ident: int
    nodes: tuple[Node, ...]
    guard: RegionGuard | None = None
    depends_on: frozenset[int] = frozenset()


@dataclass(frozen=True)
class EvaluationPlan:
    nodes_of_interest: tuple[Any, ...]
    regions: tuple[Region, ...]
    strategy: str = "monolithic"


def region_plan(nodes: Sequence[Node], roots: Sequence[Any]) -> EvaluationPlan:
    """Shared nodes, the branches of the one selector, and what follows their meeting."""
    selectors = [n for n in nodes if n.op == "variant_selector"]
    if not selectors:
        raise ValueError("No variant_selector found: a regional plan needs a variant chosen at run time")
    if len(selectors) > 1:
        raise NotImplementedError("a regional plan has one selector")
    (selector,) = selectors
    shared = linearize([selector.args[0]])
    known = {n.id for n in shared}
    regions = [Region(0, tuple(shared))]
    for k, (key, outputs) in enumerate(selector.params["branches"].items(), 1):
        own = [n for n in linearize(outputs, boundary=shared) if n.id not in known]
        known |= {n.id for n in own}
        regions.append(Region(k, tuple(own), RegionGuard(selector.args[0], key), frozenset([0])))
    rest = tuple(n for n in nodes if n.id not in known)
    regions.append(Region(len(regions), rest, None, frozenset(range(len(regions)))))
    return EvaluationPlan(tuple(roots), tuple(regions), "regional")


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


@dataclass
class EvaluationResult:
    """Values as frames: one per index, keyed by the axes it varies on."""

    lowering: Lowering
    axes: list[Axis]
    tables: dict[Axis, AxisTable]
    parameter_values: dict[Any, np.ndarray] = field(default_factory=dict)
    named_axis_values: dict[str, np.ndarray] = field(default_factory=dict)
    weights_by_axis: dict[Axis, Any] = field(default_factory=dict)
    _sizes: dict[Axis, int] = field(default_factory=dict)

    def frame(self, what: Any) -> DataFrame:
        """Key columns, weights of ensembles, and ``value``."""
        return self._of(what)[1]

    def persist(self, nodes: Iterable[Any], level: Any) -> None:
        """Keep the frames that hold the nodes' values, once they are computed."""
        wanted = {(p.depth, p.axes) for n in nodes if (p := self.lowering.placed[as_node(n).id]).literal is None}
        self._kept = {g: self.lowering.frames[g].persist(level) for g in wanted}
        self.lowering.frames.update(self._kept)

    def compute(self) -> None:
        """Compute what is to be kept, now."""
        for df in getattr(self, "_kept", {}).values():
            df.write.format("noop").mode("overwrite").save()

    def unpersist(self) -> None:
        for df in getattr(self, "_kept", {}).values():
            df.unpersist()


    def _of(self, what: Any) -> tuple[list[Axis], DataFrame]:
        n = as_node(what)
        if n.id not in self.lowering.placed:
            raise NodeValueNotFound(getattr(what, "name", "") or f"n{n.id}")
        axes, df = self.lowering.frame(n)
        flags = os.environ.get("AXILOOM_FLAGS", "").split(",")
        if "trace" in flags:
            for m in self.lowering.order:
                print(repr(m), "axes", sorted(a.name for a in self.lowering.placed[m.id].axes))
        if "trace" in n.flags:
            print(repr(n), "axes", [a.name for a in axes])
            df.show(10)
        if "dump" in flags:
            df.explain("formatted")
        if "break" in flags or "break" in n.flags:
            sys.breakpointhook()
        return axes, df

    def table(self, **named: Any) -> DataFrame:
        """Several values side by side, by name: one projection if they share a frame, else joined on shared keys."""
        groups: dict[Any, dict[str, Any]] = {}
        for name, what in named.items():
            p = self.lowering.placed[as_node(what).id]
            groups.setdefault(None if p.literal is not None else (p.depth, p.axes), {})[name] = p
        constants = groups.pop(None, {})
        out: DataFrame | None = None
        for (depth, axes), own in sorted(groups.items(), key=lambda g: (-len(g[0][1]), g[0][0])):
            keys = [a.key for a in layout(sorted(axes))]
            extra = [k for k in self.lowering._keys(axes) if out is None or k not in out.columns or k in keys]
            part = self.lowering.frames[(depth, axes)].select(*extra, *[F.col(p.column).alias(c) for c, p in own.items()])
            on = [k for k in keys if out is not None and k in out.columns]
            out = part if out is None else out.join(part, on) if on else out.crossJoin(part)
        out = session().range(1).select() if out is None else out
        return out.select("*", *[p.literal.alias(c) for c, p in constants.items()])

    def parameter_values_for(self, index: GenericIndex) -> np.ndarray:
        for i, v in self.parameter_values.items():
            if i is index:
                return v
        raise KeyError(getattr(index, "name", index))

    def size_of(self, axis: Axis) -> int:
        if axis not in self._sizes:
            self._sizes[axis] = self.tables[axis].df.count()
        return self._sizes[axis]

    @property
    def full_shape(self) -> tuple[int, ...]:
        return tuple(self.size_of(a) for a in self.axes)

    @property
    def weights(self) -> DataFrame:
        """Joint weights: the product over all ensemble axes, keyed by them."""
        df: DataFrame | None = None
        names = []
        for a in self.axes:
            if a.role == ENSEMBLE:
                t = self.tables[a]
                names.append(t.weight)
                part = t.df.select(a.key, t.weight)
                df = part if df is None else df.crossJoin(part)
        if df is None:
            return session().range(1).select(F.lit(1.0).alias("weight"))
        return df.select(*[a.key for a in self.axes if a.role == ENSEMBLE], _product(names).alias("weight"))

    def to_numpy(self, what: Any) -> np.ndarray:
        """The array in layout (parameters, ensembles, domain), of size 1 along axes on which it does not vary."""
        axes, df = self._of(what)
        return _as_array(axes, df.select(*[a.key for a in axes], "value"), self.axes)

    __getitem__ = to_numpy

    def expected_frame(self, what: Any) -> DataFrame:
        """The weighted average over all ensemble axes: the remaining keys and ``value``."""
        axes, df = self._of(what)
        rest = [a.key for a in axes if a.role != ENSEMBLE]
        weights = [self.tables[a].weight for a in axes if a.role == ENSEMBLE]
        if not weights:
            return df.select(*rest, "value")
        w, v = _product(weights), F.col("value").cast("double")
        return df.groupBy(*rest).agg((F.sum(w * v) / F.sum(w)).alias("value"))

    def expected_value(self, what: Any) -> np.ndarray:
        axes, _ = self._of(what)
        own = [a for a in axes if a.role != ENSEMBLE]
        full = [a for a in self.axes if a.role == PARAMETER or (a.role != ENSEMBLE and a in own)]
        return _as_array(own, self.expected_frame(what), full)

    def marginalize(self, what: Any) -> np.ndarray:
        warnings.warn("marginalize() is deprecated; use expected_value()", DeprecationWarning, stacklevel=2)
        return self.expected_value(what)


class RegionalResult(EvaluationResult):
    """Values of a model whose selector picks a branch per scenario: each branch is evaluated on its own scenarios only,
    in a lowering in which the choices are that branch's outputs, and the frames are put together. ``lowering`` is that
    of the whole model, which tells on which axes values vary but gives only what does not depend on the scenario."""

    def __init__(self, whole: EvaluationResult, axis: Axis, branches: list[EvaluationResult]):
        super().__init__(whole.lowering, whole.axes, whole.tables, whole.parameter_values, whole.named_axis_values, whole.weights_by_axis, whole._sizes)
        self._axis, self._branches = axis, branches

    def persist(self, nodes: Iterable[Any], level: Any) -> None:
        for b in self._branches:
            b.persist([n for n in nodes if as_node(n).id in b.lowering.placed], level)

    def compute(self) -> None:
        for b in self._branches:
            b.compute()

    def unpersist(self) -> None:
        for b in self._branches:
            b.unpersist()

    def _of(self, what: Any) -> tuple[list[Axis], DataFrame]:
        n = as_node(what)
        if n.id not in self.lowering.placed:
            raise NodeValueNotFound(getattr(what, "name", "") or f"n{n.id}")
        p = self.lowering.placed[n.id]
        if self._axis not in p.axes:
            return super()._of(what)
        axes = layout(sorted(p.axes))
        return axes, self._union([self._branch(b, axes, {"value": n}) for b in self._branches])

    def table(self, **named: Any) -> DataFrame:
        axes = {a for what in named.values() for a in self.lowering.placed[as_node(what).id].axes}
        if self._axis not in axes:
            return super().table(**named)
        return self._union([self._branch(b, layout(sorted(axes)), {k: as_node(v) for k, v in named.items()}) for b in self._branches])

    def _branch(self, b: EvaluationResult, axes: list[Axis], named: dict[str, Node]) -> DataFrame:
        """Keys and values on one branch's scenarios. What belongs to another branch has no value here."""
        known = {k: n for k, n in named.items() if n.id in b.lowering.placed}
        df = b.table(**known)
        for a in axes:
            if a.key not in df.columns:  # the branch does not vary along it, but others do
                df = df.crossJoin(b.tables[a].df.select(*b.lowering._keys(frozenset([a]))))
        other = {k: F.lit(None if self.lowering.placed[n.id].kind == "str" else float("nan")).alias(k) for k, n in named.items() if k not in known}
        return df.select(*self.lowering._keys(frozenset(axes)), *[other.get(k, F.col(k)) for k in named])

    def _union(self, parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def _product(names: Sequence[str]) -> Column:
    out = F.col(names[0])
    for n in names[1:]:
        out = out * F.col(n)
    return out


def _as_array(axes: Sequence[Axis], df: DataFrame, full: Sequence[Axis]) -> np.ndarray:
    """Rows as an array: they come by Arrow, in columns, and each is put where its keys' ranks say."""
    got = df.toPandas()
    axes = [a for a in full if a in axes]
    ranks, sizes = [], []
    for a in axes:
        keys, at = np.unique(got[a.key].to_numpy(), return_inverse=True)
        ranks.append(at)
        sizes.append(len(keys))
    values = got["value"].to_numpy()
    text = got["value"].dtype == object and any(isinstance(v, str) for v in values[:1])
    if values.dtype == object and not text:
        values = np.array(values.tolist())
    out = np.empty(sizes, dtype=object if text else values.dtype)
    out[tuple(ranks)] = values if axes else values[0]
    return out.reshape([sizes[axes.index(a)] if a in axes else 1 for a in full])


class Evaluation:
    """evaluate() plans; frames and arrays of the result run."""

    def __init__(self, scenario: Any):
        if not isinstance(scenario, Scenario):
            warnings.warn("Evaluation(model) is deprecated; use Evaluation(Scenario(model))", DeprecationWarning, stacklevel=2)
            scenario = Scenario(scenario)
        self.scenario = scenario

    def build_plan(self, nodes_of_interest: Iterable[Any] | None = None, strategy: str = "monolithic") -> EvaluationPlan:
        roots = list(nodes_of_interest) if nodes_of_interest is not None else list(self.scenario.model.indexes)
        nodes = linearize([as_node(r) for r in roots])
        if strategy == "regional":
            return region_plan(nodes, roots)
        if strategy != "monolithic":
            raise ValueError(f"unknown strategy {strategy!r}")
        return EvaluationPlan(tuple(roots), (Region(0, tuple(nodes)),))

    def evaluate(self, nodes_of_interest: Iterable[Any] | None = None, strategy: str = "monolithic", **kwargs: Any) -> EvaluationResult:
        return self.execute_plan(self.build_plan(nodes_of_interest, strategy), **kwargs)

    def evaluate_incremental(self, size: int, nodes_of_interest: Iterable[Any] | None = None, **kwargs: Any) -> Any:
        """A handle on ``size`` scenarios that extend(n) adds to; see axiloom.streaming.handles."""
        from axiloom.streaming import handles

        return handles.evaluate_incremental(self, size, nodes_of_interest, **kwargs)

    def submit_evaluate(self, size: int, nodes_of_interest: Iterable[Any] | None = None, **kwargs: Any) -> Any:
        """The same in the background."""
        from axiloom.streaming import handles

        return handles.submit_evaluate(self, size, nodes_of_interest, **kwargs)

    def execute_plan(
        self,
        plan: EvaluationPlan,
        *,
        ensemble: Any = None,
        parameters: Mapping[Any, Any] | None = None,
        parameter_axes: Mapping[str, Any] | None = None,
        frames: Mapping[Any, BoundFrame] | None = None,
        functions: Mapping[str, Callable[..., Any] | Function] | None = None,
        spark: SparkSession | None = None,
        axes: Mapping[Any, Any] | None = None,
    ) -> EvaluationResult:
        spark = spark or session()
        if axes is not None:
            warnings.warn("axes= is deprecated; use parameters=", DeprecationWarning, stacklevel=3)
            if parameters is not None:
                raise ValueError("give either parameters= or axes=")
            parameters = axes
        parameters, frames = dict(parameters or {}), dict(frames or {})
        if ensemble is not None and not hasattr(ensemble, "tables"):
            ensemble = RowsEnsemble(ensemble)
        b = Binding(functions={k: adapt(f) for k, f in (functions or {}).items()})
        named = {k: np.asarray(v) for k, v in (parameter_axes or {}).items()}
        axes = []
        result = EvaluationResult(None, axes, b.tables, {}, named)  # type: ignore[arg-type]
        for name, values in named.items():
            axis = Axis(name, PARAMETER)
            b.tables[axis] = AxisTable(axis, array_table(spark, axis.key, {f"v_{name}": values}), {}, {})
            axes.append(axis)
        for i, value in parameters.items():
            if isinstance(i, (ConstIndex, ConstTimeseriesIndex)):
                raise ValueError(f"index {i.name!r} is a constant and cannot be a parameter")
            if any(i is x for x in self.scenario.overridden()):
                raise ValueError(f"index {i.name!r} is overridden in the scenario and cannot be a parameter too")
            if callable(value):
                self._callable(spark, b, i, value, named)
                continue
            axis = Axis(i.name, PARAMETER)
            if axis in b.tables:
                raise ValueError(f"two parameter axes are named {i.name!r}")
            value = np.asarray(value)
            name = f"n{i.node.id}"
            b.tables[axis] = AxisTable(axis, array_table(spark, axis.key, {name: value}), {i.node.id: name}, {i.node.id: value_kind(value)})
            result.parameter_values[i] = value
            axes.append(axis)
        covered = [*parameters, *frames]
        if ensemble is not None:
            for t in ensemble.tables(spark):
                b.tables[t.axis] = t
                axes.append(t.axis)
            covered += ensemble.covers()
        if missing := [i.name for i in self.scenario.abstract_indexes() if not any(i is c for c in covered)]:
            raise ValueError(f"abstract indexes without a value: {', '.join(missing)}")
        for n, v in self.scenario.base_substitutions().items():
            if any(c.node is n for c in covered):
                continue
            if np.ndim(v):
                b.series[n.id] = np.asarray(v)
            else:
                b.scalars[n.id] = v
        for i, f in frames.items():
            b.frames[i.node.id] = (f, kind_of(f.df.schema[f.value].dataType))
        roots = [as_node(x) for x in plan.nodes_of_interest]
        nodes = linearize(roots)
        for n in nodes:
            if n.op == "timeseries_constant" and n.id not in b.series:
                b.series[n.id] = n.params["values"]
        used = {n.id for n in nodes}
        lengths = {len(v) for k, v in b.series.items() if k in used}
        if len(lengths) > 1:
            raise ValueError(f"series of different lengths: {sorted(lengths)}")
        result.lowering = Lowering(spark, roots, b)
        if plan.strategy == "regional":
            result = self._by_region(spark, plan, ensemble, result, b, roots)
        if any(TIME in p.axes for p in result.lowering.placed.values()) or any(TIME in f.keys for f in frames.values()):
            axes.append(TIME)
            if lengths:
                result._sizes[TIME] = lengths.pop()
            else:
                f = next(f for f in frames.values() if TIME in f.keys)
                b.tables.setdefault(TIME, AxisTable(TIME, f.df.select(F.col(f.keys[TIME]).alias(TIME.key)).distinct(), {}, {}))
        known = set(axes)
        axes += [a for a in layout(a for f in frames.values() for a in f.keys) if a not in known]
        return result

    def _by_region(self, spark: SparkSession, plan: EvaluationPlan, ensemble: Any, whole: EvaluationResult, b: Binding, roots: list[Node]) -> EvaluationResult:
        """The same values, with each branch's nodes lowered on the scenarios that the selector gives it."""
        selector = next(r.guard.selector for r in plan.regions if r.guard is not None)
        if ensemble is None or len(ensemble.ensemble_axes) != 1:
            raise NotImplementedError("a regional plan needs an ensemble with just one axis; use strategy='monolithic'")
        (axis,) = ensemble.ensemble_axes
        varies = whole.lowering.placed[selector.id].axes
        if any(a.role == PARAMETER for a in varies):
            raise NotImplementedError("a regional plan's selector must not vary along PARAMETER axes; use strategy='monolithic'")
        if not varies <= {axis}:
            raise NotImplementedError("a regional plan's selector varies along the ensemble's axis only; use strategy='monolithic'")
        (choice,) = [n for n in linearize(roots) if n.op == "variant_selector"]
        table = b.tables[axis]
        # the selector beside all that the ensemble gives: one frame, whose rows are then told apart
        own = Lowering(spark, [selector, *(n for n in linearize(roots) if n.id in table.columns)], b)
        key, at = own._value(selector)[0], own.placed[selector.id]
        frame, names = table.df, table.columns
        if at.literal is None and at.depth == 0:
            frame = own.frames[(at.depth, at.axes)]
            names = {k: f"n{k}" for k in table.columns if f"n{k}" in frame.columns}

        def rows(condition: Column) -> DataFrame:
            if at.literal is not None or at.depth == 0:
                return frame.where(condition)
            return frame.join(own.frames[(at.depth, at.axes)].where(condition).select(axis.key), axis.key, "left_semi")

        keys = list(choice.params["branches"])
        results = []
        for k in [*keys, None]:
            if k is None:
                if isinstance(getattr(self.scenario.model, "selector", None), CategoricalIndex):
                    continue  # its keys all have a branch
                some = rows(~F.coalesce(key.isin(keys), F.lit(False)))
                alias = {m.id: constant(float("nan")) for m in choice.params["merged"]}
            else:
                some = rows(key == k)
                alias = {m.id: m.args[2 * keys.index(k) + 1] for m in choice.params["merged"]}
            part = replace(b, tables={**b.tables, axis: AxisTable(axis, some, names, table.kinds, table.weight)})
            mine = [r for r in roots if r.id not in self._foreign(choice, k, roots)]
            results.append(EvaluationResult(Lowering(spark, mine, part, alias), whole.axes, part.tables))
        return RegionalResult(whole, axis, results)

    @staticmethod
    def _foreign(choice: Node, key: str | None, roots: list[Node]) -> set[int]:
        """The roots that belong to other branches alone."""
        shared = {n.id for n in linearize([choice.args[0]])}
        own = {n.id for n in linearize(choice.params["branches"].get(key, []))} if key is not None else set()
        other = {n.id for k, outs in choice.params["branches"].items() if k != key for n in linearize(outs)}
        return {r.id for r in roots if r.id in other - own - shared and r.op not in LEAVES}

    def _callable(self, spark: SparkSession, b: Binding, i: GenericIndex, f: Callable[..., Any], named: Mapping[str, np.ndarray]) -> None:
        """A parameter computed from named axes: as a formula on their columns if ``f`` can, else as an array."""
        if not named:
            raise ValueError(f"parameter {i.name!r} is a function and needs parameter_axes")
        wanted: dict[str, None] = {}
        for p in inspect.signature(f).parameters.values():
            if p.kind is p.VAR_POSITIONAL:
                raise TypeError(f"parameter {i.name!r}: a function of axes takes them by name, not as *{p.name}")
            if p.kind is p.VAR_KEYWORD:
                wanted |= dict.fromkeys(named)
            elif p.name in named:
                wanted[p.name] = None
            elif p.default is p.empty:
                raise ValueError(f"parameter {i.name!r}: no axis is named {p.name!r}")
        used = [n for n in named if n in wanted]
        axes = tuple(Axis(n, PARAMETER) for n in used)
        for n, a in zip(used, axes):
            b.tables[a].columns.setdefault(-1 - list(named).index(n), f"v_{n}")
        try:
            out = f(**{n: F.col(f"v_{n}") for n in used})
        except Exception:  # not a formula: NumPy code
            out = None
        if isinstance(out, Column):
            df: DataFrame | None = None
            for a in axes:
                df = b.tables[a].df if df is None else df.crossJoin(b.tables[a].df)
            b.frames[i.node.id] = (BoundFrame(df.withColumn("_value", out.cast("double")), {a: a.key for a in axes}, "_value"), "float")
            return
        grids = np.meshgrid(*[named[n] for n in used], indexing="ij", sparse=True)
        values = np.broadcast_to(np.asarray(f(**dict(zip(used, grids)))), [len(named[n]) for n in used])
        kind = value_kind(values)
        places = np.indices(values.shape).reshape(len(axes), -1)
        columns = {a.key: ("int", p.tolist()) for a, p in zip(axes, places)}
        df = local_frame(spark, {**columns, "_value": (SPARK_TYPE[kind], values.ravel().tolist())})
        b.frames[i.node.id] = (BoundFrame(df, {a: a.key for a in axes}, "_value"), kind)
