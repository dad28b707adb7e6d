"""Evaluations that grow: more scenarios added to a result, now or in the background, or as they arrive in a stream."""

from __future__ import annotations

import threading
from collections.abc import Iterable
from concurrent.futures import Executor, Future, ThreadPoolExecutor
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from axiloom.axes import ENSEMBLE, Axis
from axiloom.operators.evaluate import Evaluation, EvaluationPlan, EvaluationResult, session
from axiloom.plans.expr import as_node
from axiloom.sources.ensembles import DistributionEnsemble
from axiloom.sources.frames import AxisTable

_pool: list[ThreadPoolExecutor] = []
_lock = threading.Lock()


def default_executor() -> ThreadPoolExecutor:
    with _lock:
        if not _pool:
            _pool.append(ThreadPoolExecutor(max_workers=4, thread_name_prefix="axiloom"))
        return _pool[0]


class GrownResult(EvaluationResult):
    """Batches of scenarios as one result: frames are unions, and every scenario weighs the same."""

    def __init__(self, batches: list[EvaluationResult], size: int):
        first = batches[0]
        super().__init__(first.lowering, first.axes, dict(first.tables), first.parameter_values, first.named_axis_values)
        self.batches = batches
        self._axis = next(a for a in first.axes if a.role == ENSEMBLE)
        self._weight = first.tables[self._axis].weight
        self._sizes = {**first._sizes, self._axis: size}
        whole = first.tables[self._axis]
        parts = [b.tables[self._axis].df for b in batches]
        self.tables[self._axis] = AxisTable(self._axis, self._joined(parts), whole.columns, whole.kinds, whole.weight)

    def _joined(self, parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.withColumn(self._weight, F.lit(1.0 / self._sizes[self._axis])) if self._weight in out.columns else out

    def _of(self, what: Any) -> tuple[list[Axis], DataFrame]:
        axes, df = super()._of(what)
        if self._axis not in axes:
            return axes, df
        return axes, self._joined([b._of(what)[1] for b in self.batches])

    def table(self, **named: Any) -> DataFrame:
        parts = [b.table(**named) for b in self.batches]
        return self._joined(parts) if self._weight in parts[0].columns else parts[0]


class EvaluationHandle:
    """Batches of scenarios along one ensemble axis, all of equal weight.

    Scenario numbers go on from batch to batch and draws depend on them alone, so extending gives what one evaluation
    of the whole size would. The frames of a batch's nodes of interest are kept once computed, so that a longer result
    costs what it adds; a lost executor's part is computed again.
    """

    def __init__(
        self, evaluation: Evaluation, plan: EvaluationPlan, size: int, *, rng: Any = None, seed: int = 0, parameters: Any = None, parameter_axes: Any = None,
        frames: Any = None, functions: Any = None, spark: Any = None, keep: bool = True, start: bool = True,
    ):
        self.evaluation, self.plan, self.rng, self.seed, self.keep = evaluation, plan, rng, seed, keep
        self.kwargs = {"parameters": parameters, "parameter_axes": parameter_axes, "frames": frames, "functions": functions, "spark": spark or session()}
        self.size = 0
        self._batches: list[EvaluationResult] = []
        self._result: EvaluationResult | None = None
        if start:
            self._add(size)

    def _add(self, n: int) -> EvaluationResult:
        exclude = [*(self.kwargs["parameters"] or {}), *(self.kwargs["frames"] or {})]
        ensemble = DistributionEnsemble(self.evaluation.scenario, n, self.rng, exclude, self.seed, start=self.size)
        batch = self.evaluation.execute_plan(self.plan, ensemble=ensemble, **self.kwargs)
        if self._batches and [a.name for a in batch.axes] != [a.name for a in self._batches[0].axes]:
            raise ValueError("the batches differ in their axes")
        if self.keep:
            batch.persist(self.plan.nodes_of_interest, StorageLevel.MEMORY_AND_DISK)
        self._batches.append(batch)
        self.size += n
        self._result = GrownResult(self._batches, self.size)
        return self._result

    @property
    def result(self) -> EvaluationResult:
        """All scenarios so far."""
        if self._result is None:
            raise RuntimeError("the result is not yet there")
        return self._result

    def extend(self, ensemble_size: int = 0, *, extra_parameters: Any = None) -> EvaluationResult:
        """Add so many scenarios; the result of all."""
        if extra_parameters is not None:
            raise NotImplementedError("parameters cannot be added to a result")
        return self._add(ensemble_size) if ensemble_size > 0 else self.result

    def release(self) -> None:
        """Give up what is kept of the batches; they stay usable, and are computed anew."""
        for b in self._batches:
            b.unpersist()


class AsyncEvaluationHandle(EvaluationHandle):
    """An evaluation that runs in the background: its frames are computed there and kept."""

    def __init__(self, evaluation: Evaluation, plan: EvaluationPlan, size: int, *, pool: Executor | None = None, **kwargs: Any):
        super().__init__(evaluation, plan, size, start=False, **kwargs)
        self._future: Future = (pool or default_executor()).submit(self._run, size)

    def _run(self, size: int) -> EvaluationResult:
        found = self._add(size)
        for batch in self._batches:
            batch.compute()
        return found

    @property
    def result(self) -> EvaluationResult:
        if not self._future.done():
            raise RuntimeError("the evaluation is still running; use get() to wait for it, or poll()")
        self._future.result()
        return super().result

    def poll(self) -> tuple[bool, EvaluationResult | None]:
        """(True, result) once it is there, (False, None) before; an error of the evaluation is raised here."""
        return (True, self.result) if self._future.done() else (False, None)

    def get(self, timeout: float | None = None) -> EvaluationResult:
        """Wait for the result."""
        self._future.result(timeout)
        return self.result

    def extend(self, ensemble_size: int = 0, *, extra_parameters: Any = None) -> EvaluationResult:
        if not self._future.done():
            raise RuntimeError("cannot extend while the evaluation is still running; use get() to wait for it")
        self._future.result()
        return super().extend(ensemble_size, extra_parameters=extra_parameters)


def _checked(size: int, kwargs: dict[str, Any]) -> None:
    if kwargs.pop("extra_parameters", None) is not None:
        raise NotImplementedError("parameters cannot be added to a result")
    given = kwargs.pop("ensemble", None)
    if given is not None and len(getattr(given, "ensemble_axes", ())) > 1:
        raise NotImplementedError("a result grows along one ensemble axis")
    if given is not None:
        raise ValueError("a growing evaluation draws its scenarios itself; give a given ensemble to evaluate()")


def evaluate_incremental(evaluation: Evaluation, size: int, nodes_of_interest: Iterable[Any] | None = None, strategy: str = "monolithic", **kwargs: Any) -> EvaluationHandle:
    _checked(size, kwargs)
    return EvaluationHandle(evaluation, evaluation.build_plan(nodes_of_interest, strategy), size, **kwargs)


def submit_evaluate(evaluation: Evaluation, size: int, nodes_of_interest: Iterable[Any] | None = None, strategy: str = "monolithic", pool: Executor | None = None, **kwargs: Any) -> AsyncEvaluationHandle:
    _checked(size, kwargs)
    nodes = list(nodes_of_interest) if nodes_of_interest is not None else None
    [as_node(n) for n in nodes or ()]
    return AsyncEvaluationHandle(evaluation, evaluation.build_plan(nodes, strategy), size, pool=pool, **kwargs)


def running_expectation(stream: DataFrame, keys: list[str], value: str, weight: str, name: str, time: str | None = None, window: str = "1 hour", delay: str = "10 minutes") -> StreamingQuery:
    """The weighted average per keys of scenarios that arrive in a stream, as an in-memory table ``name``. With
    ``time``, per window of event time, complete once the watermark has passed it."""
    group: list[Any] = [F.col(k) for k in keys]
    mode = "complete"
    if time is not None:
        stream = stream.withWatermark(time, delay)
        group.append(F.window(time, window))
        mode = "append"
    w, v = F.col(weight).cast("double"), F.col(value).cast("double")
    out = stream.groupBy(*group).agg((F.sum(w * v) / F.sum(w)).alias("value"))
    return out.writeStream.outputMode(mode).format("memory").queryName(name).start()
