"""Indexes: named variables over expression nodes, some of them random."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

import numpy as np

from axiloom.axes import TIME, Axis
from axiloom.functions.distributions import Distribution
from axiloom.plans import expr
from axiloom.plans.expr import Node, Scalar

DomainValue = float | np.ndarray | Distribution | str | dict[str, float]


class GenericIndex:
    """A variable with a name and a node. Arithmetic and comparison give nodes; hashing is by identity."""

    def __init__(self, name: str, node: Node):
        self.name, self._node = name, node
        node.maybe_set_name(name)

    @property
    def node(self) -> Node:
        return self._node

    @property
    def output_axes(self) -> tuple[Axis, ...]:
        return self.node.output_axes

    __hash__ = object.__hash__

    def __bool__(self) -> bool:
        return True

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.name!r})"

    def is_abstract(self) -> bool:
        return False


def _delegate(method: str) -> Callable[..., Node]:
    return lambda self, *others: getattr(self.node, method)(*others)


for _m in ("add", "radd", "sub", "rsub", "mul", "rmul", "truediv", "rtruediv", "pow", "rpow", "neg", "eq", "ne", "lt", "le", "gt", "ge"):
    setattr(GenericIndex, f"__{_m}__", _delegate(f"__{_m}__"))


def _reducer(kind: str) -> Callable[..., Node]:
    if kind == "quantile":
        return lambda self, q, axis=TIME: expr.reduce(kind, self.node, axis, q)
    return lambda self, axis=TIME: expr.reduce(kind, self.node, axis)


for _k in expr.REDUCTIONS:
    setattr(GenericIndex, _k, _reducer(_k))


class Index(GenericIndex):
    """A scalar (an overridable default), None (to be supplied), or a formula."""

    def __init__(self, name: str, value: Scalar | Node | GenericIndex | None):
        if isinstance(value, Distribution) and not isinstance(value, (GenericIndex, Node)):
            raise TypeError(f"index {name!r}: use DistributionIndex for a distribution")
        if isinstance(value, GenericIndex):
            value = value.node
        self.value = value
        super().__init__(name, value if isinstance(value, Node) else expr.placeholder(name))

    def is_abstract(self) -> bool:
        return self.value is None


class ConstIndex(GenericIndex):
    def __init__(self, name: str, value: Scalar):
        self.value = value
        super().__init__(name, expr.constant(value, name))


class TimeseriesIndex(GenericIndex):
    """A series over time: an array (an overridable default), None, or a formula."""

    def __init__(self, name: str, value: Any = None):
        if isinstance(value, GenericIndex):
            value = value.node
        self.value = value if value is None or isinstance(value, Node) else np.asarray(value)
        super().__init__(name, value if isinstance(value, Node) else expr.timeseries_placeholder(name))

    def is_abstract(self) -> bool:
        return self.value is None


class ConstTimeseriesIndex(GenericIndex):
    def __init__(self, name: str, values: Any):
        self.value = np.asarray(values)
        super().__init__(name, expr.timeseries_constant(self.value, name))


class DistributionIndex(Index):
    """A random scalar: factory(**params) is its distribution, fixed when the index is made."""

    def __init__(self, name: str, factory: Callable[..., Distribution], params: Mapping[str, Any] | None = None):
        super().__init__(name, None)
        self.factory, self.params = factory, dict(params or {})
        self.value = factory(**self.params)
        if not isinstance(self.value, Distribution):
            raise TypeError(f"index {name!r}: the factory gave no distribution")

    def is_abstract(self) -> bool:
        return True

    def sample(self, rng: Any = None, size: int | None = None):
        return self.value.rvs(size=size, **({"random_state": rng} if rng is not None else {}))


def _check_parents(name: str, parents: Sequence[GenericIndex]) -> tuple[GenericIndex, ...]:
    if not parents:
        raise ValueError(f"index {name!r} needs parents")
    kinds = (CategoricalIndex, ConditionalCategoricalIndex, DistributionIndex, ConditionalDistributionIndex)
    for p in parents:
        if not isinstance(p, kinds):
            raise TypeError(f"index {name!r}: parent {p!r} is neither categorical nor random")
    return tuple(parents)


class ConditionalDistributionIndex(Index):
    """A random scalar whose distribution depends on its parents: factory(**{parent name: value})."""

    def __init__(self, name: str, parents: Sequence[GenericIndex], factory: Callable[..., Distribution]):
        super().__init__(name, None)
        self.parents, self.factory = _check_parents(name, parents), factory

    def distribution_for(self, **values: Any) -> Distribution:
        return self.factory(**values)

    def sample_for(self, rng: Any = None, size: int | None = None, **values: Any):
        return self.distribution_for(**values).rvs(size=size, **({"random_state": rng} if rng is not None else {}))


def _checked_outcomes(name: str, outcomes: Mapping[str, float]) -> dict[str, float]:
    if not outcomes:
        raise ValueError(f"index {name!r} needs outcomes")
    if low := [k for k, p in outcomes.items() if p <= 0]:
        raise ValueError(f"index {name!r}: probabilities must be positive; not so for {low}")
    if not np.isclose(sum(outcomes.values()), 1.0):
        raise ValueError(f"index {name!r}: probabilities must sum to 1, not {sum(outcomes.values())}")
    return dict(outcomes)


def _draw(outcomes: Mapping[str, float], rng: Any, size: int | None):
    keys = np.array(list(outcomes), dtype=object)
    p = np.array(list(outcomes.values()), float)
    return (rng if rng is not None else np.random.default_rng()).choice(keys, size=size, p=p / p.sum())


class CategoricalIndex(GenericIndex):
    """A random key with fixed probabilities."""

    def __init__(self, name: str, outcomes: Mapping[str, float]):
        self.outcomes = _checked_outcomes(name, outcomes)
        super().__init__(name, expr.placeholder(name))

    @property
    def support(self) -> list[str]:
        return list(self.outcomes)

    def is_abstract(self) -> bool:
        return True

    def sample(self, rng: Any = None, size: int | None = None):
        return _draw(self.outcomes, rng, size)


class ConditionalCategoricalIndex(GenericIndex):
    """A random key whose probabilities over a fixed support depend on its parents."""

    def __init__(self, name: str, parents: Sequence[GenericIndex], support: Sequence[str], factory: Callable[..., Mapping[str, float]]):
        if not support:
            raise ValueError(f"index {name!r} needs a support")
        self.parents, self.support, self.factory = _check_parents(name, parents), list(support), factory
        super().__init__(name, expr.placeholder(name))

    def is_abstract(self) -> bool:
        return True

    def outcomes_for(self, **values: Any) -> dict[str, float]:
        found = dict(self.factory(**values))
        if set(found) != set(self.support):
            raise ValueError(f"index {self.name!r}: the factory's keys {sorted(found)} are not its support {sorted(self.support)}")
        return {k: _checked_outcomes(self.name, found)[k] for k in self.support}

    def sample_for(self, rng: Any = None, size: int | None = None, **values: Any):
        return _draw(self.outcomes_for(**values), rng, size)
