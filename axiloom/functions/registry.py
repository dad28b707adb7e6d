"""User functions by name, in one of four kinds.

column: Columns to a Column, inside the plan. vector: arrays to an array of the same length, in Arrow batches. series:
for each combination of the other axes, whole time series (arrays along time; what does not vary in time is a scalar)
to a series. summary: the same to one number, which no longer varies in time. A function in a guarded branch is called
with that branch's rows only.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Protocol

KINDS = ("column", "vector", "series", "summary")


@dataclass(frozen=True)
class Function:
    call: Callable[..., Any]
    kind: str | None = None  # None: series if an argument varies in time, else vector

    def __post_init__(self):
        if self.kind not in (None, *KINDS):
            raise ValueError(f"a function is of kind {', '.join(KINDS)}; got {self.kind!r}")


def adapt(call: Callable[..., Any] | Function, kind: str | None = None) -> Function:
    return call if isinstance(call, Function) else Function(call, kind)


class Functor(Protocol):
    """A function of arrays, positional and by name, that gives an array."""

    def __call__(self, *args: Any, **kwargs: Any) -> Any: ...


class LambdaAdapter(Function):
    """Deprecated spelling of adapt()."""

    def __init__(self, call: Callable[..., Any]):
        warnings.warn("LambdaAdapter is deprecated; use adapt()", DeprecationWarning, stacklevel=2)
        super().__init__(call)

    def __call__(self, *args: Any, **kwargs: Any) -> Any:
        return self.call(*args, **kwargs)
