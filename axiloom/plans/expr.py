"""The expression graph: immutable nodes, operator overloads, and the constructors of all node kinds.

One class serves every kind; ``op`` names it and rules in lowering, SQL text and tests are tables keyed by it. Nodes
are compared and hashed by identity, and ``==`` builds a node, so a node has no truth value.
"""

from __future__ import annotations

import itertools
import threading
from collections.abc import Callable, Iterable
from typing import Any, Protocol, runtime_checkable

import numpy as np

from axiloom.axes import TIME, Axis

Scalar = bool | float | int | str
_ids, _lock = itertools.count(1), threading.Lock()

BINARY = ("add", "subtract", "multiply", "divide", "power", "equal", "not_equal", "less", "less_equal", "greater", "greater_equal", "logical_and", "logical_or", "logical_xor", "maximum")
UNARY = ("negate", "logical_not", "exp", "log")
REDUCTIONS = ("sum", "mean", "min", "max", "std", "var", "median", "prod", "any", "all", "count_nonzero", "quantile")
LEAVES = ("constant", "placeholder", "timeseries_constant", "timeseries_placeholder")
INFIX = {"add": "+", "subtract": "-", "multiply": "*", "divide": "/", "power": "**", "equal": "==", "not_equal": "!=", "less": "<", "less_equal": "<=", "greater": ">", "greater_equal": ">=", "logical_and": "&", "logical_or": "|", "logical_xor": "^"}


@runtime_checkable
class HasNode(Protocol):
    @property
    def node(self) -> "Node": ...


def as_node(value: Any) -> "Node":
    """A node as it is, what has one as that, and a scalar as a constant."""
    if isinstance(value, Node):
        return value
    if isinstance(value, HasNode):
        return value.node
    if isinstance(value, (bool, int, float, str, np.bool_, np.integer, np.floating)):
        return constant(value)
    raise TypeError(f"cannot use {type(value).__name__} in a formula")


class Node:
    """op over args; ``params`` holds what isn't a node (values, axis, q, names)."""

    __slots__ = ("args", "flags", "id", "name", "op", "params")

    def __init__(self, op: str, args: Iterable["Node"] = (), name: str = "", **params: Any):
        with _lock:
            self.id = next(_ids)
        self.op, self.args, self.name, self.params, self.flags = op, tuple(args), name, params, set()

    __hash__ = object.__hash__

    def __bool__(self) -> bool:
        raise TypeError("a node has no truth value; use &, |, ~ and piecewise() in formulas, and `is` for identity")

    def maybe_set_name(self, name: str) -> None:
        self.name = self.name or name

    @property
    def output_axes(self) -> tuple[Axis, ...]:
        """The domain axes the value carries, as far as the graph alone tells."""
        return _axes_of(self)

    def __repr__(self) -> str:
        """One assignment in text; the graph's lines in order make a program."""
        named = [f"n{a.id}" for a in self.args] + [f"{k}={v!r}" for k, v in self.params.items() if k != "clauses"]
        body = f"{named[0]} {INFIX[self.op]} {named[1]}" if self.op in INFIX else f"{self.op}({', '.join(named)})"
        return f"n{self.id} = {body}" + (f"  # {self.name}" if self.name else "")


def _axes_of(root: Node) -> tuple[Axis, ...]:
    found: dict[int, tuple[Axis, ...]] = {}
    for n in linearize([root]):
        own = (TIME,) if n.op.startswith("timeseries") else tuple(dict.fromkeys(x for a in n.args for x in found[a.id]))
        if n.op == "reduce":
            own = tuple(x for x in own if x != n.params["axis"])
        found[n.id] = own
    return found[root.id]


def _binary(op: str, swap: bool = False) -> Callable[[Node, Any], Node]:
    def method(self: Node, other: Any) -> Node:
        a, b = (as_node(other), self) if swap else (self, as_node(other))
        return Node(op, (a, b))

    return method


for _name, _op in {"add": "add", "sub": "subtract", "mul": "multiply", "truediv": "divide", "pow": "power", "and": "logical_and", "or": "logical_or", "xor": "logical_xor"}.items():
    setattr(Node, f"__{_name}__", _binary(_op))
    setattr(Node, f"__r{_name}__", _binary(_op, swap=True))
for _name, _op in {"eq": "equal", "ne": "not_equal", "lt": "less", "le": "less_equal", "gt": "greater", "ge": "greater_equal"}.items():
    setattr(Node, f"__{_name}__", _binary(_op))
Node.__neg__ = lambda self: Node("negate", (self,))
Node.__invert__ = lambda self: Node("logical_not", (self,))


# leaves


def constant(value: Scalar, name: str = "") -> Node:
    return Node("constant", name=name, value=value)


def placeholder(name: str, default_value: Scalar | None = None) -> Node:
    return Node("placeholder", name=name, default=default_value)


def timeseries_constant(values: Any, name: str = "") -> Node:
    return Node("timeseries_constant", name=name, values=np.asarray(values))


def timeseries_placeholder(name: str) -> Node:
    return Node("timeseries_placeholder", name=name)


# element-wise


def exp(x: Any) -> Node:
    return Node("exp", (as_node(x),))


def log(x: Any) -> Node:
    return Node("log", (as_node(x),))


def maximum(a: Any, b: Any) -> Node:
    return Node("maximum", (as_node(a), as_node(b)))


def where(condition: Any, then: Any, otherwise: Any) -> Node:
    return Node("where", (as_node(condition), as_node(then), as_node(otherwise)))


def _clauses(op: str, clauses: Iterable[tuple[Any, Any]], default: Any, **params: Any) -> Node:
    """args: condition, value, condition, value, ..., default. The first condition that holds decides."""
    flat = [as_node(x) for c in clauses for x in c]
    return Node(op, (*flat, as_node(default)), **params)


def multi_clause_where(clauses: Iterable[tuple[Any, Any]], default_value: Any) -> Node:
    return _clauses("multi_clause_where", clauses, default_value)


def exclusive_multi_clause_where(clauses: Iterable[tuple[Any, Any]], default_value: Any, companion: Node | None = None) -> Node:
    """As multi_clause_where, where at most one condition holds; a function in a branch sees only that branch's rows."""
    return _clauses("exclusive_multi_clause_where", clauses, default_value, companion=companion)


def piecewise(*clauses: tuple[Any, Any]) -> Node:
    """(value, condition) pairs; what follows a literal True is dropped, and without one the default is NaN."""
    kept: list[tuple[Any, Any]] = []
    default: Any = None
    for value, condition in clauses:
        if condition is True or condition is np.True_:
            default = value
            break
        kept.append((condition, value))
    if not kept and default is None:
        raise ValueError("piecewise() needs a clause")
    if not kept:
        return as_node(default)
    return multi_clause_where(kept, float("nan") if default is None else default)


def variant_selector(selector: Any, branches: dict[str, list[Node]], merged: list[Node]) -> Node:
    """Structure only: which nodes belong to which branch, and where they meet."""
    return Node("variant_selector", (as_node(selector),), branches=branches, merged=merged)


def guards_to_selector(guards: Iterable[tuple[str, Any]]) -> Node:
    """A text node: the key of the first predicate that holds."""
    return piecewise(*((constant(k), p) for k, p in guards))


def function_call(function: str, *args: Any, **kwargs: Any) -> Node:
    """A user function, bound by name when evaluated."""
    return Node("function_call", [as_node(x) for x in (*args, *kwargs.values())], name=function, keywords=tuple(kwargs))


# reductions


def reduce(kind: str, node: Any, axis: Axis = TIME, q: float | None = None, name: str = "") -> Node:
    if kind not in REDUCTIONS:
        raise ValueError(f"unknown reduction {kind!r}")
    if not isinstance(axis, Axis):
        raise TypeError("axis must be an Axis")
    if kind == "quantile" and not (q is not None and 0 <= q <= 1):
        raise ValueError("q must lie between 0 and 1")
    return Node("reduce", (as_node(node),), name=name, kind=kind, axis=axis, **({"q": q} if q is not None else {}))


def _projector(kind: str):
    if kind == "quantile":
        return lambda node, axis, q, name="": reduce(kind, node, axis, q, name)
    return lambda node, axis, name="": reduce(kind, node, axis, None, name)


for _kind in REDUCTIONS:
    globals()[f"project_using_{_kind}"] = _projector(_kind)


def tracepoint(node: Node) -> Node:
    """Report the value of this node when it is evaluated."""
    node.flags.add("trace")
    return node


def breakpoint(node: Node) -> Node:  # noqa: A001
    """As tracepoint(), and then stop in the driver's debugger (see sys.breakpointhook)."""
    node.flags.add("break")
    return tracepoint(node)


# order


def linearize(roots: Iterable[Node], boundary: Iterable[Node] = ()) -> list[Node]:
    """All nodes that roots need, each once and after its arguments; not beyond the nodes of ``boundary``."""
    stop = {n.id for n in boundary}
    done: dict[int, Node] = {}
    open_: set[int] = set()
    for root in roots:
        stack: list[tuple[Node, bool]] = [(root, False)]
        while stack:
            n, ready = stack.pop()
            if not isinstance(n, Node):
                raise TypeError(f"not a node: {type(n).__name__}")
            if n.id in done or n.id in stop:
                continue
            if ready:
                open_.discard(n.id)
                done[n.id] = n
                continue
            if n.id in open_:
                raise ValueError("the graph has a cycle")
            open_.add(n.id)
            stack.append((n, True))
            companion = n.params.get("companion")
            needs = (*n.args, companion) if companion is not None else n.args
            for a in reversed(needs):
                if a.id in open_:
                    raise ValueError("the graph has a cycle")
                stack.append((a, False))
    return list(done.values())
