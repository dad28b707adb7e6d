"""Formulas as SQL text for an engine with IEEE arithmetic (division by zero gives an infinity, NaN equals NaN): an
independent way to compute what lowering computes, and a readable trace."""

from __future__ import annotations

import math
from collections.abc import Mapping

from axiloom.axes import TIME
from axiloom.errors import UnsupportedNodeType
from axiloom.plans.expr import INFIX, Node

_COMPARE = {"equal": "=", "not_equal": "<>", "less": "<", "less_equal": "<=", "greater": ">", "greater_equal": ">="}
_REDUCE = {"sum": "sum({})", "mean": "avg({})", "max": "max({})", "std": "stddev_pop({})", "var": "var_pop({})", "prod": "product({})", "any": "bool_or({} <> 0)", "all": "bool_and({} <> 0)", "count_nonzero": "count_if({} <> 0)"}
_REDUCE |= {"min": "CASE WHEN bool_or(isnan({0})) THEN 'nan'::DOUBLE ELSE min({0}) END", "median": "CASE WHEN bool_or(isnan({0})) THEN 'nan'::DOUBLE ELSE quantile_cont({0}, 0.5) END"}


def to_sql(n: Node, names: Mapping[int, str]) -> str:
    """The formula over columns: ``names`` maps the ids of bound nodes to SQL expressions."""
    if n.id in names:
        return names[n.id]
    a = [to_sql(x, names) for x in n.args]
    if n.op in ("constant", "placeholder"):
        v = n.params.get("value", n.params.get("default"))
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if v is None:
            raise UnsupportedNodeType(f"{n.name!r} is not bound")
        return f"{float(v)!r}::DOUBLE" if math.isfinite(v) else f"'{v}'::DOUBLE"
    if n.op in _COMPARE:
        test = f"({a[0]} {_COMPARE[n.op]} {a[1]})"
        numbers = not any(x.startswith("'") and not x.endswith("DOUBLE") for x in a)
        if not numbers:
            return test
        return f"(CASE WHEN isnan({a[0]}::DOUBLE) OR isnan({a[1]}::DOUBLE) THEN {str(n.op == 'not_equal').upper()} ELSE {test} END)"
    if n.op in ("logical_and", "logical_or"):
        return f"({a[0]} {'AND' if n.op == 'logical_and' else 'OR'} {a[1]})"
    if n.op == "logical_xor":
        return f"({a[0]} <> {a[1]})"
    if n.op == "logical_not":
        return f"(NOT {a[0]})"
    if n.op == "power":
        return f"pow({a[0]}, {a[1]})"
    if n.op == "divide":
        return f"({a[0]}::DOUBLE / {a[1]}::DOUBLE)"
    if n.op in INFIX:
        return f"({a[0]} {INFIX[n.op]} {a[1]})"
    if n.op == "negate":
        return f"(-{a[0]})"
    if n.op == "exp":
        return f"exp({a[0]})"
    if n.op == "log":
        return f"(CASE WHEN {a[0]} = 0 THEN '-inf'::DOUBLE WHEN {a[0]} < 0 THEN 'nan'::DOUBLE ELSE ln({a[0]}) END)"
    if n.op == "maximum":
        return f"greatest({a[0]}, {a[1]})"
    if n.op == "where":
        return f"(CASE WHEN {a[0]} THEN {a[1]} ELSE {a[2]} END)"
    if n.op in ("multi_clause_where", "exclusive_multi_clause_where"):
        body = " ".join(f"WHEN {c} THEN {v}" for c, v in zip(a[:-1:2], a[1:-1:2]))
        return f"(CASE {body} ELSE {a[-1]} END)"
    if n.op == "reduce" and n.params["axis"] == TIME:
        if n.params["kind"] == "quantile":
            return f"CASE WHEN bool_or(isnan({a[0]})) THEN 'nan'::DOUBLE ELSE quantile_cont({a[0]}, {n.params['q']}) END"
        return _REDUCE[n.params["kind"]].format(a[0])
    raise UnsupportedNodeType(n.op)
