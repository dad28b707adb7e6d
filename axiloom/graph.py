"""What formulas are written with, beside operators on indexes."""

from axiloom.plans.expr import (
    Node,
    breakpoint,
    constant,
    exclusive_multi_clause_where,
    exp,
    function_call,
    guards_to_selector,
    log,
    maximum,
    multi_clause_where,
    piecewise,
    placeholder,
    timeseries_constant,
    timeseries_placeholder,
    tracepoint,
    where,
)

__all__ = [
    "Node", "breakpoint", "constant", "exclusive_multi_clause_where", "exp", "function_call", "guards_to_selector", "log", "maximum", "multi_clause_where",
    "piecewise", "placeholder", "timeseries_constant", "timeseries_placeholder", "tracepoint", "where",
]
