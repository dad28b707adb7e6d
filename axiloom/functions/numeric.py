"""Column builders with NumPy's semantics: IEEE division, NaN in comparisons, truth values, NaN-propagating reductions.

Each takes columns with their kinds: bool, int, float or str. Integers keep Spark's checked arithmetic, so an overflow
raises where NumPy would wrap.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Typed = tuple[Column, str]
NAN = float("nan")


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(t, T.StringType):
        return "str"
    raise TypeError(f"no formula can use a column of type {t.simpleString()}")


def number(x: Typed) -> Column:
    """x as bigint or double."""
    c, kind = x
    if kind == "str":
        raise TypeError("text in arithmetic")
    return c.cast("double" if kind == "float" else "bigint")


def real(x: Typed) -> Column:
    c, kind = x
    if kind == "str":
        raise TypeError("text in arithmetic")
    return c.cast("bigint").cast("double") if kind == "bool" else c.cast("double")


def truth(x: Typed) -> Column:
    """Nonzero is true, and so is NaN; text is true unless empty."""
    c, kind = x
    return c if kind == "bool" else c != F.lit("" if kind == "str" else 0)


def _arithmetic(f: Callable[[Column, Column], Column], bools: str) -> Callable[[Typed, Typed], Column]:
    def build(a: Typed, b: Typed) -> Column:
        if a[1] == b[1] == "bool":
            if bools == "or":
                return a[0] | b[0]
            if bools == "and":
                return a[0] & b[0]
            raise TypeError("booleans cannot be subtracted")
        return f(number(a), number(b))

    return build


def divide(a: Typed, b: Typed) -> Column:
    x, y = real(a), real(b)
    # no otherwise: a missing value over zero is missing
    at_zero = F.when((x == 0) | F.isnan(x), F.lit(NAN)).when((x > 0) == _positive_zero(y), F.lit(float("inf"))).when(x.isNotNull(), F.lit(float("-inf")))
    return F.when(y == 0, at_zero).otherwise(x / F.when(y == 0, F.lit(1.0)).otherwise(y))


def _positive_zero(y: Column) -> Column:
    """Whether a zero is +0.0: its sign survives only in its text."""
    return ~F.startswith(y.cast("string"), F.lit("-"))


def power(a: Typed, b: Typed) -> Column:
    p = F.pow(real(a), real(b))
    if a[1] != "float" and b[1] != "float":
        # NumPy refuses integers to negative powers; here that gives the real value, cut to an integer
        return p.cast("bigint")
    return p


def compare(op: str) -> Callable[[Typed, Typed], Column]:
    test: dict[str, Callable[[Column, Column], Column]] = {
        "equal": lambda a, b: a == b, "not_equal": lambda a, b: a != b, "less": lambda a, b: a < b,
        "less_equal": lambda a, b: a <= b, "greater": lambda a, b: a > b, "greater_equal": lambda a, b: a >= b,
    }

    def build(a: Typed, b: Typed) -> Column:
        if (a[1] == "str") != (b[1] == "str"):
            raise TypeError("text compared with a number")
        if a[1] == "str":
            return test[op](a[0], b[0])
        x, y = (a[0], b[0]) if a[1] == b[1] == "bool" else (number(a), number(b))
        missing = [F.isnan(c) for c, k in ((x, a[1]), (y, b[1])) if k == "float"]
        if not missing:
            return test[op](x, y)
        some = missing[0] if len(missing) == 1 else missing[0] | missing[1]
        return F.when(some, F.lit(op == "not_equal")).otherwise(test[op](x, y))

    return build


def log(x: Typed) -> Column:
    c = real(x)
    return F.when(c > 0, F.ln(F.when(c > 0, c).otherwise(F.lit(1.0)))).when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(NAN))


def negate(x: Typed) -> Column:
    if x[1] == "bool":
        raise TypeError("booleans cannot be negated with -")
    return -number(x)


def maximum(a: Typed, b: Typed) -> Column:
    if a[1] == b[1] == "bool":
        return a[0] | b[0]
    return F.greatest(number(a), number(b))


BINARY: dict[str, Callable[[Typed, Typed], Column]] = {
    "add": _arithmetic(lambda a, b: a + b, "or"), "subtract": _arithmetic(lambda a, b: a - b, ""), "multiply": _arithmetic(lambda a, b: a * b, "and"),
    "divide": divide, "power": power, "maximum": maximum,
    **{op: compare(op) for op in ("equal", "not_equal", "less", "less_equal", "greater", "greater_equal")},
    "logical_and": lambda a, b: truth(a) & truth(b), "logical_or": lambda a, b: truth(a) | truth(b), "logical_xor": lambda a, b: truth(a) != truth(b),
}
UNARY: dict[str, Callable[[Typed], Column]] = {"negate": negate, "logical_not": lambda x: ~truth(x), "exp": lambda x: F.exp(real(x)), "log": log}


def common_kind(kinds: list[str]) -> str:
    if "str" in kinds:
        if set(kinds) != {"str"}:
            raise TypeError("text and numbers in the branches of one condition")
        return "str"
    return "float" if "float" in kinds else "int" if "int" in kinds else "bool"


def as_kind(x: Typed, kind: str) -> Column:
    return x[0] if kind in ("str", "bool") else real(x) if kind == "float" else number(x)


def choose(clauses: list[tuple[Typed, Typed]], default: Typed, strict: bool) -> Column:
    """CASE over (condition, value); ``strict``: conditions must be booleans. NaN as default of text is no value."""
    values = [v for _, v in clauses]
    text = any(k == "str" for _, k in values)
    if text and default[1] == "float":
        default = (F.lit(None).cast("string"), "str")
    kind = common_kind([k for _, k in [*values, default]])
    out = None
    for condition, value in clauses:
        if strict and condition[1] != "bool":
            raise TypeError("a condition must be boolean")
        c, v = truth(condition), as_kind(value, kind)
        out = F.when(c, v) if out is None else out.when(c, v)
    return out.otherwise(as_kind(default, kind))


def _nan_first(x: Typed, f: Callable[[Column], Column]) -> Column:
    c = number(x)
    return F.when(F.max(F.isnan(c)), F.lit(NAN)).otherwise(f(c)) if x[1] == "float" else f(c)


def aggregate(kind: str, x: Typed, q: float | None = None) -> Column:
    if x[1] == "str":
        raise TypeError("text in a reduction")
    plain: dict[str, Callable[[], Column]] = {
        "sum": lambda: F.coalesce(F.sum(number(x)), F.lit(0).cast("double" if x[1] == "float" else "bigint")),
        "mean": lambda: F.avg(real(x)),
        "min": lambda: F.bool_and(x[0]) if x[1] == "bool" else _nan_first(x, F.min),
        "max": lambda: F.bool_or(x[0]) if x[1] == "bool" else F.max(number(x)),
        "std": lambda: F.stddev_pop(real(x)),
        "var": lambda: F.var_pop(real(x)),
        "median": lambda: _nan_first((real(x), "float"), F.median),
        "quantile": lambda: _nan_first((real(x), "float"), lambda c: F.percentile(c, F.lit(q))),
        "prod": lambda: F.product(real(x)) if x[1] == "float" else F.product(real(x)).cast("bigint"),
        "any": lambda: F.coalesce(F.bool_or(truth(x)), F.lit(False)),
        "all": lambda: F.coalesce(F.bool_and(truth(x)), F.lit(True)),
        "count_nonzero": lambda: F.count_if(truth(x)),
    }
    return plain[kind]()


def over_one(kind: str, x: Typed) -> Column:
    """A reduction along an axis on which x does not vary: one element."""
    if kind in ("any", "all"):
        return truth(x)
    if kind == "count_nonzero":
        return truth(x).cast("bigint")
    if kind in ("std", "var"):
        return real(x) - real(x)
    if kind in ("mean", "median", "quantile"):
        return real(x)
    return number(x) if kind in ("sum", "prod") else x[0]


_UFUNCS: dict[str, Callable[..., Any]] = {k: getattr(np, k) for k in ("add", "subtract", "multiply", "divide", "equal", "not_equal", "less", "less_equal", "greater", "greater_equal", "logical_and", "logical_or", "logical_xor", "maximum", "logical_not", "exp", "log")}
_UFUNCS |= {"negate": np.negative, "power": lambda a, b: np.power(a, b) if np.asarray(b).dtype.kind == "f" or b >= 0 else type(a)(float(a) ** float(b))}


def fold(op: str, args: list[Any], kind: str) -> Any:
    """The value of an operation on constants, as ``kind``."""
    with np.errstate(all="ignore"):
        if op == "where":
            out = args[1] if bool(args[0]) else args[2]
        elif op in ("multi_clause_where", "exclusive_multi_clause_where"):
            if any(not isinstance(c, (bool, np.bool_)) for c in args[:-1:2]):
                raise TypeError("a condition must be boolean")
            out = next((v for c, v in zip(args[:-1:2], args[1:-1:2]) if c), args[-1])
            if kind == "str" and not isinstance(out, str):
                return None
        elif isinstance(args[0], str) or isinstance(args[-1], str):
            if len(args) != 2 or not all(isinstance(a, str) for a in args) or op not in ("equal", "not_equal", "less", "less_equal", "greater", "greater_equal"):
                raise TypeError("text in arithmetic, or compared with a number")
            a, b = args
            out = {"equal": a == b, "not_equal": a != b, "less": a < b, "less_equal": a <= b, "greater": a > b, "greater_equal": a >= b}[op]
        else:
            out = _UFUNCS[op](*args)
    return {"bool": bool, "int": int, "float": float, "str": str}[kind](out)


def fold_over_one(kind: str, x: Any, out: str) -> Any:
    """A reduction of one constant."""
    if isinstance(x, str):
        raise TypeError("text in a reduction")
    value = bool(x) if kind in ("any", "all", "count_nonzero") else x - x if kind in ("std", "var") else x
    return {"bool": bool, "int": int, "float": float}[out](value)


def literal(value: Any, kind: str) -> Column:
    return F.lit(value).cast({"int": "bigint", "float": "double", "str": "string", "bool": "boolean"}[kind])
