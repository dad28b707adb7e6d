"""Lowering: from the expression graph to DataFrames.

A node's axes are the union of its arguments'; nodes with the same axes share one frame, a DataFrame with one key
column per axis and one column per node. Inside a frame, formulas are projections, one select per level of the graph,
so that a value used twice is computed once. Where axes differ, frames are joined on the keys they share and crossed
on the others, as late as the formula allows. All reductions of one frame along one axis are one groupBy.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axiloom.axes import TIME, Axis, layout
from axiloom.errors import FunctionNotFound, PlaceholderValueNotProvided, UnsupportedNodeType, UnsupportedOperation
from axiloom.functions import numeric
from axiloom.functions.registry import Function
from axiloom.plans.expr import LEAVES, Node
from axiloom.sources.frames import AxisTable, BoundFrame, array_table, plain, value_kind

Axes = frozenset[Axis]


@dataclass
class Binding:
    """Where the leaves get their values: scalars, axis tables, series along time, callables, frames, functions."""

    scalars: dict[int, Any] = field(default_factory=dict)
    tables: dict[Axis, AxisTable] = field(default_factory=dict)
    series: dict[int, np.ndarray] = field(default_factory=dict)
    callables: dict[int, tuple[tuple[Axis, ...], Column]] = field(default_factory=dict)
    frames: dict[int, tuple[BoundFrame, str]] = field(default_factory=dict)
    functions: dict[str, Function] = field(default_factory=dict)


@dataclass
class Placed:
    """A value: its axes and kind, and a column of a frame, or for what has no axes yet a column that needs none."""

    axes: Axes
    kind: str
    depth: int
    column: str | None = None
    literal: Column | None = None
    value: Any = None


def result_kind(op: str, kinds: list[str]) -> str:
    if op in ("divide", "exp", "log"):
        return "float"
    if op in ("equal", "not_equal", "less", "less_equal", "greater", "greater_equal", "logical_and", "logical_or", "logical_xor", "logical_not"):
        return "bool"
    if op == "negate":
        return "float" if kinds == ["float"] else "int"
    if op in ("add", "multiply", "maximum") and kinds == ["bool", "bool"]:
        return "bool"
    return "float" if "float" in kinds else "int"


def reduced_kind(kind: str, of: str) -> str:
    if kind in ("mean", "std", "var", "median", "quantile"):
        return "float"
    if kind in ("any", "all"):
        return "bool"
    if kind in ("min", "max"):
        return of
    return "int" if kind == "count_nonzero" or of != "float" else "float"


class Lowering:
    """Frames for the nodes that ``roots`` need, planned once; nothing runs until a frame is used."""

    def __init__(self, spark: SparkSession, roots: list[Node], binding: Binding, alias: Mapping[int, Node] | None = None):
        """``alias`` names nodes that are taken to be others: in a region, the choices are one branch's outputs."""
        self.spark, self.binding, self.alias = spark, binding, dict(alias or {})
        self.guards = {} if self.alias else _guards(roots)
        self.order: list[Node] = []
        self.packs: dict[int, Node] = {}  # for a summary, the node that holds its arguments side by side
        for n in _ordered(roots, self.guards, self.alias):
            f = binding.functions.get(n.name) if n.op == "function_call" else None
            if f is not None and f.kind == "summary" and n.id not in self.alias:
                self.packs[n.id] = Node("pack", n.args)
                self.order.append(self.packs[n.id])
            self.order.append(n)
        self.wanted = {n.id for n in roots}
        self.placed: dict[int, Placed] = {}
        self.frames: dict[tuple[int, Axes], DataFrame] = {}
        self._series_table: DataFrame | None = None
        self._place()
        self._build()

    # where ----------------------------------------------------------------------------------------------------------

    def _place(self) -> None:
        for n in self.order:
            if n.id in self.alias:
                self.placed[n.id] = replace(self.placed[self.alias[n.id].id])
                continue
            self.placed[n.id] = self._leaf(n) if n.op in LEAVES or self._bound(n) else self._inner(n)

    def _bound(self, n: Node) -> bool:
        b = self.binding
        return n.id in b.scalars or n.id in b.series or n.id in b.callables or n.id in b.frames or any(n.id in t.columns for t in b.tables.values())

    def _leaf(self, n: Node) -> Placed:
        b, name = self.binding, f"n{n.id}"
        for axis, t in b.tables.items():
            if n.id in t.columns:
                return Placed(frozenset([axis]), t.kinds[n.id], 0, name)
        if n.id in b.callables:
            return Placed(frozenset(b.callables[n.id][0]), "float", 0, name)
        if n.id in b.frames:
            return Placed(frozenset(b.frames[n.id][0].keys), b.frames[n.id][1], 0, name)
        if n.op == "timeseries_constant":
            b.series.setdefault(n.id, n.params["values"])
        if n.id in b.series:
            return Placed(frozenset([TIME]), value_kind(b.series[n.id]), 0, name)
        if n.op == "timeseries_placeholder":
            raise PlaceholderValueNotProvided(f"no series for {n.name!r}")
        value = b.scalars.get(n.id, n.params.get("value", n.params.get("default")))
        if value is None:
            raise PlaceholderValueNotProvided(f"no value for {n.name!r}")
        value = plain(np.asarray(value)[()]) if not isinstance(value, str) else value
        kind = value_kind(np.asarray(value))
        return Placed(frozenset(), kind, 0, literal=numeric.literal(value, kind), value=value)

    def _inner(self, n: Node) -> Placed:
        args = [self.placed[a.id] for a in n.args]
        if n.op == "variant_selector":
            return Placed(args[0].axes, args[0].kind, args[0].depth, args[0].column, args[0].literal, args[0].value)
        used = [*args, *([self.placed[self.guards[n.id].id]] if n.id in self.guards else [])]
        axes: Axes = frozenset().union(*(a.axes for a in used))
        kinds = [a.kind for a in args]
        if n.op == "reduce":
            if n.params["axis"].role != "DOMAIN":
                raise UnsupportedOperation(f"only DOMAIN axes can be reduced, not {n.params['axis']}; results are averaged over the others")
            kind = reduced_kind(n.params["kind"], kinds[0])
            if n.params["axis"] in axes:
                return Placed(axes - {n.params["axis"]}, kind, args[0].depth + 1, f"n{n.id}")
        elif n.op in numeric.BINARY or n.op in numeric.UNARY:
            kind = result_kind(n.op, kinds)
        elif n.op == "where":
            kind = numeric.common_kind(kinds[1:])
        elif n.op in ("multi_clause_where", "exclusive_multi_clause_where"):
            values = kinds[1::2]
            kind = "str" if "str" in values else numeric.common_kind([*values, kinds[-1]])
        elif n.op == "function_call":
            self._function(n)
            kind = "float"
            if n.id in self.packs and TIME in axes:
                return Placed(axes - {TIME}, kind, self.placed[self.packs[n.id].id].depth + 1, f"n{n.id}")
        elif n.op == "pack":
            kind = "struct"
        else:
            raise UnsupportedNodeType(n.op)
        depth = max((a.depth + (a.literal is None and a.axes != axes) for a in used), default=0)
        if all(a.literal is not None for a in used) and n.op not in ("function_call", "pack"):
            # constants are folded here and now: as columns they would grow with every use
            values = [a.value for a in args]
            value = numeric.fold_over_one(n.params["kind"], values[0], kind) if n.op == "reduce" else numeric.fold(n.op, values, kind)
            return Placed(axes, kind, 0, literal=numeric.literal(value, kind), value=value)
        return Placed(axes, kind, depth, f"n{n.id}")

    def _function(self, n: Node) -> Function:
        if n.name not in self.binding.functions:
            raise FunctionNotFound(n.name)
        return self.binding.functions[n.name]

    def _kind(self, n: Node) -> str:
        kind = self._function(n).kind
        return kind or ("series" if any(TIME in self.placed[a.id].axes for a in n.args) else "vector")

    # frames ---------------------------------------------------------------------------------------------------------

    def _build(self) -> None:
        groups: dict[tuple[int, Axes], list[Node]] = {}
        for n in self.order:
            p = self.placed[n.id]
            if p.literal is None and n.op != "variant_selector" and n.id not in self.alias:
                groups.setdefault((p.depth, p.axes), []).append(n)
        for group in sorted(groups, key=lambda g: (g[0], len(g[1]), sorted(g[1]))):
            self.frames[group] = self._frame(group, groups[group])

    def _keys(self, axes: Axes) -> list[str]:
        """Key columns, and beside an ensemble's the column of its weight."""
        out = []
        for a in layout(sorted(axes)):
            out.append(a.key)
            t = self.binding.tables.get(a)
            if t is not None and t.weight:
                out.append(t.weight)
        return out

    def _axis_frame(self, axis: Axis, nodes: list[Node]) -> DataFrame:
        ids = {n.id for n in nodes}
        if axis == TIME and axis not in self.binding.tables:
            series = {f"n{k}": v for k, v in self.binding.series.items() if k in ids}
            if not series:
                k, v = next(iter(self.binding.series.items()))
                series = {f"n{k}": v}
            return array_table(self.spark, TIME.key, series).select(TIME.key, *(c for c in series if int(c[1:]) in ids))
        t = self.binding.tables[axis]
        return t.df.select(*self._keys(frozenset([axis])), *[F.col(c).alias(f"n{k}") for k, c in t.columns.items() if k in ids])

    def _frame(self, group: tuple[int, Axes], nodes: list[Node]) -> DataFrame:
        depth, axes = group
        nodes = [n for n in nodes if n.op != "pack" or TIME in axes]
        reductions = [n for n in nodes if n.op == "reduce" and n.params["axis"] in self.placed[n.args[0].id].axes]
        reductions += [n for n in nodes if n.id in self.packs and TIME in self.placed[self.packs[n.id].id].axes]
        parts: list[tuple[Axes, DataFrame]] = []
        by_source: dict[tuple[int, Axes], list[Node]] = {}
        for n in reductions:
            a = self.placed[self.packs.get(n.id, n.args[0]).id if n.op == "function_call" else n.args[0].id]
            by_source.setdefault((a.depth, a.axes), []).append(n)
        for source, own in by_source.items():
            keys = self._keys(source[1] & axes)
            named = [self._summary(n) if n.op == "function_call" else numeric.aggregate(n.params["kind"], (F.col(self.placed[n.args[0].id].column), self.placed[n.args[0].id].kind), n.params.get("q")).alias(f"n{n.id}") for n in own]
            parts.append((axes, self.frames[source].groupBy(*keys).agg(*named)))
        reduced = {n.id for n in reductions}
        # columns of other frames that formulas here use
        here = {n.id for n in nodes}
        needed: dict[tuple[int, Axes], dict[str, None]] = {}
        for n in nodes:
            if n.id in reduced or (depth == 0 and self._bound(n)) or n.op in LEAVES:
                continue
            for a in (*n.args, *([self.guards[n.id]] if n.id in self.guards else [])):
                p = self.placed[a.id]
                if p.literal is None and self._meant(a).id not in here and p.column:
                    if (p.depth, p.axes) != group:
                        needed.setdefault((p.depth, p.axes), {})[p.column] = None
        for source, columns in sorted(needed.items(), key=lambda x: (-len(x[0][1]), -x[0][0])):
            parts.append((source[1], self.frames[source].select(*self._keys(source[1]), *columns)))
        for n in nodes:
            if n.id in self.binding.frames:
                part = self.binding.frames[n.id][0].select(f"n{n.id}")
                for a in axes:
                    t = self.binding.tables.get(a)
                    if t is not None and t.weight:
                        part = part.join(t.df.select(a.key, t.weight), a.key)
                parts.append((axes, part))
        if depth == 0 and len(axes) == 1 and (next(iter(axes)) in self.binding.tables or self.binding.series):
            parts.insert(0, (axes, self._axis_frame(next(iter(axes)), nodes)))
        df, have = None, frozenset()
        for own, part in sorted(parts, key=lambda x: -len(x[0])):
            if df is None:
                df, have = part, own
                continue
            on = [a.key for a in layout(sorted(own & have))]
            extra = [c for c in part.columns if c not in df.columns or c in on]
            df = df.join(part.select(*extra), on) if on else df.crossJoin(part.select(*extra))
            have = have | own
        for a in layout(sorted(axes - have)):
            part = self._axis_frame(a, [])
            df = part if df is None else df.crossJoin(part)
        if df is None:
            df = self.spark.range(1).select()
        return self._project(df, [n for n in nodes if n.id not in reduced], axes)

    def _project(self, df: DataFrame, nodes: list[Node], axes: Axes) -> DataFrame:
        """Add the nodes' columns, level by level."""
        level: dict[int, int] = {}
        for n in nodes:
            if f"n{n.id}" in df.columns:
                continue
            level[n.id] = 1 + max((level.get(self._meant(a).id, 0) for a in (*n.args, *([self.guards[n.id]] if n.id in self.guards else []))), default=0)
        for k in sorted(set(level.values())):
            own = [n for n in nodes if level.get(n.id) == k]
            late = [n for n in own if n.op == "function_call" and self._kind(n) == "series" and TIME in axes]
            simple = [n for n in own if not any(n is x for x in late)]
            if simple:
                df = df.select("*", *[self._column(n).alias(f"n{n.id}") for n in simple])
            for n in late:
                df = self._series(df, n, axes)
        return df

    def _meant(self, n: Node) -> Node:
        while n.id in self.alias:
            n = self.alias[n.id]
        return n

    def _value(self, n: Node) -> tuple[Column, str]:
        p = self.placed[n.id]
        return (p.literal if p.literal is not None else F.col(p.column)), p.kind

    def _column(self, n: Node) -> Column:
        if n.id in self.binding.callables:
            return self.binding.callables[n.id][1].cast("double")
        if n.op == "reduce":
            return numeric.over_one(n.params["kind"], self._value(n.args[0]))
        return self._expression(n, [self._value(a) for a in n.args])

    def _expression(self, n: Node, args: list[tuple[Column, str]]) -> Column:
        if n.op in numeric.BINARY:
            return numeric.BINARY[n.op](*args)
        if n.op in numeric.UNARY:
            return numeric.UNARY[n.op](*args)
        if n.op == "where":
            return numeric.choose([(args[0], args[1])], args[2], strict=False)
        if n.op in ("multi_clause_where", "exclusive_multi_clause_where"):
            return numeric.choose(list(zip(args[:-1:2], args[1:-1:2])), args[-1], strict=True)
        if n.op == "function_call":
            return self._call(n, args)
        if n.op == "pack":
            time = [F.col(TIME.key).alias("at")] if TIME in self.placed[n.id].axes else []
            return F.struct(*time, *[c.alias(f"a{k}") for k, (c, _) in enumerate(args)])
        raise UnsupportedNodeType(n.op)

    def _summary(self, n: Node) -> Column:
        """A function of whole series, one call for each group: the rows of a group are put in order of time. What does
        not vary in time is a scalar."""
        call, keywords = self._function(n).call, n.params["keywords"]
        varies = [TIME in self.placed[a.id].axes for a in n.args]
        rows = F.sort_array(F.collect_list(self.placed[self.packs[n.id].id].column))

        def argument(k: int) -> Column:
            return F.transform(rows, lambda row: row[f"a{k}"])

        def run(*columns: pd.Series) -> pd.Series:
            out = []
            for row in zip(*columns):
                values = [np.asarray(x) if v else x[0] for x, v in zip(row, varies)]
                at = len(values) - len(keywords)
                out.append(float(call(*values[:at], **dict(zip(keywords, values[at:])))))
            return pd.Series(out, dtype=float)

        return F.pandas_udf(run, "double")(*[argument(k) for k in range(len(n.args))]).alias(f"n{n.id}")

    def _call(self, n: Node, args: list[tuple[Column, str]]) -> Column:
        call, keywords = self._function(n).call, n.params["keywords"]
        if self._kind(n) == "column":
            split = len(args) - len(keywords)
            return call(*[c for c, _ in args[:split]], **dict(zip(keywords, (c for c, _ in args[split:])))).cast("double")
        guard = numeric.truth(self._value(self.guards[n.id])) if n.id in self.guards else F.lit(True)
        single = self._kind(n) == "summary"

        def run(mask: pd.Series, *columns: pd.Series) -> pd.Series:
            rows = mask.fillna(False).to_numpy(bool)
            out = np.full(len(rows), np.nan)
            if rows.any():
                values = [c.to_numpy()[rows] for c in columns]
                at = len(values) - len(keywords)
                if single:  # a summary of what does not vary in time: scalars
                    out[rows] = [float(call(*v[:at], **dict(zip(keywords, v[at:])))) for v in zip(*values)]
                else:
                    out[rows] = call(*values[:at], **dict(zip(keywords, values[at:])))
            return pd.Series(out)

        return F.pandas_udf(run, "double")(guard, *[c for c, _ in args])

    def _series(self, df: DataFrame, n: Node, axes: Axes) -> DataFrame:
        """A function on whole series: one call for each combination of the other axes."""
        call, keywords, name = self._function(n).call, n.params["keywords"], f"n{n.id}"
        inputs = [(f"a{n.id}_{k}", a) for k, a in enumerate(n.args)]
        varies = [TIME in self.placed[a.id].axes for a in n.args]
        keys = [a.key for a in layout(sorted(axes - {TIME}))]
        guard = numeric.truth(self._value(self.guards[n.id])) if n.id in self.guards else F.lit(True)
        wide = df.select("*", guard.alias("_guard"), *[self._value(a)[0].alias(c) for c, a in inputs])
        kept = df.schema

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(TIME.key)
            out = np.full(len(pdf), np.nan)
            if len(pdf) and pdf["_guard"].fillna(False).all():
                values = [pdf[c].to_numpy() if v else pdf[c].iloc[0] for (c, _), v in zip(inputs, varies)]
                at = len(values) - len(keywords)
                out[:] = call(*values[:at], **dict(zip(keywords, values[at:])))
            return pdf[kept.names].assign(**{name: out})

        from pyspark.sql import types as T

        schema = T.StructType([*kept.fields, T.StructField(name, T.DoubleType())])
        grouped = wide.groupBy(*keys) if keys else wide.groupBy(F.lit(0))
        return grouped.applyInPandas(run, schema)

    # results --------------------------------------------------------------------------------------------------------

    def frame(self, n: Node) -> tuple[list[Axis], DataFrame]:
        """(axes in layout, keys and weights with the node's value as ``value``)."""
        p = self.placed[n.id]
        if p.literal is not None:
            return [], self.spark.range(1).select(p.literal.alias("value"))
        df = self.frames[(p.depth, p.axes)]
        return layout(sorted(p.axes)), df.select(*self._keys(p.axes), F.col(p.column).alias("value"))


def _guards(roots: list[Node]) -> dict[int, Node]:
    """The condition under which each function call in a branch of an exclusive choice may see rows."""
    nodes = _ordered(roots, {})
    uses: dict[int, set[int]] = {}
    for n in nodes:
        for a in n.args:
            uses.setdefault(a.id, set()).add(n.id)
    top = {n.id for n in roots}
    by_id = {n.id: n for n in nodes}
    out: dict[int, Node] = {}
    for n in nodes:
        if n.op != "exclusive_multi_clause_where" or n.params.get("companion") is None:
            continue
        merged = {m.id for m in n.params["companion"].params["merged"]}
        clauses = list(zip(n.args[:-1:2], n.args[1:-1:2]))
        for condition, value in clauses:
            # what only this branch uses: all of its users are in it, or are the choices themselves
            inside = {value.id}
            for m in reversed(nodes):
                if m.id in uses and m.id not in top and uses[m.id] <= inside | merged and uses[m.id] & (inside | merged) and _under(value, m):
                    inside.add(m.id)
            for k in inside:
                if by_id[k].op == "function_call":
                    out.setdefault(k, condition)
    return out


def _under(root: Node, n: Node) -> bool:
    stack, seen = [root], set()
    while stack:
        x = stack.pop()
        if x is n:
            return True
        if x.id not in seen:
            seen.add(x.id)
            stack += x.args
    return False


def _ordered(roots: list[Node], guards: Mapping[int, Node], alias: Mapping[int, Node] | None = None) -> list[Node]:
    alias = alias or {}
    done: dict[int, Node] = {}
    for root in roots:
        stack = [(root, False)]
        while stack:
            n, ready = stack.pop()
            if n.id in done:
                continue
            if ready:
                done[n.id] = n
                continue
            stack.append((n, True))
            needs = (alias[n.id],) if n.id in alias else (*n.args, *([guards[n.id]] if n.id in guards else []))
            stack += [(a, False) for a in reversed(needs)]
    return list(done.values())
