import numpy as np
import pytest

from axiloom.axes import DOMAIN, ENSEMBLE, TIME, Axis, layout
from axiloom.errors import UnsupportedNodeType
from axiloom.index import Index, TimeseriesIndex
from axiloom.plans import expr
from axiloom.plans.expr import Node, constant, linearize, piecewise, placeholder, where
from axiloom.plans.sqltext import to_sql


def test_axes_are_equal_by_value():
    assert Axis("time", DOMAIN) == TIME and hash(Axis("time")) == hash(TIME) and Axis("time", ENSEMBLE) != TIME
    assert [a.name for a in layout([TIME, Axis("e", ENSEMBLE), Axis("p", "PARAMETER")])] == ["p", "e", "time"]


def test_operators_build_nodes_and_nodes_have_no_truth_value():
    a, b = placeholder("a"), placeholder("b")
    for n, op in ((a + b, "add"), (1 - a, "subtract"), (a == b, "equal"), (a & b, "logical_and"), (~a, "logical_not"), (2**a, "power"), (a > 1, "greater")):
        assert isinstance(n, Node) and n.op == op
    with pytest.raises(TypeError):
        bool(a == b)
    assert (1 - a).args[0].params["value"] == 1
    assert len({a, b, a}) == 2


def test_order_visits_each_node_once_after_its_arguments():
    a = placeholder("a")
    b = a + 1
    c = b * b
    order = linearize([c, b])
    assert [n.id for n in order] == sorted({n.id for n in order}, key=[n.id for n in order].index) and len(order) == 4
    assert [n.id for n in order].index(b.id) < [n.id for n in order].index(c.id)
    assert [n.id for n in linearize([c], boundary=[b])] == [c.id]


def test_cycles_are_found():
    a = placeholder("a")
    b = a + 1
    b.args = (b, a)
    with pytest.raises(ValueError, match="cycle"):
        linearize([b])


def test_piecewise_drops_what_cannot_be_reached():
    x = placeholder("x")
    assert piecewise((x, True)) is x
    n = piecewise((1, x > 1), (2, True), (3, x > 0))
    assert n.op == "multi_clause_where" and len(n.args) == 3 and n.args[-1].params["value"] == 2
    assert np.isnan(piecewise((1, x > 1)).args[-1].params["value"])
    with pytest.raises(ValueError):
        piecewise()


def test_output_axes():
    t = TimeseriesIndex("t", np.arange(3.0))
    i = Index("i", 2.0)
    assert t.output_axes == (TIME,) and i.output_axes == () and (t * i).output_axes == (TIME,)
    assert t.sum().output_axes == () and where(i > 1, t, 0).output_axes == (TIME,)


def test_reductions_check_their_arguments():
    t = TimeseriesIndex("t", np.arange(3.0))
    with pytest.raises(ValueError):
        t.quantile(1.5)
    with pytest.raises(TypeError):
        expr.project_using_sum(t, -1)
    assert expr.project_using_quantile(t, TIME, 0.3).params["q"] == 0.3


def test_text_forms():
    a, b = placeholder("a"), placeholder("b")
    n = a + b
    assert repr(n) == f"n{n.id} = n{a.id} + n{b.id}"
    assert to_sql(n * 2, {a.id: "x", b.id: "y"}) == "((x + y) * 2.0::DOUBLE)"
    with pytest.raises(UnsupportedNodeType):
        to_sql(expr.function_call("f", a), {a.id: "x"})
    assert constant("it's").params["value"] == "it's"
