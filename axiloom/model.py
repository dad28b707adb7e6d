"""Models: bundles of indexes with a contract of inputs, outputs and exposed indexes; and variants of a model."""

from __future__ import annotations

import dataclasses
import inspect
import warnings
from collections.abc import Iterable, Iterator, Mapping, Sequence
from typing import Any

from axiloom.index import CategoricalIndex, GenericIndex, Index
from axiloom.plans import expr
from axiloom.plans.expr import Node


class ModelContractWarning(UserWarning):
    """A model does not keep to its declared contract."""


class InputsContractWarning(ModelContractWarning):
    """An index came in as an argument but is not declared as input."""


class AbstractIndexNotInInputsWarning(ModelContractWarning):
    """An abstract index is not declared as input, so an ensemble will find it only elsewhere."""


def _flat(value: Any) -> Iterator[GenericIndex]:
    if isinstance(value, GenericIndex):
        yield value
    elif isinstance(value, Mapping):
        for v in value.values():
            yield from _flat(v)
    elif isinstance(value, (list, tuple)):
        for v in value:
            yield from _flat(v)


def _once(items: Iterable[GenericIndex]) -> list[GenericIndex]:
    """Each once, by identity, in order."""
    return list({id(i): i for i in items}.values())


def _indexes_given(cls: type, self: Any, args: tuple, kwargs: dict[str, Any]) -> dict[str, GenericIndex]:
    """The indexes among the arguments of a model's constructor, alone or in lists and dicts, by where they stand."""
    try:
        bound = inspect.signature(cls.__init__).bind(self, *args, **kwargs).arguments
    except TypeError:  # the constructor itself will tell
        return {}
    out: dict[str, GenericIndex] = {}
    for k, v in list(bound.items())[1:]:
        if isinstance(v, GenericIndex):
            out[k] = v
        elif isinstance(v, (list, tuple)):
            out |= {f"{k}[{n}]": x for n, x in enumerate(v) if isinstance(x, GenericIndex)}
        elif isinstance(v, Mapping):
            out |= {f"{k}[{n!r}]": x for n, x in v.items() if isinstance(x, GenericIndex)}
    return out


class IOProxy:
    """Read-only view of a contract's fields. Iterates over indexes; ``in`` is by identity."""

    def __init__(self, fields: Any = None):
        if fields is None:
            named: dict[str, Any] = {}
        elif dataclasses.is_dataclass(fields):
            named = {f.name: getattr(fields, f.name) for f in dataclasses.fields(fields)}
        else:
            named = dict(fields)
        object.__setattr__(self, "_named", named)

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["_named"][name]
        except KeyError:
            raise AttributeError(f"no field {name!r}; there are {', '.join(self.__dict__.get('_named', {})) or 'none'}") from None

    def __setattr__(self, name: str, value: Any) -> None:
        raise AttributeError("the fields of a contract are read-only")

    def __iter__(self) -> Iterator[GenericIndex]:
        return iter(_once(_flat(self._named)))

    def __len__(self) -> int:
        return len(list(iter(self)))

    def __contains__(self, item: object) -> bool:
        return any(item is i for i in self)

    def names(self) -> list[str]:
        return list(self._named)

    def __repr__(self) -> str:
        return f"IOProxy({', '.join(f'{k}={v!r}' for k, v in self._named.items())})"


class Model:
    """A named bundle of indexes. ``inputs``, ``outputs`` and ``expose`` are dataclasses or mappings of indexes, or of
    lists or dicts of them; ``indexes`` gives a flat list without a contract (deprecated)."""

    def __new__(cls, *args: Any, **kwargs: Any) -> "Model":
        self = super().__new__(cls)
        self.__dict__["_given"] = _indexes_given(cls, self, args, kwargs) if cls is not Model else {}
        return self

    def __init__(self, name: str, indexes: Sequence[GenericIndex] | None = None, *, inputs: Any = None, outputs: Any = None, expose: Any = None):
        self.name = name
        if indexes is not None:
            warnings.warn("Model(name, indexes) is deprecated; declare inputs and outputs", DeprecationWarning, stacklevel=2)
            if expose is not None or any(x is not None and not isinstance(x, (list, tuple)) for x in (inputs, outputs)):
                raise ValueError("give either indexes, with lists of inputs and outputs, or a contract")
            self._listed: list[GenericIndex] | None = list(indexes)
            self.inputs, self.outputs = (IOProxy(self._by_attribute(label, declared or ())) for label, declared in (("inputs", inputs), ("outputs", outputs)))
            self.expose = IOProxy()
            return
        self._listed = None
        self.inputs, self.outputs, self.expose = IOProxy(inputs), IOProxy(outputs), IOProxy(expose)
        for where, i in self._given.items():
            if i not in self.inputs:
                warnings.warn(f"{type(self).__name__}: argument {where!r} is index {i.name!r}, which is not among the inputs", InputsContractWarning, stacklevel=3)
        for i in self.indexes:
            if i.is_abstract() and i not in self.inputs:
                warnings.warn(f"model {name!r}: abstract index {i.name!r} is not among its inputs", AbstractIndexNotInInputsWarning, stacklevel=2)

    def _by_attribute(self, label: str, declared: Sequence[GenericIndex]) -> dict[str, GenericIndex]:
        """The declared indexes of a flat list by the attribute that holds each."""
        names: dict[int, str] = {}
        for k, v in vars(self).items():
            if isinstance(v, GenericIndex):
                names.setdefault(id(v), k)
        out: dict[str, GenericIndex] = {}
        for i in declared:
            said = f"model {self.name!r}: {label}: index {i.name!r}"
            if not any(i is x for x in self._listed or ()):
                raise ValueError(f"{said} is not in the model's indexes list")
            if id(i) not in names:
                raise ValueError(f"{said} is not assigned to any attribute of the model; do so before super().__init__()")
            if names[id(i)] in out:
                raise ValueError(f"{said} is declared twice: a collision of the attribute name {names[id(i)]!r}")
            out[names[id(i)]] = i
        return out

    @property
    def indexes(self) -> list[GenericIndex]:
        return _once(self._listed if self._listed is not None else [*self.inputs, *self.outputs, *self.expose])

    def abstract_indexes(self) -> list[GenericIndex]:
        return [i for i in self.indexes if i.is_abstract()]

    def is_instantiated(self) -> bool:
        return not self.abstract_indexes()

    def __getitem__(self, name: str) -> GenericIndex:
        for i in self.indexes:
            if i.name == name:
                return i
        raise KeyError(name)


class ModelVariant:
    """Alternatives of a model with the same outputs.

    A text selector picks one here and now. A categorical index, a node, or (key, predicate) guards pick one per
    scenario: each output becomes a choice among the variants' outputs, which are evaluated for their own rows.
    """

    def __init__(self, name: str, variants: Mapping[str, Model], selector: Any):
        if not variants:
            raise ValueError(f"variant {name!r} needs variants")
        shapes = {k: m.outputs.names() for k, m in variants.items()}
        first = next(iter(shapes.values()))
        if wrong := [k for k, v in shapes.items() if v != first]:
            raise ValueError(f"variant {name!r}: outputs of {wrong} are not {first}")
        self.name, self.variants = name, dict(variants)
        self.active: Model | None = None
        self.selector: Any = selector
        if isinstance(selector, str):
            if selector not in variants:
                raise ValueError(f"variant {name!r}: no variant {selector!r}; there are {sorted(variants)}")
            self.active = variants[selector]
            return
        if isinstance(selector, (list, tuple)):
            unknown = [k for k, _ in selector if k not in variants]
            if unknown:
                raise ValueError(f"variant {name!r}: guards for unknown variants {unknown}")
            selector = expr.guards_to_selector(selector)
        if isinstance(selector, CategoricalIndex) and (missing := sorted(set(selector.support) - set(variants))):
            raise ValueError(f"variant {name!r}: no variants for {missing}")
        key = expr.as_node(selector)
        merged: dict[str, Index] = {}
        companion = expr.variant_selector(key, {k: [o.node for o in m.outputs] for k, m in variants.items()}, [])
        for f in first:
            fields = {k: getattr(m.outputs, f) for k, m in variants.items()}
            if not all(isinstance(x, GenericIndex) for x in fields.values()):
                raise TypeError(f"variant {name!r}: output {f!r} must be a single index to be chosen at run time")
            node = expr.exclusive_multi_clause_where([(key == k, x) for k, x in fields.items()], float("nan"), companion)
            companion.params["merged"].append(node)
            merged[f] = Index(f, node)
        self.selector_node: Node = key
        self._outputs = IOProxy(merged)

    @property
    def outputs(self) -> IOProxy:
        return self.active.outputs if self.active else self._outputs

    @property
    def inputs(self) -> IOProxy:
        if self.active:
            return self.active.inputs
        named: dict[str, Any] = {}
        for m in self.variants.values():
            for f in m.inputs.names():
                named.setdefault(f, []).append(getattr(m.inputs, f))
        return IOProxy({f: v[0] if len(_once(_flat(v))) == 1 else _once(_flat(v)) for f, v in named.items()})

    @property
    def expose(self) -> IOProxy:
        if self.active:
            return self.active.expose
        names = [set(m.expose.names()) for m in self.variants.values()]
        shared = [n for n in next(iter(self.variants.values())).expose.names() if all(n in s for s in names)]
        return IOProxy({n: [getattr(m.expose, n) for m in self.variants.values()] for n in shared})

    @property
    def indexes(self) -> list[GenericIndex]:
        if self.active:
            return self.active.indexes
        own = [self.selector] if isinstance(self.selector, GenericIndex) else []
        return _once([*own, *self._outputs, *(i for m in self.variants.values() for i in m.indexes)])

    def abstract_indexes(self) -> list[GenericIndex]:
        return [i for i in self.indexes if i.is_abstract()]

    def is_instantiated(self) -> bool:
        return not self.abstract_indexes()
