"""Descriptors: named sets of features, declared as expressions; users add their own with ``register``."""

from __future__ import annotations

import inspect
from collections.abc import Mapping
from typing import ClassVar

from ..functions.dialect import Dialect
from .kinds import Kind, ParameterError

REGISTRY: dict[str, type[Descriptor]] = {}


class Descriptor:
    """``features`` lists (name, expression) in output order; parameters are keyword arguments of ``__init__``."""

    name: ClassVar[str] = ""
    family: ClassVar[str] = ""
    #: What ``register`` was told of the parameters; one that isn't named takes any value.
    kinds: ClassVar[Mapping[str, Kind]] = {}

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        raise NotImplementedError

    def columns(self) -> list[str]:
        """Names of the features, without any data."""
        return [name for name, _ in self.features(Dialect())]

    @classmethod
    def parameters(cls) -> dict[str, inspect.Parameter]:
        if cls.__init__ is object.__init__:
            return {}
        return {k: p for k, p in inspect.signature(cls.__init__).parameters.items() if k != "self" and p.kind is not p.VAR_KEYWORD}

    @classmethod
    def defaults(cls) -> dict[str, object]:
        return {k: p.default for k, p in cls.parameters().items() if p.default is not p.empty}

    @classmethod
    def problems(cls, given: Mapping[str, object]) -> list[tuple[str, str]]:
        """(parameter, what is wrong with it) of all that is wrong; the parameter is "" where none is to blame."""
        own = cls.parameters()
        found = [(k, "unknown parameter") for k in given if k not in own]
        found += [(k, complaint) for k, kind in cls.kinds.items() if k in given and (complaint := kind.complaint(given[k]))]
        if not found:
            try:
                cls(**given).columns()
            except ParameterError as e:
                found.append((e.parameter, str(e)))
            except Exception as e:  # a user's descriptor may raise anything
                found.append(("", str(e)))
        return found


def register(name: str, family: str, **kinds: Kind):
    """Adds a descriptor class under a name, with the kinds of its parameters; the last one registered counts."""

    def add(cls: type[Descriptor]) -> type[Descriptor]:
        cls.name, cls.family, cls.kinds = name, family, kinds
        REGISTRY[name] = cls
        return cls

    return add


def lengths() -> list[tuple[str, str]]:
    return [("length", "n"), ("valid_residue_count", "n")]
