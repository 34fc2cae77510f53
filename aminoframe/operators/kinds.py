"""Kinds of parameters: what a descriptor declares of its parameters, and checks of the values that it is given."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass


class ParameterError(ValueError):
    """A value that its descriptor can't work with; ``parameter`` names it."""

    def __init__(self, parameter: str, message: str) -> None:
        super().__init__(message)
        self.parameter = parameter


@dataclass(frozen=True)
class Kind:
    title: str
    accepts: Callable[[object], bool]

    def complaint(self, value: object) -> str | None:
        return None if self.accepts(value) else f"expected {self.title}, got {type(value).__name__}"


FLAG = Kind("bool", lambda v: v is True or v is False)
WHOLE = Kind("int", lambda v: isinstance(v, int) and not FLAG.accepts(v))
NUMBER = Kind("float", lambda v: isinstance(v, float) or WHOLE.accepts(v))
TEXT = Kind("str", lambda v: isinstance(v, str))


def several(kind: Kind) -> Kind:
    return Kind(f"list of {kind.title}", lambda v: isinstance(v, (list, tuple, set, frozenset)) and all(map(kind.accepts, v)))


def named(kind: Kind) -> Kind:
    return Kind(f"mapping of names to {kind.title}", lambda v: isinstance(v, Mapping) and all(map(TEXT.accepts, v)) and all(map(kind.accepts, v.values())))


def maybe(kind: Kind) -> Kind:
    return Kind(f"{kind.title} or nothing", lambda v: v is None or kind.accepts(v))
