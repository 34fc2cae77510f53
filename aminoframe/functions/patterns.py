"""A user's regular expressions, in Python's syntax: written anew for Java where both mean the same, else left to Python.

Sequences have the 20 residues only, so a class becomes the residues that it holds, and what no residue matches becomes a
failure.  Conditional groups, flags inside a pattern and patterns that match nothing at all are Python's.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _constants as op
from re import _parser

from .alphabet import RESIDUES

_NEVER = "(?!)"
_CATEGORIES = {op.CATEGORY_DIGIT: r"\d", op.CATEGORY_NOT_DIGIT: r"\D", op.CATEGORY_SPACE: r"\s", op.CATEGORY_NOT_SPACE: r"\S", op.CATEGORY_WORD: r"\w", op.CATEGORY_NOT_WORD: r"\W"}
_PLACES = {op.AT_BEGINNING: "^", op.AT_BEGINNING_STRING: "^", op.AT_END: r"\z", op.AT_END_STRING: r"\z"}
_REPEATS = {op.MAX_REPEAT: "", op.MIN_REPEAT: "?", op.POSSESSIVE_REPEAT: "+"}


class _PythonOnly(Exception):
    pass


def for_java(pattern: str) -> str | None:
    """The pattern in Java's syntax (and, for plain patterns, RE2's), or None if only Python can run it."""
    tree = _parser.parse(pattern)
    if tree.getwidth()[0] == 0:
        return None
    try:
        return _sequence(tree, bool(tree.state.flags & re.IGNORECASE))
    except _PythonOnly:
        return None


def _letters(kept: Iterable[str]) -> str:
    found = "".join(sorted(kept))
    if len(found) == len(RESIDUES):
        return "."
    return found if len(found) == 1 else f"[{found}]" if found else _NEVER


def _holds(items: list, residue: str) -> bool:
    """Whether a class has a residue."""
    negated = items[0][0] is op.NEGATE

    def one(kind, value) -> bool:
        if kind is op.LITERAL:
            return value == ord(residue)
        if kind is op.RANGE:
            return value[0] <= ord(residue) <= value[1]
        return bool(re.match(_CATEGORIES[value], residue))

    return any(one(*item) for item in items[negated:]) != negated


def _matching(kind, value, fold: bool) -> str:
    """Residues that one item of a pattern matches."""
    if kind is op.ANY:
        return RESIDUES
    items = value if kind is op.IN else [(op.LITERAL, value)]
    if kind is op.NOT_LITERAL:
        items = [(op.NEGATE, None), *items]
    either = lambda a: _holds(items, a) or fold and _holds(items, a.lower())
    if fold and items[0][0] is op.NEGATE:
        either = lambda a: _holds(items, a) and _holds(items, a.lower())
    return "".join(a for a in RESIDUES if either(a))


def _sequence(tree, fold: bool) -> str:
    return "".join(_item(kind, value, fold) for kind, value in tree)


def _item(kind, value, fold: bool) -> str:
    if kind in (op.LITERAL, op.NOT_LITERAL, op.ANY, op.IN):
        return _letters(_matching(kind, value, fold))
    if kind is op.BRANCH:
        return "(?:" + "|".join(_sequence(t, fold) for t in value[1]) + ")"
    if kind is op.SUBPATTERN and not value[1] and not value[2]:
        return ("(?:" if value[0] is None else "(") + _sequence(value[3], fold) + ")"
    if kind in _REPEATS:
        low, high, inner = value
        body = _sequence(inner, fold)
        if len(inner) > 1 or inner[0][0] not in (op.LITERAL, op.NOT_LITERAL, op.ANY, op.IN, op.SUBPATTERN) or body == _NEVER:
            body = f"(?:{body})"
        return body + "{" + (f"{low}" if low == high else f"{low}," if high is op.MAXREPEAT else f"{low},{high}") + "}" + _REPEATS[kind]
    if kind is op.ATOMIC_GROUP:
        return f"(?>{_sequence(value, fold)})"
    if kind is op.AT and value in _PLACES:
        return _PLACES[value]
    if kind in (op.ASSERT, op.ASSERT_NOT):
        return "(?" + ("<" if value[0] < 0 else "") + ("=" if kind is op.ASSERT else "!") + _sequence(value[1], fold) + ")"
    if kind is op.GROUPREF:
        return f"(?:\\{value})"
    raise _PythonOnly
