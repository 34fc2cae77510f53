"""Failures that callers tell apart."""

from __future__ import annotations


class SequenceError(Exception):
    """A failure of the data or of the files."""


class InputError(SequenceError):
    """A file is missing, unreadable, malformed or of an unknown kind."""


class IdError(SequenceError):
    """Ids are empty or repeat."""


class IdColumnError(IdError):
    """The id column is missing: a mistake of usage."""
