"""Typed errors and warnings of the library."""

from __future__ import annotations


class LatticeworkError(Exception):
    """Base of the library's errors."""


class GraphFileNotFound(LatticeworkError):
    """A graph, document or table file is missing."""


class FrameworkNotFound(LatticeworkError):
    """No document for a framework; `slug` names it."""

    def __init__(self, slug: str, path: str):
        super().__init__(f"no document for framework {slug!r} at {path}")
        self.slug = slug


class UnknownPrefix(LatticeworkError):
    """A prefix that the registry doesn't have."""


class MissingFrameworkWarning(UserWarning):
    """A framework of a union is missing and is left out."""
