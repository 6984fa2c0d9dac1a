"""Plug-in points: what a model or parser must offer to take the place of the built-in one, and how one is chosen."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame


class EmbeddingProvider(Protocol):
    """A text column to a vector column (a built-in expression or an Arrow UDF)."""

    name: str
    dimensions: int

    def __call__(self, text: Column) -> Column: ...


class Reranker(Protocol):
    """(query, text) to a score column."""

    def __call__(self, query: str, text: Column) -> Column: ...


class Parser(Protocol):
    """Files (path, content) to rows; ``accepts`` decides by extension."""

    def accepts(self, path: Column) -> Column: ...

    def __call__(self, files: DataFrame) -> DataFrame: ...


class ExtractionProvider(Protocol):
    """Chunks to fact candidates."""

    def __call__(self, chunks: DataFrame) -> DataFrame: ...


class VisualClassifier(Protocol):
    """Visuals with visual_type, confidence and review_status."""

    def __call__(self, visuals: DataFrame, text: Column) -> DataFrame: ...


class AnswerProvider(Protocol):
    """Facts of each key, in order, to one answer per key: (key, answer)."""

    def __call__(self, facts: DataFrame, *, key: str, order: str) -> DataFrame: ...


class IdentityProvider(Protocol):
    """Attempts and users to identities and states."""

    def __call__(self, attempts: DataFrame, users: DataFrame) -> DataFrame: ...


def chosen(name: str, available: dict[str, Callable], fallback: str) -> Callable:
    """The provider of a setting; where it is not there, the fallback (KeyError only if that is missing too)."""
    return available.get(name) or available[fallback]


def load(name: str, loaders: dict[str, Callable[[], Callable]], fallback: str) -> tuple[Callable, str, str]:
    """(provider, its name, status): the provider of a setting if it can be loaded, else the fallback.

    The status is READY, FALLBACK with the reason (its loader failed) or NOT_CONFIGURED (there is no such loader).
    """
    if name not in loaders:
        return loaders[fallback](), fallback, "NOT_CONFIGURED"
    try:
        return loaders[name](), name, "READY"
    except (ImportError, OSError, RuntimeError) as e:
        if name == fallback:
            raise
        return loaders[fallback](), fallback, f"FALLBACK: {e}"
