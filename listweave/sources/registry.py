"""Sources by name. A source turns landed pages into listings in arrival order."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import Protocol

from pyspark.sql import DataFrame


class Source(Protocol):
    def __call__(
        self, raw_pages: DataFrame, count: int | None, days: int | None, as_of: datetime
    ) -> DataFrame: ...


_SOURCES: dict[str, Source] = {}


def register(name: str) -> Callable[[Source], Source]:
    def add(source: Source) -> Source:
        _SOURCES[name] = source
        return source

    return add


def source(name: str) -> Source:
    if name not in _SOURCES:
        raise KeyError(f"no source {name!r}; known: {', '.join(sorted(_SOURCES))}")
    return _SOURCES[name]
