"""What parsers, stores and embedding functions have to offer, and how the latter are chosen."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

Embed = Callable[[list[str]], list[list[float]]]


@runtime_checkable
class Parser(Protocol):
    """Turns documents (path, content) into nodes and edges of one namespace."""

    namespace: str

    def parse(self, documents: DataFrame) -> tuple[DataFrame, DataFrame]: ...


@runtime_checkable
class Store(Protocol):
    """Keeps the nodes and edges of a graph."""

    def write(self, nodes: DataFrame, edges: DataFrame) -> int: ...

    def read(self) -> tuple[DataFrame, DataFrame]: ...

    def delete_by_source(self, source_file: str, namespace: str) -> int: ...

    def has_changed(self, source_file: str, namespace: str, content_hash: str) -> bool: ...


class Embedders:
    """Embedding functions by name, a default and namespaces with their own.

    ``indexing_only`` names those that must not answer queries.
    """

    def __init__(self, known: dict[str, Callable[[dict], Embed]], default: str, indexing_only: frozenset[str] = frozenset()):
        self.known, self.default, self.indexing_only = known, default, indexing_only

    def get(self, settings: dict, namespace: str = "", for_query: bool = False) -> Embed:
        """The function of a namespace: ``settings['namespaces'][ns]`` over ``settings``, whose key ``backend`` names it."""
        own = {k: v for k, v in settings.items() if k != "namespaces"} | settings.get("namespaces", {}).get(namespace, {})
        name = own.get("backend", self.default)
        if name not in self.known:
            raise ValueError(f"unknown embedding backend {name!r}; known are {sorted(self.known)}")
        if for_query and name in self.indexing_only:
            raise ValueError(f"{name!r} is for indexing only")
        return self.known[name](own)
