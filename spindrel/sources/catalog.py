"""Index names and aliases, in a small versioned file."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..mapping import IndexMapping, from_dict, to_dict
from .files import Conflict, Folder


class Catalog:
    """Changes are read, applied and committed as the next version; where another writer was first, once more."""

    def __init__(self, spark: SparkSession, uri: str):
        self.folder = Folder(spark, uri)

    def state(self) -> dict:
        found = self.folder.versions()
        return self.folder.manifest(max(found)) if found else {"version": 0, "indexes": {}, "aliases": {}}

    def _change(self, apply) -> None:
        for _ in range(5):
            state = self.state()
            apply(state)
            state["version"] += 1
            try:
                return self.folder.commit(state["version"], state)
            except Conflict:
                continue
        raise Conflict("the catalog keeps changing")

    def create(self, mapping: IndexMapping) -> None:
        def apply(state: dict) -> None:
            if mapping.name in state["indexes"] or mapping.name in state["aliases"]:
                raise ValueError(f"{mapping.name!r} exists")
            state["indexes"][mapping.name] = to_dict(mapping)

        self._change(apply)

    def drop(self, name: str) -> None:
        """The index and the aliases of it."""

        def apply(state: dict) -> None:
            if name not in state["indexes"]:
                raise KeyError(f"no index {name!r}")
            del state["indexes"][name]
            state["aliases"] = {a: i for a, i in state["aliases"].items() if i != name}

        self._change(apply)

    def alias(self, alias: str, index: str) -> None:
        """Sets or moves an alias; it may not hide an index."""

        def apply(state: dict) -> None:
            if index not in state["indexes"]:
                raise KeyError(f"no index {index!r}")
            if alias in state["indexes"]:
                raise ValueError(f"{alias!r} is an index")
            state["aliases"][alias] = index

        self._change(apply)

    def resolve(self, name: str) -> str:
        """An alias's index; any other name is its own."""
        return self.state()["aliases"].get(name, name)

    def mapping(self, name: str) -> IndexMapping:
        found = self.state()["indexes"].get(self.resolve(name))
        if not found:
            raise KeyError(f"no index {name!r}")
        return from_dict(found)
