"""A database: a mapping from names to collections."""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame

from .collection import Collection
from .plans.snapshot import session
from .sources.store import Store


class Database(Mapping):
    __hash__ = None

    def __init__(self, store: Store):
        self._store = store

    @staticmethod
    def _named(name) -> str:
        if not isinstance(name, str):
            raise TypeError(f"a collection's name is a str, not {type(name).__name__}")
        if not name:
            raise ValueError("a collection's name can't be empty")
        return name

    def __getitem__(self, name: str) -> Collection:
        return self.collection(name)

    def collection(self, name: str, model=None) -> Collection:
        """A handle on a collection, whether it exists or not; with a model, documents are read as its instances."""
        self._store.now()
        return Collection(self._store, self._named(name), model)

    def _names(self) -> list[str]:
        return sorted(self._store.now().collections, key=lambda n: n.encode("utf-8", "surrogatepass"))

    def __iter__(self) -> Iterator[str]:
        return iter(self._names())

    def __len__(self) -> int:
        return len(self._store.now().collections)

    def __contains__(self, name) -> bool:
        return isinstance(name, str) and name in self._store.now().collections

    def __delitem__(self, name: str) -> None:
        """Drop a collection and all it holds."""
        self._named(name)

        def change(collections):
            if name not in collections:
                raise KeyError(name)
            del collections[name]
            return collections

        self._store.commit(change)

    def names_df(self) -> DataFrame:
        return session().createDataFrame([(n,) for n in self._names()], "name string")

    def vacuum(self, *, force: bool = False) -> int:
        """Remove segments that no version in use needs; tells how many. Those behind a DataFrame count as in use for a day, unless forced."""
        return self._store.vacuum(force)

    def close(self) -> None:
        """Close the database; every later use raises Error. The Spark session stays."""
        self._store.close()

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def open(path: str | os.PathLike | None = None, *, durable: bool = True) -> Database:
    """Open or create the database directory at path; None makes one that vanishes with the process.

    durable: whether each commit is synced to disk before it returns.
    """
    return Database(Store(None if path is None else os.fspath(path), durable))
