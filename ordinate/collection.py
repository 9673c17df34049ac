"""A collection: a mapping on the driver, a DataFrame everywhere else."""

from __future__ import annotations

import threading
from collections.abc import Iterator, Mapping, MutableMapping
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import Error
from .functions import documents as D
from .functions import keys as K
from .functions import models as M
from .operators import relational as R
from .plans import snapshot as S
from .sources.store import COMPACT_AT, FLUSH_AT, Segment, State, Store

_NOTHING = State("")


class Collection(MutableMapping):
    """A handle on a named collection; making one creates nothing."""

    __hash__ = None

    def __init__(self, store: Store, name: str, model=None):
        self._store, self.name, self._model = store, name, model
        self._counted: tuple[State, int] | None = None

    def __repr__(self) -> str:
        return f"<collection {self.name!r}>"

    # Snapshots

    def _state(self) -> State:
        return self._store.now().collections.get(self.name, _NOTHING)

    def _lookup(self, k: bytes):
        """The stored Variant of a key, or None."""
        state = self._state()
        if k in state.recent:
            return state.recent[k]
        if not any(s.may_hold(k, k + b"\0") for s in state.segments):
            return None
        found = S.snapshot(S.session(), replace(state, recent={}), k, k + b"\0").limit(1).collect()
        return found[0]["doc"] if found else None

    def _scan(self, low: bytes | None = None, high: bytes | None = None, *, reverse: bool = False, documents: bool = True) -> Iterator:
        """(encoded key, Variant or None) in order, from the version of the call."""
        version = self._store.pinned()
        state = version.collections.get(self.name, _NOTHING)
        if any(s.may_hold(low, high) for s in state.segments):
            df = S.snapshot(S.session(), state, low, high)
            rows = R.in_order(df if documents else df.select("k"), reverse).toLocalIterator()
            pairs = ((bytes(r["k"]), r["doc"] if documents else None) for r in rows)
        else:
            chosen = sorted((k for k, v in state.recent.items() if v is not None and (low is None or k >= low) and (high is None or k < high)), reverse=reverse)
            pairs = ((k, state.recent[k]) for k in chosen)
        return _Cursor(pairs, version)

    def _load(self, variant):
        return M.load(self._model, D.from_variant(variant))

    # Reading

    def __getitem__(self, key):
        found = self._lookup(K.encode(key))
        if found is None:
            raise KeyError(key)
        return self._load(found)

    def __contains__(self, key) -> bool:
        return self._lookup(K.encode(key)) is not None

    def __len__(self) -> int:
        state = self._state()
        if not state.segments:
            return sum(v is not None for v in state.recent.values())
        if len(state.segments) == 1 and not state.segments[0].delta and not state.recent:
            return state.segments[0].rows
        counted = self._counted
        if counted is None or counted[0] is not state:
            self._counted = counted = (state, S.snapshot(S.session(), state).count())
        return counted[1]

    def __iter__(self) -> Iterator:
        return self.keys()

    def __reversed__(self) -> Iterator:
        return _each(self._scan(reverse=True, documents=False), lambda k, _: K.decode(k))

    def keys(self) -> Iterator:
        return _each(self._scan(documents=False), lambda k, _: K.decode(k))

    def values(self) -> Iterator:
        return _each(self._scan(), lambda _, v: self._load(v))

    def items(self) -> Iterator:
        return self._pairs(self._scan())

    def _pairs(self, scan: Iterator) -> Iterator:
        return _each(scan, lambda k, v: (K.decode(k), self._load(v)))

    def range(self, start=None, stop=None) -> Iterator:
        """Pairs with start <= key < stop, in key order; None leaves a side open."""
        return self._pairs(self._scan(*K.range_bounds(start, stop)))

    def prefix(self, p) -> Iterator:
        """Pairs whose key begins with p: text of the first component, or whole components of a tuple."""
        return self._pairs(self._scan(*K.prefix_bounds(p)))

    def first(self):
        return self._end(False)

    def last(self):
        return self._end(True)

    def _end(self, reverse: bool):
        state = self._state()
        if not state.segments:
            live = [k for k, v in state.recent.items() if v is not None]
            if not live:
                return None
            k = max(live) if reverse else min(live)
            return K.decode(k), self._load(state.recent[k])
        version = self._store.pinned()
        for low, high in S.edge(state, reverse):
            df = S.snapshot(S.session(), state, low, high)
            rows = (R.last(df) if reverse else R.first(df)).collect()
            if rows:
                del version
                return K.decode(bytes(rows[0]["k"])), self._load(rows[0]["doc"])
        return None

    def __eq__(self, other) -> bool:
        if isinstance(other, Collection):
            pairs = zip(self.items(), other.items(), strict=True)
        elif isinstance(other, Mapping):
            if len(self) != len(other):
                return False
            missing = object()
            pairs = (((k, v), (k, other.get(k, missing))) for k, v in self.items())
        else:
            return NotImplemented
        try:
            return all(a == b for a, b in pairs)
        except ValueError:  # one side ended before the other
            return False

    # Writing

    def _commit(self, change) -> None:
        """change(state) gives the new state, or None for no commit; the state is empty for a new collection."""

        def of_all(collections):
            old = collections.get(self.name) or State(self._store.new_id())
            new = change(old)
            return None if new is None else collections | {self.name: new}

        self._store.commit(of_all)
        state = self._state()
        if len(state.recent) > FLUSH_AT:
            self._flush()

    def _put(self, rows: dict[bytes, object]) -> None:
        self._commit(lambda state: replace(state, recent=state.recent | rows))

    def __setitem__(self, key, document) -> None:
        self._put({K.encode(key): D.to_variant(M.dump(document))})

    def update(self, other=(), /, **more) -> None:
        """Put many documents in one commit, or none if one of them is unfit."""
        pairs = other.items() if hasattr(other, "items") else [(k, other[k]) for k in other.keys()] if hasattr(other, "keys") else other
        rows = {K.encode(k): D.to_variant(M.dump(v)) for k, v in [*pairs, *more.items()]}
        if rows:
            self._put(rows)

    def _remove(self, key):
        """Delete a key under the writer's lock; gives what it held."""
        k, held = K.encode(key), []

        def change(collections):
            state = collections.get(self.name)
            found = self._lookup(k) if state is not None else None
            if found is None:
                raise KeyError(key)
            held.append(found)
            recent = dict(state.recent)
            if any(s.may_hold(k, k + b"\0") for s in state.segments):
                recent[k] = None
            else:
                del recent[k]
            return collections | {self.name: replace(state, recent=recent)}

        self._store.commit(change)
        return held[0]

    def __delitem__(self, key) -> None:
        self._remove(key)

    _REQUIRED = object()

    def pop(self, key, default=_REQUIRED):
        try:
            return self._load(self._remove(key))
        except KeyError:
            if default is self._REQUIRED:
                raise
            return default

    def popitem(self):
        """Remove and give the pair of the smallest key."""
        with self._store._writing:
            pair = self.first()
            if pair is None:
                raise KeyError("the collection is empty")
            self._remove(pair[0])
            return pair

    def setdefault(self, key, default=None):
        with self._store._writing:
            try:
                return self[key]
            except KeyError:
                self[key] = default
                return default

    def clear(self) -> None:
        """Remove all documents; the collection itself stays."""

        def change(collections):
            state = collections.get(self.name)
            return None if state is None else collections | {self.name: State(self._store.new_id())}

        self._store.commit(change)

    # Bulk

    def _lent(self) -> State:
        return self._store.lend(self._state())

    def df(self, start=None, stop=None) -> DataFrame:
        """The current version as a DataFrame (k, doc), or the part of it between two keys. It can be read as long as its lease lasts, whatever is written or vacuumed."""
        return S.snapshot(S.session(), self._lent(), *K.range_bounds(start, stop))

    def prefix_df(self, p) -> DataFrame:
        return S.snapshot(S.session(), self._lent(), *K.prefix_bounds(p))

    def get_df(self, key) -> DataFrame:
        """The row of a key, if there is one."""
        k = K.encode(key)
        return S.snapshot(S.session(), self._lent(), k, k + b"\0")

    def end_df(self, reverse: bool = False) -> DataFrame:
        """The row of the smallest key, or of the largest; only files at that end are read."""
        state = self._lent()
        for low, high in S.edge(state, reverse):
            df = S.snapshot(S.session(), state, low, high)
            row = R.last(df) if reverse else R.first(df)
            if not row.isEmpty():
                return row
        return S.snapshot(S.session(), _NOTHING)

    def ranked_df(self, start=None, stop=None, *, prefix=None, reverse: bool = False, name: str = "rank") -> DataFrame:
        """df, or the part between two keys or under a prefix, with the place of each row in key order."""
        low, high = K.range_bounds(start, stop) if prefix is None else K.prefix_bounds(prefix)
        return S.ranked(S.session(), self._lent(), low, high, reverse, name)

    def typed_df(self, start=None, stop=None) -> DataFrame:
        """df with the bound model's fields as columns."""
        if self._model is None:
            raise TypeError("no model is bound to this handle")
        return M.typed(self.df(start, stop), self._model)

    def put_df(self, rows: DataFrame, seq: str | None = None) -> None:
        """Put the rows of a DataFrame (k, doc) in one commit; of rows with one key the largest ``seq`` column wins."""
        self._append(rows.select("k", "doc", (F.col(seq) if seq else F.monotonically_increasing_id()).cast("bigint").alias("seq"), F.lit(R.PUT).alias("op")))

    def delete_df(self, keys: DataFrame) -> None:
        """Delete the keys (k) of a DataFrame in one commit; missing ones are passed over."""
        self._append(keys.select("k", F.lit(None).cast("variant").alias("doc"), F.lit(0).cast("bigint").alias("seq"), F.lit(R.DELETE).alias("op")))

    def _append(self, changes: DataFrame) -> None:
        with self._store._writing:
            state = self._state()
            if state is _NOTHING:
                state = State(self._store.new_id())
            if state.recent:
                state = self._flushed(state)
            last = changes.groupBy("k").agg(F.max_by(F.struct("doc", "op"), F.col("seq")).alias("last"))
            merged = last.select("k", "last.doc", F.lit(self._store.now().number + 1).cast("bigint").alias("seq"), "last.op")
            if not state.segments:  # nothing that a change could beat
                segment = self._write(state, merged.where(F.col("op") == R.PUT).select("k", "doc"), delta=False)
            else:
                segment = self._write(state, merged, delta=True)
            self._commit(lambda _: replace(state, segments=(*state.segments, segment)))
            self._tidy()

    def _write(self, state: State, df: DataFrame, *, delta: bool) -> Segment:
        path = self._store.segment_path(state)
        df.repartitionByRange("k").sortWithinPartitions("k").write.parquet(path)
        self._store.settle(path)
        written = S.session().read.schema(S.LOGGED if delta else S.SCHEMA).parquet(path)
        return Segment(path, S.describe(written), delta)

    def _flushed(self, state: State) -> State:
        rows = S.recent_rows(S.session(), state).withColumn("seq", F.lit(self._store.now().number).cast("bigint"))
        return replace(state, segments=(*state.segments, self._write(state, rows, delta=True)), recent={})

    def _flush(self) -> None:
        with self._store._writing:
            state = self._state()
            if state.recent:
                flushed = self._flushed(state)
                self._commit(lambda _: flushed)
                self._tidy()

    def _tidy(self) -> None:
        """Keep the segments few: the newest that are not much smaller than the next become one, or all with the base once they are a quarter of it."""
        state = self._state()
        deltas = [s for s in state.segments if s.delta]
        if len(deltas) < COMPACT_AT:
            return
        if 4 * sum(s.rows for s in deltas) >= sum(s.rows for s in state.segments if not s.delta):
            self.compact()
            return
        tail = [deltas[-1]]
        for s in reversed(deltas[:-1]):
            if s.rows > 4 * sum(t.rows for t in tail):
                break
            tail.insert(0, s)
        if len(tail) > 1:
            changes = S.files_of(S.session(), tail[0], list(tail[0].files))
            for s in tail[1:]:
                changes = changes.unionByName(S.files_of(S.session(), s, list(s.files)))
            last = changes.groupBy("k").agg(F.max_by(F.struct("doc", "op", "seq"), F.col("seq")).alias("last")).select("k", "last.doc", "last.seq", "last.op")
            segment = self._write(state, last, delta=True)
            self._commit(lambda _: replace(state, segments=(*[s for s in state.segments if s not in tail], segment)))

    def compact(self) -> None:
        """Merge all segments and recent changes into one sorted segment."""
        with self._store._writing:
            state = self._state()
            if state.segments or state.recent:
                segment = self._write(state, S.snapshot(S.session(), state), delta=False)
                self._commit(lambda _: replace(state, segments=(segment,), recent={}))


class _Cursor:
    """Pairs of one version, which is held until the last of them."""

    def __init__(self, pairs: Iterator, version):
        self._pairs, self._version = pairs, version
        self._mutex = threading.Lock()

    def __iter__(self):
        return self

    def __next__(self):
        with self._mutex:  # threads may share a cursor
            try:
                return next(self._pairs)
            except StopIteration:
                self._version, self._pairs = None, iter(())
                raise


class _each:
    """A one-shot iterator over a cursor; decoding waits until a pair is asked for."""

    def __init__(self, cursor: Iterator, make):
        self._cursor, self._make = cursor, make

    def __iter__(self):
        return self

    def __next__(self):
        return self._make(*next(self._cursor))


__all__ = ["Collection", "Error"]
