"""A database directory: a log of commits, data segments, and one writer.

``LOCK`` keeps other processes out.  ``log/N.json`` holds commit N; it is
published by linking a finished file to that name, which fails if the name is
taken, so a commit is there as a whole or not at all.  Every so many commits the
whole state is written as ``log/N.state.json`` and older entries go.  ``data``
holds immutable Parquet segments written by Spark, sorted by key; the log knows
the rows and the smallest and largest key of each of their files.

The state is one immutable object.  Readers take the current one and keep it;
writers make another and swap it in.  Small writes stay in the state itself, as
a dict of encoded keys to Variant values (or None for a deletion); bulk writes
and flushes of that dict are segments.
"""

from __future__ import annotations

import atexit
import base64
import contextlib
import json
import os
import shutil
import tempfile
import threading
import time
import uuid
import weakref
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.types import VariantVal

from ..errors import Error

try:
    import fcntl
except ImportError:  # no advisory locks on this platform
    fcntl = None

#: Commits between two files that hold the whole state.
STATE_EVERY = 256
#: Entries that a collection keeps in the state before they go to a segment.
FLUSH_AT = 4096
#: Segments of changes that a collection keeps before they are merged.
COMPACT_AT = 8
#: Seconds for which the files behind a DataFrame stay after it was handed out.
LEASE = 24 * 3600.0


@dataclass(frozen=True)
class File:
    """One file of a segment; the keys of different files don't overlap."""

    name: str
    rows: int
    low: bytes
    high: bytes

    def may_hold(self, low: bytes | None, high: bytes | None) -> bool:
        return (high is None or self.low < high) and (low is None or self.high >= low)


@dataclass(frozen=True)
class Segment:
    path: str
    #: In key order.
    files: tuple[File, ...]
    #: Whether it may hold deletions, or keys of older segments.
    delta: bool

    @property
    def rows(self) -> int:
        return sum(f.rows for f in self.files)

    def within(self, low: bytes | None, high: bytes | None) -> list[File]:
        return [f for f in self.files if f.may_hold(low, high)]

    def may_hold(self, low: bytes | None, high: bytes | None) -> bool:
        return any(f.may_hold(low, high) for f in self.files)


@dataclass(frozen=True)
class State:
    """One collection in one version. Segments come oldest first; recent entries beat them all."""

    id: str
    segments: tuple[Segment, ...] = ()
    recent: dict[bytes, VariantVal | None] = field(default_factory=dict)


@dataclass(frozen=True, eq=False)
class Version:
    number: int = 0
    collections: dict[str, State] = field(default_factory=dict)


def _b64(raw: bytes) -> str:
    return base64.b64encode(raw).decode()


def _entry(k: bytes, v: VariantVal | None) -> list:
    return [_b64(k)] if v is None else [_b64(k), _b64(bytes(v.value)), _b64(bytes(v.metadata))]


def _from_entry(e: list) -> tuple[bytes, VariantVal | None]:
    raw = [base64.b64decode(x) for x in e]
    return raw[0], VariantVal(raw[1], raw[2]) if len(raw) == 3 else None


def _segment(s: Segment) -> list:
    return [s.path, s.delta, [[f.name, f.rows, _b64(f.low), _b64(f.high)] for f in s.files]]


def _from_segment(s: list) -> Segment:
    return Segment(s[0], tuple(File(n, rows, base64.b64decode(low), base64.b64decode(high)) for n, rows, low, high in s[2]), s[1])


def _changes(old: State | None, new: State | None) -> dict | None:
    """What a log entry says about one collection."""
    if new is None:
        return None
    if old is not None and old.id == new.id and old.segments == new.segments:
        return {"put": [_entry(k, v) for k, v in new.recent.items() if k not in old.recent or old.recent[k] is not v], "gone": [_b64(k) for k in old.recent.keys() - new.recent.keys()]}
    return {"id": new.id, "segments": [_segment(s) for s in new.segments], "recent": [_entry(k, v) for k, v in new.recent.items()]}


def _changed(old: State | None, said: dict | None) -> State | None:
    if said is None:
        return None
    if "put" in said:
        gone = set(map(base64.b64decode, said["gone"]))
        return replace(old, recent={k: v for k, v in old.recent.items() if k not in gone} | dict(map(_from_entry, said["put"])))
    return State(said["id"], tuple(map(_from_segment, said["segments"])), dict(map(_from_entry, said["recent"])))


class Store:
    def __init__(self, path: str | None, durable: bool = True):
        self.memory = path is None
        self.durable = durable
        self.root = Path(tempfile.mkdtemp(prefix="ordinate-") if path is None else path)
        self._writing = threading.RLock()
        self._pins: weakref.WeakSet[Version] = weakref.WeakSet()
        self._leases: dict[str, float] = {}
        self._lock = None
        self.data = str(self.root / "data")
        try:
            for d in ("log", "data"):
                (self.root / d).mkdir(parents=True, exist_ok=True)
            if self.memory:
                self._version: Version | None = Version()
                self._done = weakref.finalize(self, shutil.rmtree, str(self.root), True)
                atexit.register(self._done)
                self._share()
            else:
                self._acquire()
                self._version = self._load()
        except OSError as e:
            raise Error(f"can't open {path}: {e}") from e

    def _share(self) -> None:
        """A database in memory keeps its segments in the folder that a cluster shares, if it names one."""
        session = SparkSession.getActiveSession()
        if session is None:
            return
        sc = session.sparkContext
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared:
            self.data = f"{shared}/{self.root.name}"
            files, path = self._hadoop(self.data)
            files.mkdirs(path)
            files.deleteOnExit(path)
        elif not (sc.master == "local" or sc.master.startswith("local[")):
            raise Error("spark.checkpoint.dir is unset: a database in memory needs a folder that the driver and all executors share")

    @staticmethod
    def _hadoop(path: str):
        sc = SparkSession.getActiveSession().sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(sc._jsc.hadoopConfiguration()), at

    def _acquire(self) -> None:
        self._lock = open(self.root / "LOCK", "w")  # noqa: SIM115
        if fcntl is not None:
            try:
                fcntl.flock(self._lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as e:
                self._lock.close()
                raise Error(f"{self.root} is open in another process or handle") from e

    def _load(self) -> Version:
        names = sorted(p.name for p in (self.root / "log").iterdir() if p.name.endswith(".json"))
        whole = [n for n in names if n.endswith(".state.json")]
        version, start = Version(), 0
        try:
            if whole:
                said = json.loads((self.root / "log" / whole[-1]).read_text())
                version = Version(said["version"], {n: _changed(None, c) for n, c in said["collections"].items()})
                start = version.number
            for n in names:
                if not n.endswith(".state.json") and int(n[:20]) > start:
                    said = json.loads((self.root / "log" / n).read_text())
                    version = self._follow(version, said)
        except (ValueError, KeyError, TypeError) as e:
            raise Error(f"the log of {self.root} is corrupt: {e}") from e
        return version

    @staticmethod
    def _follow(version: Version, said: dict) -> Version:
        collections = dict(version.collections)
        for name, change in said["collections"].items():
            state = _changed(collections.get(name), change)
            if state is None:
                collections.pop(name, None)
            else:
                collections[name] = state
        return Version(said["version"], collections)

    # Reading

    def now(self) -> Version:
        version = self._version
        if version is None:
            raise Error("the database is closed")
        return version

    def pinned(self) -> Version:
        """The current version, whose segments stay as long as it is held."""
        version = self.now()
        self._pins.add(version)
        return version

    def lend(self, state: State) -> State:
        """The state, for a DataFrame that nobody tells us the end of: its segments stay for a while."""
        for s in state.segments:
            self._leases[s.path] = time.monotonic() + LEASE
        return state

    # Writing

    def commit(self, change: Callable[[dict[str, State]], dict[str, State] | None]) -> None:
        """Swap in what change makes of the collections; None or an exception leaves all as it was."""
        with self._writing:
            old = self.now()
            collections = change(dict(old.collections))
            if collections is None:
                return
            new = Version(old.number + 1, collections)
            if not self.memory:
                self._publish(old, new)
            self._version = new

    def _publish(self, old: Version, new: Version) -> None:
        touched = {n for n in old.collections.keys() | new.collections.keys() if old.collections.get(n) is not new.collections.get(n)}
        said = {"version": new.number, "collections": {n: _changes(old.collections.get(n), new.collections.get(n)) for n in sorted(touched)}}
        self._write(f"{new.number:020d}.json", said)
        if new.number % STATE_EVERY == 0:
            self._write(f"{new.number:020d}.state.json", {"version": new.number, "collections": {n: _changes(None, s) for n, s in new.collections.items()}})
            for p in (self.root / "log").iterdir():
                if p.name[:20] < f"{new.number:020d}":
                    p.unlink(missing_ok=True)

    def _write(self, name: str, said: dict) -> None:
        folder = self.root / "log"
        draft = folder / f".{uuid.uuid4()}"
        try:
            with draft.open("w") as f:
                json.dump(said, f)
                if self.durable:
                    f.flush()
                    os.fsync(f.fileno())
            os.link(draft, folder / name)
            if self.durable:
                self._sync(folder)
        except OSError as e:
            raise Error(f"can't write {name}: {e}") from e
        finally:
            draft.unlink(missing_ok=True)

    @staticmethod
    def _sync(folder: Path) -> None:
        with contextlib.suppress(OSError):
            fd = os.open(folder, os.O_RDONLY)
            try:
                os.fsync(fd)
            finally:
                os.close(fd)

    def new_id(self) -> str:
        return uuid.uuid4().hex

    def segment_path(self, state: State) -> str:
        return f"{self.data}/{state.id}/{uuid.uuid4().hex}"

    def settle(self, path: str) -> None:
        """Sync the files of a new segment, so that the commit that names it holds."""
        if self.durable and not self.memory:
            try:
                for p in Path(path).iterdir():
                    with p.open("rb") as f:
                        os.fsync(f.fileno())
            except OSError as e:
                raise Error(f"can't sync {path}: {e}") from e
            for folder in (Path(path), Path(path).parent, Path(path).parent.parent):
                self._sync(folder)

    def vacuum(self, force: bool = False) -> int:
        """Remove the segments that neither the current version nor a reader needs; tells how many.

        Those behind a DataFrame stay until its lease ends, or go at once with ``force``.
        """
        with self._writing:
            now = time.monotonic()
            leased = set() if force else {p for p, end in self._leases.items() if end > now}
            needed = leased | {s.path for v in [self.now(), *self._pins] for c in v.collections.values() for s in c.segments}
            gone = [p for p in self._segments() if p not in needed]
            for p in gone:
                self._remove(p)
                self._leases.pop(p, None)
            return len(gone)

    def _segments(self) -> list[str]:
        if not self.memory:
            return [str(p) for p in Path(self.data).glob("*/*")]
        files, path = self._hadoop(self.data)
        return [f"{self.data}/{c.getPath().getName()}/{s.getPath().getName()}" for c in files.listStatus(path) for s in files.listStatus(c.getPath())]

    def _remove(self, path: str) -> None:
        if not self.memory:
            shutil.rmtree(path, ignore_errors=True)
        elif SparkSession.getActiveSession() is not None:
            files, at = self._hadoop(path)
            files.delete(at, True)

    def close(self) -> None:
        with self._writing:
            self._version = None
            if self.memory:
                self._remove(self.data)
                self._done()
            if self._lock is not None:
                if not self.durable:
                    self._sync(self.root / "log")
                self._lock.close()
                self._lock = None
