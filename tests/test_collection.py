"""Collections as mappings and in bulk, against plain dicts and sorted lists."""

import dataclasses
import os
import threading
from pathlib import Path

import pytest
from hypothesis import HealthCheck, settings
from hypothesis import strategies as st
from hypothesis.stateful import RuleBasedStateMachine, invariant, rule, run_state_machine_as_test
from pyspark.sql import functions as F

import ordinate
from ordinate import collection as C
from ordinate.functions import documents as D
from ordinate.functions import keys as K
from ordinate.plans import snapshot as P
from ordinate.sources import store as S

part = st.one_of(st.integers(-3, 3), st.text("pq\0", max_size=2), st.binary(max_size=1))
key = st.one_of(part, st.tuples(part, part))
document = st.dictionaries(st.sampled_from(["title", "year", "tags"]), st.one_of(st.none(), st.integers(), st.lists(st.text(max_size=2), max_size=2)).filter(lambda v: not isinstance(v, int) or abs(v) < 2**63), max_size=3)


class Library(RuleBasedStateMachine):
    """A collection and a dict that do the same."""

    def __init__(self):
        super().__init__()
        self.db = ordinate.open()
        self.shelf, self.books = self.db["shelf"], {}

    def teardown(self):
        self.db.close()

    @rule(k=key, v=document)
    def put(self, k, v):
        self.shelf[k] = self.books[k] = v

    @rule(more=st.dictionaries(key, document, max_size=4))
    def put_several(self, more):
        self.shelf.update(more)
        self.books.update(more)

    @rule(k=key)
    def take(self, k):
        gone = object()
        want = self.books.pop(k, gone)
        if want is gone:
            with pytest.raises(KeyError):
                self.shelf.pop(k)
            assert self.shelf.pop(k, "none") == "none"
        else:
            assert self.shelf.pop(k) == want

    @rule(k=key, v=document)
    def put_unless_there(self, k, v):
        assert self.shelf.setdefault(k, v) == self.books.setdefault(k, v)

    @rule()
    def take_smallest(self):
        if self.books:
            k = min(self.books, key=K.encode)
            assert self.shelf.popitem() == (k, self.books.pop(k))

    @rule(k=key)
    def look(self, k):
        assert self.shelf.get(k) == self.books.get(k) and (k in self.shelf) == (k in self.books)

    @invariant()
    def same(self):
        want = sorted(self.books.items(), key=lambda e: K.encode(e[0]))
        assert list(self.shelf.items()) == want and len(self.shelf) == len(want)
        assert self.shelf == self.books and list(reversed(self.shelf)) == [k for k, _ in reversed(want)]
        assert self.shelf.first() == (want[0] if want else None) and self.shelf.last() == (want[-1] if want else None)


def test_any_steps_agree_with_a_dict(spark):
    run_state_machine_as_test(Library, settings=settings(max_examples=25, stateful_step_count=15, deadline=None, suppress_health_check=list(HealthCheck)))


@pytest.fixture
def rivers(db):
    c = db["rivers"]
    c.update({("asia", "ob"): {"km": 3650}, ("asia", "lena"): {"km": 4294}, ("europe", "po"): {"km": 652}, "nile": {"km": 6650}, "niger": {"km": 4180}, b"\xff": {}, 12: {"note": "number"}})
    return c


def test_reads_in_order(rivers):
    keys = lambda pairs: [k for k, _ in pairs]
    assert list(rivers) == [12, ("asia", "lena"), ("asia", "ob"), ("europe", "po"), "niger", "nile", b"\xff"]
    assert keys(rivers.range("asia", "europf")) == [("asia", "lena"), ("asia", "ob"), ("europe", "po")]
    assert keys(rivers.range(("asia", "m"), ("europe", "po"))) == [("asia", "ob")] and keys(rivers.range("nile", "asia")) == []
    assert keys(rivers.prefix("ni")) == ["niger", "nile"] and keys(rivers.prefix(("asia",))) == [("asia", "lena"), ("asia", "ob")]
    assert keys(rivers.prefix(b"")) == [b"\xff"] and len(keys(rivers.prefix(()))) == 7 and keys(rivers.range(None, 13)) == [12]
    assert rivers.first() == (12, {"note": "number"}) and rivers.last() == (b"\xff", {})
    for wrong in (lambda: rivers.range("nile", b"x"), lambda: rivers.prefix(12), lambda: rivers[{}], lambda: rivers.get(2.0)):
        with pytest.raises(TypeError):
            wrong()


def test_one_unfit_entry_stops_a_batch(db):
    rows = [("fine", {"a": 1}), ("bad", ["no", "dict"])]
    with pytest.raises(TypeError):
        db["batch"].update(rows)
    with pytest.raises(ValueError):
        db["batch"].update({"too": {}, 1 << 70: {}})
    assert "batch" not in db
    db["batch"].update(())
    assert "batch" not in db and len(db["batch"]) == 0
    with pytest.raises(TypeError):
        hash(db["batch"])


def test_update_takes_items(db):
    class Source(dict):
        def __getitem__(self, k):
            raise AssertionError("one lookup for each key")

    db["copy"].update(Source({"x": {"n": 1}, ("y", 2): {"n": 2}}), z={"n": 3})
    db["again"].update(db["copy"])
    assert db["again"] == db["copy"] and dict(db["again"].items()) == {"x": {"n": 1}, ("y", 2): {"n": 2}, "z": {"n": 3}}
    db["again"]["x"] = {"n": 9}
    assert db["again"] != db["copy"] and db["copy"] != {"x": {"n": 1}} and db["copy"] != 5


def test_scans_hold_still(rivers):
    names, pairs, back = iter(rivers), rivers.prefix("ni"), reversed(rivers)
    assert next(names) == 12
    rivers.clear()
    rivers["amur"] = {}
    assert len(list(names)) == 6 and [k for k, _ in pairs] == ["niger", "nile"] and len(list(back)) == 7 and list(rivers) == ["amur"]
    assert next(names, "over") == "over"


def test_threads_share_a_cursor(db):
    db["n"].update({i: {} for i in range(600)})
    cursor, seen = iter(db["n"]), []

    def drain():
        for k in cursor:
            seen.append(k)

    workers = [threading.Thread(target=drain) for _ in range(6)]
    for w in workers:
        w.start()
    for w in workers:
        w.join(60)
    assert sorted(seen) == list(range(600))


def test_writers_take_turns(db):
    def add(i):
        for j in range(20):
            with_default = db["shared"].setdefault(("count", j), {"by": i})
            assert with_default["by"] in range(4)
            db["shared"][("own", i, j)] = {}

    workers = [threading.Thread(target=add, args=(i,)) for i in range(4)]
    for w in workers:
        w.start()
    for w in workers:
        w.join(60)
    assert len(db["shared"]) == 100 and sum(1 for _ in db["shared"].prefix(("own",))) == 80


def test_a_database_maps_names(db):
    assert len(db) == 0 and db.get("Ω") == {} and "Ω" not in db
    for name in ("Ω", "a/b", "..", " "):
        db[name]["k"] = {"of": name}
    assert list(db) == sorted(["Ω", "a/b", "..", " "]) == [r["name"] for r in db.names_df().orderBy("name").collect()]
    del db[".."]
    with pytest.raises(KeyError):
        del db[".."]
    assert len(db) == 3 and None not in db
    for wrong, error in ((lambda: db[""], ValueError), (lambda: db[b"x"], TypeError), (lambda: db.collection(None), TypeError)):
        with pytest.raises(error):
            wrong()
    db[" "].clear()
    assert " " in db and len(db[" "]) == 0


def test_a_directory_remembers(spark, tmp_path):
    at = tmp_path / "library"
    with ordinate.open(at) as db:
        db["loans"].update({("2024", i): {"days": 7 * i} for i in range(4)})
        db["loans"].pop(("2024", 2))
        db["draft"]["x"] = {}
        del db["draft"]
        with pytest.raises(ordinate.Error):
            ordinate.open(at)
    for use in (lambda: db["loans"], lambda: list(db), lambda: "loans" in db, lambda: len(db), lambda: db.vacuum()):
        with pytest.raises(ordinate.Error):
            use()
    db.close()
    with ordinate.open(os.fspath(at), durable=False) as db:
        assert list(db) == ["loans"] and [v["days"] for v in db["loans"].values()] == [0, 7, 21]
    with pytest.raises(ordinate.Error):
        (tmp_path / "plain").write_text("a file")
        ordinate.open(tmp_path / "plain")


def test_the_log_stays_short(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "STATE_EVERY", 8)
    with ordinate.open(tmp_path / "d") as db:
        for i in range(30):
            db["c"][i % 5] = {"round": i}
        assert len(list((tmp_path / "d" / "log").glob("*.json"))) <= 9
    with ordinate.open(tmp_path / "d") as db:
        assert dict(db["c"].items()) == {i: {"round": 25 + i} for i in range(5)}
    newest = max((tmp_path / "d" / "log").glob("*.json"))
    newest.write_text("[]")
    with pytest.raises(ordinate.Error):
        ordinate.open(tmp_path / "d")


def test_a_deletion_is_a_short_entry(spark, tmp_path):
    with ordinate.open(tmp_path / "d") as db:
        db["c"].update({i: {"text": "x" * 100} for i in range(500)})
        del db["c"][250]
        newest = max((tmp_path / "d" / "log").glob("*.json"))
        assert newest.stat().st_size < 300
    with ordinate.open(tmp_path / "d") as db:
        assert len(db["c"]) == 499 and 250 not in db["c"]


def test_memory_leaves_nothing(spark):
    db = ordinate.open()
    db["c"].put_df(numbers(spark, 10))
    data, root = Path(db._store.data.removeprefix("file:")), db._store.root
    assert data.exists() and root.exists()
    db.close()
    assert not data.exists() and not root.exists()


@dataclasses.dataclass
class Book:
    title: str
    year: int


def test_models_bind_to_handles(db):
    books = db.collection("books", Book)
    books["a"] = Book("Ulysses", 1922)
    books.update({"b": {"title": "Emma", "year": 1815}, "c": Book("Dune", 1965)})
    assert books["b"] == Book("Emma", 1815) and db["books"]["a"] == {"title": "Ulysses", "year": 1922}
    assert books.last() == ("c", Book("Dune", 1965)) and [b.year for b in books.values()] == [1922, 1815, 1965]
    assert sorted(tuple(r) for r in books.typed_df("b").select("title", "year").collect()) == [("Dune", 1965), ("Emma", 1815)]
    with pytest.raises(TypeError):
        db["books"].typed_df()
    with pytest.raises(TypeError):
        db.collection("books", float)["a"]


# In bulk


def numbers(spark, n, value="id", parts=1):
    """Documents {v: value} under the keys 0 .. n - 1."""
    return spark.range(0, n, 1, parts).select(K.int_part(F.col("id")).alias("k"), F.to_variant_object(F.struct(F.expr(value).cast("bigint").alias("v"))).alias("doc"))


def content(rows):
    return {K.decode(bytes(r["k"])): D.from_variant(r["doc"])["v"] for r in rows.collect()}


def test_bulk_and_single_writes_mix(spark, db, monkeypatch):
    monkeypatch.setattr(C, "FLUSH_AT", 10)
    c = db["n"]
    c.put_df(numbers(spark, 60))
    want = {i: i for i in range(60)}
    for i in range(50, 75):
        c[i] = {"v": -i}
        want[i] = -i
    c.delete_df(numbers(spark, 200).where("cast(k as string) is null or true").select("k").limit(5))
    gone = set(want) - set(content(c.df()))
    assert len(gone) == 5
    want = {k: v for k, v in want.items() if k not in gone}
    del c[74]
    del want[74]
    assert content(c.df()) == want and len(c) == len(want) and c == {k: {"v": v} for k, v in want.items()}
    assert content(c.df(20, 30)) == {k: v for k, v in want.items() if 20 <= k < 30} and content(c.get_df(55)) == {55: -55}
    assert c.first()[0] == min(want) and c.last()[0] == max(want) and c.popitem()[0] == min(want)
    c.compact()
    assert len(c) == len(want) - 1 and list(reversed(c)) == sorted(want)[:0:-1]


def test_a_data_frame_outlives_compaction_and_vacuum(spark, db):
    c = db["n"]
    c.put_df(numbers(spark, 100))
    c.put_df(numbers(spark, 50, "id * 2"))
    before, derived = c.df(), c.df(10, 90).where("true").select("k")
    part = c.prefix_df(())
    c.delete_df(numbers(spark, 90).select("k"))
    c.compact()
    assert db.vacuum() == 1  # the deletions, which no DataFrame has seen
    assert content(before) == {i: 2 * i if i < 50 else i for i in range(100)} and derived.count() == 80 and part.count() == 100
    assert len(c) == 10 and db.vacuum(force=True) == 2 and len(c) == 10


def test_an_open_scan_outlives_vacuum(spark, db):
    c = db["n"]
    c.put_df(numbers(spark, 40))
    scan = c.items()
    c.clear()
    db.vacuum(force=True)
    assert len(list(scan)) == 40 and len(c) == 0


def test_ends_are_seeks(spark, db, monkeypatch):
    c = db["n"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        c.put_df(numbers(spark, 400, parts=4))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = c._state().segments[0].files
    assert len(files) == 4 and sum(f.rows for f in files) == 400 and all(a.high < b.low for a, b in zip(files, files[1:], strict=False))
    assert len(c.end_df().inputFiles()) == 1 and len(c.end_df(reverse=True).inputFiles()) == 1 and len(c.get_df(7).inputFiles()) == 1
    plan = c.end_df()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "GreaterThanOrEqual(k" in plan
    # A deleted beginning: the windows widen until something is there.
    c.delete_df(numbers(spark, 250).select("k"))
    seen, real = [], P.snapshot
    monkeypatch.setattr(C.S, "snapshot", lambda *a: (seen.append(a[2:]), real(*a))[1])
    assert c.first() == (250, {"v": 250}) and len(seen) <= 4
    assert c.last() == (399, {"v": 399}) and c.popitem()[0] == 250


def test_edges_cover_everything():
    files = tuple(S.File(str(i), 1, bytes([i]), bytes([i, 9])) for i in range(0, 20, 2))
    state = S.State("x", (S.Segment("base", files, False), S.Segment("more", (S.File("d", 1, b"\x03", b"\x0b"),), True)), {b"\x01": None, b"\x1f": "live"})
    for reverse in (False, True):
        windows = list(P.edge(state, reverse))
        ordered = windows[::-1] if reverse else windows
        assert ordered[0][0] == b"\0" and ordered[-1][1] > b"\x1f"
        assert all(a[1] == b[0] or a[1] < b[0] for a, b in zip(ordered, ordered[1:], strict=False))
        for k in [b"\x03", b"\x0b", b"\x1f"] + [x for f in files for x in (f.low, f.high)]:
            assert sum(low <= k < high for low, high in windows) == 1


def test_places_without_sorting(spark, db):
    c = db["n"]
    c.put_df(numbers(spark, 300, parts=3))
    ranks = lambda df: {K.decode(bytes(r["k"])): r["rank"] for r in df.collect()}
    assert "Exchange range" not in c.ranked_df()._jdf.queryExecution().executedPlan().toString()
    for _ in range(2):  # first from the files, then from merged rows
        keys = list(c)
        assert ranks(c.ranked_df()) == {k: i + 1 for i, k in enumerate(keys)}
        assert ranks(c.ranked_df(reverse=True)) == {k: len(keys) - i for i, k in enumerate(keys)}
        inside = [k for k in keys if 37 <= k < 222]
        assert ranks(c.ranked_df(37, 222)) == {k: i + 1 for i, k in enumerate(inside)}
        assert ranks(c.ranked_df(37, 222, reverse=True)) == {k: len(inside) - i for i, k in enumerate(inside)}
        assert ranks(c.ranked_df(222, 37)) == {} and ranks(c.ranked_df(900)) == {} and len(ranks(c.ranked_df(prefix=()))) == len(keys)
        c.pop(100, None)


def test_segments_stay_few(spark, db, monkeypatch):
    monkeypatch.setattr(C, "COMPACT_AT", 3)
    c, want = db["n"], {i: i for i in range(500)}
    c.put_df(numbers(spark, 500))
    for round in range(9):
        c.put_df(numbers(spark, 3 + round, f"id + {1000 * round}"))
        want |= {i: i + 1000 * round for i in range(3 + round)}
        c.delete_df(numbers(spark, 1).select("k"))
        want.pop(0, None)
    state = c._state()
    assert len(state.segments) <= 5 and not state.segments[0].delta and content(c.df()) == want
    for round in range(3):
        c.put_df(numbers(spark, 400, f"id * {round}"))
    want |= {i: 2 * i for i in range(400)}
    assert len(c._state().segments) <= 3 and content(c.df()) == want


def test_counts_are_kept(spark, db, monkeypatch):
    c = db["n"]
    c.put_df(numbers(spark, 30))
    assert len(c) == 30
    c.put_df(numbers(spark, 40))
    assert len(c) == 40
    monkeypatch.setattr(C.S, "snapshot", None)
    assert len(c) == 40


def test_the_largest_mark_wins(spark, db):
    rows = numbers(spark, 5).crossJoin(spark.createDataFrame([(3, 30), (9, 90), (4, 40)], "mark int, x int")).select("k", F.to_variant_object(F.struct(F.col("x").alias("v"))).alias("doc"), "mark")
    db["n"].put_df(rows, seq="mark")
    assert content(db["n"].df()) == dict.fromkeys(range(5), 90)


def test_bulk_data_is_synced_before_its_commit(spark, tmp_path, monkeypatch):
    synced, real = [], os.fsync
    monkeypatch.setattr(S.os, "fsync", lambda fd: (synced.append(os.readlink(f"/proc/self/fd/{fd}")), real(fd))[1])
    with ordinate.open(tmp_path / "safe") as db:
        db["n"].put_df(numbers(spark, 10))
        data = [i for i, p in enumerate(synced) if p.endswith(".parquet")]
        log = [i for i, p in enumerate(synced) if "/log/" in p]
        assert data and log and max(data) < min(log)
    synced.clear()
    with ordinate.open(tmp_path / "fast", durable=False) as db:
        db["n"].put_df(numbers(spark, 10))
        assert not [p for p in synced if p.endswith(".parquet")]
    with ordinate.open(tmp_path / "safe") as db:
        db["n"][3] = {"v": 33}
        assert content(db["n"].df()) == {i: 33 if i == 3 else i for i in range(10)}


def test_a_stream_is_put_batch_by_batch(spark, db, tmp_path):
    from ordinate.streaming import upserts

    for day, n in (("mon", 8), ("tue", 5)):
        numbers(spark, n).select(F.hex("k").alias("id"), F.lit(day).alias("day")).coalesce(1).write.json(str(tmp_path / "in" / day))
    rows = spark.readStream.schema("id string, day string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    rows = rows.select(F.unhex("id").alias("k"), F.to_variant_object(F.struct("day")).alias("doc"), F.when(F.col("day") == "mon", 1).otherwise(2).alias("seq"))
    upserts(rows, db["days"], "seq").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    assert len(db["days"]) == 8 and {v["day"] for v in db["days"].values()} <= {"mon", "tue"}
