"""One version of a collection as a DataFrame (k, doc)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.store import File, Segment, State

SCHEMA = "k binary, doc variant"
LOGGED = "k binary, doc variant, seq bigint, op int"


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def recent_rows(spark: SparkSession, state: State, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
    """What the state itself holds, as changes newer than any segment's."""
    rows = [(k, v, 1 << 62, R.PUT if v is not None else R.DELETE) for k, v in state.recent.items() if (low is None or k >= low) and (high is None or k < high)]
    return spark.createDataFrame(rows, LOGGED)


def snapshot(spark: SparkSession, state: State, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
    """The merged rows with low <= k < high.

    Files whose keys can't meet the bounds are not planned at all; the
    bounds are also pushed into the scan of the others.  A single clean segment
    is read as it is, with no merge and no shuffle; otherwise changes are few
    against the base, or merged by key.
    """
    limits = R.between(low, high)
    segments = [s for s in state.segments if s.may_hold(low, high)]
    base = next((s for s in state.segments if not s.delta), None)
    deltas = [s for s in segments if s.delta]

    def read(s: Segment) -> DataFrame:
        df = files_of(spark, s, s.within(low, high))
        return df if limits is None else df.where(limits)

    clean = read(base) if base is not None and base in segments else spark.createDataFrame([], SCHEMA)
    if not deltas and not state.recent:
        return clean
    changes = recent_rows(spark, state, low, high) if state.recent else None
    for s in deltas:
        changes = read(s) if changes is None else changes.unionByName(read(s))
    if base is None or base not in segments:
        return R.latest(changes).select("k", "doc")
    return R.apply(clean, changes).select("k", "doc")


def files_of(spark: SparkSession, s: Segment, files: list[File]) -> DataFrame:
    paths = [s.path] if len(files) == len(s.files) else [f"{s.path}/{f.name}" for f in files]
    return spark.read.schema(LOGGED if s.delta else SCHEMA).parquet(*paths)


def describe(df: DataFrame) -> tuple[File, ...]:
    """Rows, smallest and largest key of each file, in key order. Only the keys are read."""
    rows = df.select("k", F.col("_metadata.file_name").alias("f")).groupBy("f").agg(F.count("k").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).collect()
    return tuple(sorted((File(r["f"], r["n"], bytes(r["lo"]), bytes(r["hi"])) for r in rows), key=lambda f: f.low))


def edge(state: State, reverse: bool) -> Iterator[tuple[bytes, bytes]]:
    """Windows of keys from one end of the collection on, each of more files than the one before; all keys are in one of them."""
    ends = [(f.low, f.high) for s in state.segments for f in s.files] + [(k, k) for k, v in state.recent.items() if v is not None]
    ends.sort(key=(lambda e: e[1]) if reverse else (lambda e: e[0]), reverse=reverse)
    at, n, low, high = 0, 1, None, None
    while at < len(ends):
        part = ends[at : at + n]
        at, n = at + n, 2 * n
        if reverse:
            low, high = min(e[0] for e in part), high if high is not None else part[0][1] + b"\0"
        else:
            low, high = low if low is not None else part[0][0], max(e[1] for e in part) + b"\0"
        if low < high:
            yield low, high
            low, high = (None, low) if reverse else (high, None)


def ranked(spark: SparkSession, state: State, low: bytes | None, high: bytes | None, reverse: bool, name: str) -> DataFrame:
    """The merged rows with their place in key order, from 1.

    In a single clean segment a row's place follows from the rows of the files
    before its own and its place in the file, so nothing is sorted or moved.
    """
    base = state.segments[0] if len(state.segments) == 1 and not state.segments[0].delta and not state.recent else None
    files = base.within(low, high) if base is not None else []
    if not files or low is not None and high is not None and low >= high:
        return R.ranked(snapshot(spark, state, low, high), name, reverse)
    count = lambda f, outside: files_of(spark, base, [f]).where(outside).count()
    before = count(files[0], F.col("k") < F.lit(low)) if low is not None and files[0].low < low else 0
    after = count(files[-1], F.col("k") >= F.lit(high)) if high is not None and files[-1].high >= high else 0
    starts, total = {}, 0
    for f in files:
        starts[f.name], total = total, total + f.rows
    # One row for each file of the segment.
    places = spark.createDataFrame(list(starts.items()), "_f string, _start bigint")
    limits = R.between(low, high)
    rows = files_of(spark, base, files).select("k", "doc", F.col("_metadata.file_name").alias("_f"), F.col("_metadata.row_index").alias("_at"))
    rows = (rows if limits is None else rows.where(limits)).join(F.broadcast(places), "_f")
    place = F.col("_start") + F.col("_at") + F.lit(1 - before)
    return rows.select("k", "doc", (F.lit(total - before - after + 1) - place if reverse else place).alias(name))
