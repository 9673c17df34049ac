"""Nearest neighbours by shifted space-filling curves.

Several Hilbert orderings are laid through the vectors, each in its own seeded
rotation and shift.  Spark range-partitions every ordering; each query is scored
exactly against the window of keys around it, and the windows of all orderings
merge into its best ``k`` by true inner product.

On data with structure the windows alone find nearly all neighbours.  Vectors
without any (say independent, isotropic ones in 64 dimensions, where every
projection to a few axes forgets most of an inner product) defeat every curve,
so an exact check follows (``exact=True``): the score a query has in hand is a
floor; blocks of the first ordering whose ball bound (centre and radius) beats
the floor are scored as well, the others are skipped.  It takes splits of
``split_points`` points of that ordering against splits of ``split_queries``
queries, each such pair in a task of its own; nothing passes the driver.

Equal vectors are one point with its k + 1 smallest ids, as no other id of it
can ever be among the nearest k; so a vector that makes up a third of all rows
is one point.  Ties go to the smaller id.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, neither as queries nor as candidates; vectors of
different lengths never meet; a repeated id is an entry of its own, and a query
row leaves out the candidates with its id; fewer than k candidates give fewer
rows; an empty table gives no rows; extra columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, map_arrow, ship


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert curve positions of integer points (rows of cells, each below 2 ** bits), all rows at once."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        t ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


def curve(vectors: np.ndarray, number: int, axes: int, bits: int, seed: int) -> np.ndarray:
    """The positions of vectors on curve ``number``: its own rotation, its own shift, cells along each axis."""
    dims = vectors.shape[1]
    rng = np.random.default_rng([seed, number])
    turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0][:, : min(axes, dims)]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    # Coordinates of random directions have a deviation of 1 / sqrt(dims); a third of the grid is left for the shift.
    spread = unit @ turn * np.sqrt(dims) / 8 + 0.5
    moved = (np.clip(spread, 0, 1) * 2 + rng.random(turn.shape[1])) / 3
    return hilbert_keys(np.minimum((moved * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits) >> np.uint64(max(0, turn.shape[1] * bits - 63))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of every score at least as large as its row's k-th largest (ties included)."""
    if scores.shape[1] > k:
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None]
        return np.nonzero(scores >= floor)
    return np.nonzero(np.ones(scores.shape, bool))


def _pairs(query, point, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(point, pa.int64()), pa.array(score, pa.float64())], names=["query", "point", "score"])


_PAIR = "query bigint, point bigint, score double"


def curve_windows(points: DataFrame, dims: int, *, k: int, curves: int, window: int, axes: int, bits: int, seed: int) -> DataFrame:
    """Pairs (query, point, score) from the windows of all orderings. points: point, v, is_query."""
    names = ["curve", "key", "point", "v", "is_query"]

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("v"), dims)
            for c in range(curves):
                key = curve(m, c, axes, bits, seed).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), c, np.int32)), pa.array(key), batch.column("point"), batch.column("v"), batch.column("is_query")], names=names)

    keyed = map_arrow(points, order, "curve int, key bigint, point bigint, v array<float>, is_query boolean")
    # Key as a tie-break, so that one place on a curve can span partitions.
    laid = keyed.repartitionByRange(F.col("curve"), F.col("key"), F.col("point")).sortWithinPartitions("curve", "key", "point")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([batch])])
            yield from score(table.combine_chunks(), 0 if tail is None else tail.num_rows)
            tail = table.slice(max(0, table.num_rows - 2 * window))

    def score(table: pa.Table, old: int) -> Iterator[pa.RecordBatch]:
        """Rows before ``old`` were scored with what stood left of them; the others, and their right side, come now."""
        col = {n: table.column(n).combine_chunks() for n in names}
        point, which, asks = col["point"].to_numpy(), col["curve"].to_numpy(), col["is_query"].to_numpy(zero_copy_only=False)
        m, step = _matrix(col["v"], dims), 2 * window
        for c in np.unique(which):
            lo, hi = np.searchsorted(which, [c, c + 1])
            for at in range(lo, hi, step):
                rows = np.nonzero(asks[at : min(at + step, hi)])[0] + at
                left, right = max(lo, at - window), min(hi, at + step + window)
                if len(rows) and right > old:
                    r, s = _best(m[rows] @ m[left:right].T, k + 1)
                    yield _pairs(point[rows[r]], point[left + s], (m[rows[r]] * m[left + s]).sum(1))

    return map_arrow(laid, near, _PAIR)


def exact_pairs(points: DataFrame, asked: DataFrame, dims: int, *, k: int, block: int = 512) -> DataFrame:
    """Pairs that reach their query's floor; blocks of points that can't reach any floor are skipped.

    points: split, place (on a curve), point, v; asked: split, query, v, floor.
    Each group holds one split of the points and one of the queries.
    """

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {n: [] for n in ("query", "point", "score")}
        if left.num_rows and right.num_rows:
            left = left.sort_by("place").combine_chunks()
            right = right.combine_chunks()
            q, ids, floor = _matrix(right.column("v").chunk(0), dims), right.column("query").to_numpy(), right.column("floor").fill_null(-np.inf).to_numpy().copy()
            floor -= 1e-12 * np.abs(np.where(np.isfinite(floor), floor, 0)) + 1e-300
            length = np.linalg.norm(q, axis=1)
            everything, point = _matrix(left.column("v").chunk(0), dims), left.column("point").to_numpy()
            for at in range(0, len(point), block):
                m = everything[at : at + block]
                centre = m.mean(0)
                radius = np.sqrt(((m - centre) ** 2).sum(1).max())
                hope = np.nonzero(q @ centre + length * radius * (1 + 1e-9) >= floor)[0]
                for part in np.array_split(hope, max(1, len(hope) // 2048)):
                    r, c = np.nonzero(q[part] @ m.T >= floor[part, None])
                    for n, x in zip(out, (ids[part[r]], point[at + c], (q[part[r]] * m[c]).sum(1)), strict=True):
                        out[n].append(x)
        return pa.table({n: pa.array(np.concatenate(x) if x else np.empty(0), pa.float64() if n == "score" else pa.int64()) for n, x in out.items()})

    ship(points.sparkSession)
    return points.groupBy("split", "part").cogroup(asked.groupBy("split", "part")).applyInArrow(scan, _PAIR)


def _top(pairs: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """For each query point its k + 1 best ids: query, score, vec_id."""
    distinct = pairs.groupBy("query", "point").agg(F.max("score").alias("score"))
    # Any k + 1 points hold at least as many ids.
    few = distinct.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "point"))).where(F.col("r") <= k + 1)
    opened = few.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
    return opened.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).drop("r")


def search(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", is_query: Column, k: int = 20, curves: int = 8, window: int = 128, axes: int = 7, bits: int = 9, seed: int = 7, exact: bool = True, split_points: int = 1 << 17, split_queries: int = 1 << 16) -> DataFrame:
    """query_id, rank, vec_id and score of the k largest inner products of every query row."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.where(usable(F.col("v")) & F.col("id").isNotNull()).withColumn("h", F.xxhash64("v"))
    by_vector = Window.partitionBy("h", "v").orderBy("id")
    least = rows.select("h", "v", "id").withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1)
    points = least.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asks = rows.where("is_query").groupBy("h", "v", "id").agg(F.count(F.lit(1)).alias("n"))
    asked = asks.select("h", "v").distinct().withColumn("is_query", F.lit(True))
    points = checkpointed(points.join(asked, ["h", "v"], "left").select("h", F.col("v"), "ids", F.col("ids")[0].alias("point"), F.coalesce("is_query", F.lit(False)).alias("is_query")))
    results = None
    for length in sorted(r["n"] for r in points.groupBy(F.size("v").alias("n")).count().collect()):
        mine = points.where(F.size("v") == length)
        pairs = curve_windows(mine.select("point", "v", "is_query"), length, k=k, curves=curves, window=window, axes=axes, bits=bits, seed=seed)
        top = checkpointed(_top(pairs, mine, k))
        if exact:
            top = _complete(mine, top, length, k, axes, bits, seed, split_points, split_queries)
        results = top if results is None else results.unionByName(top)
    if results is None:
        results = vectors.sparkSession.createDataFrame([], "query bigint, score double, vec_id bigint")
    queries = asks.join(points.select("h", "v", "point"), ["h", "v"]).select(F.col("id").alias("query_id"), F.col("point").alias("query"), "n")
    found = queries.join(results, "query").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_n")).drop("_n")


def _complete(points: DataFrame, top: DataFrame, dims: int, k: int, axes: int, bits: int, seed: int, split_points: int, split_queries: int) -> DataFrame:
    """top, with whatever the windows missed: splits of the first ordering against splits of the queries."""

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = curve(_matrix(batch.column("v"), dims), 0, axes, bits, seed).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("point"), batch.column("v")], names=["place", "point", "v"])

    last = top.groupBy("query").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("floor"))
    floors = points.where("is_query").select(F.col("point").alias("query"), "v").join(last, "query", "left")
    sizes = points.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q")).first()
    splits, parts = max(8, -(-sizes["n"] // split_points)), max(1, -(-sizes["q"] // split_queries))
    laid = map_arrow(points.select("point", "v"), order, "place bigint, point bigint, v array<float>")
    laid = laid.repartitionByRange(splits, F.col("place"), F.col("point")).withColumn("split", F.spark_partition_id())
    laid = checkpointed(laid)  # the bounds of the splits are drawn anew whenever they are planned
    splits = laid.agg(F.coalesce(F.max("split"), F.lit(0)).alias("s")).first()["s"] + 1
    laid = laid.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = floors.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int")).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    return checkpointed(_top(exact_pairs(laid, asked, dims, k=k), points, k))
