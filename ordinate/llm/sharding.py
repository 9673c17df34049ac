"""Sharding by extendible hashing.

Rows hash to 60 bits.  The directory starts at one bucket; only a bucket whose
bytes exceed the limit splits, on the next bit of the hash, until every shard
fits.  A shard is named by its prefix bits.

Bytes are first summed into cells at a depth a few bits below the expected one,
cells roll up to the sums of every prefix above them, and the directory is the
shallowest prefixes that fit.  Cells that are still too large at that depth,
and only those, are split again on further bits in the next round.

The hash covers all values of a row, or its bytes and the columns named in
``by``; whole rows are dealt out either way.  Rows alike in these would share
every bit, so it also covers the number of the copy: rows are counted by their
content first, then numbered, or numbered in the order of a hash of all values
among those alike in ``by``.  A shard
exceeds the limit only if a single row does; such a shard is reported as
``oversize``.

``write_shards`` writes the rows, a folder for each shard.  Tasks take even ranges
of (shard, hash of the row), so a large shard is several files and no task
gathers one.

Scale: one narrow pass over (hash, bytes), rollups of a few cells per shard,
and one join of the rows with the cells on the hash prefix, which is even by
construction.

Edge cases: nulls hash like a value of their own; null or empty
payloads count 0 bytes; an empty table gives no shard; extra columns pass
through; input columns named like an output column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, comparable, md5_int, numbered, renamed, without

BITS = 60
LIMIT = 64 << 20
#: Cells, and keys of several rows, are handed to every executor up to so many, else joined.
BROADCAST_ROWS = 100_000


def row_hash(columns: list[Column], copy: Column) -> Column:
    """60 hash bits of a row's values and its number among equal rows."""
    said = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null")) for c in columns]
    return md5_int(F.concat_ws("|", *said, copy.cast("string")), BITS // 4)


def prefix(h: Column, depth: Column | int) -> Column:
    depth = depth if isinstance(depth, Column) else F.lit(depth)
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def directory(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """From (h, bytes): (leaf depth, table of leaf, depth, shard, shard_bytes, shard_rows) for each leaf depth that was needed."""
    out = []
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    shallow, depth = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 4)
    while True:
        cells = checkpointed(rows.groupBy(prefix(F.col("h"), depth).alias("leaf")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")))
        ladder = cells.select("leaf", "bytes", "n", F.explode(F.sequence(F.lit(shallow), F.lit(depth))).alias("depth"))
        ladder = ladder.withColumn("code", F.call_function("shiftright", F.col("leaf"), (F.lit(depth) - F.col("depth")).cast("int")))
        sums = ladder.groupBy("depth", "code").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        last = F.col("depth") == BITS
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | last)
        reached = ladder.select("leaf", "depth", "code").join(fits, ["depth", "code"])
        chosen = reached.groupBy("leaf").agg(F.min(F.struct("depth", "code", "shard_bytes", "shard_rows")).alias("s"))
        bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("code"), F.col("depth"), F.lit("0")))
        chosen = checkpointed(chosen.select("leaf", "s.*").withColumn("shard", bits))
        out.append((depth, chosen))
        rest = cells.join(chosen, "leaf", "left_anti")
        if depth == BITS or rest.isEmpty():
            return out
        rows = rows.withColumn("leaf", prefix(F.col("h"), depth)).join(rest.select("leaf"), "leaf", "left_semi").drop("leaf")
        shallow, depth = depth + 1, min(BITS, depth + 6)


def _copies(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """df with the number of each row among those alike in keys; only rows that have others alike move."""
    marks = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    alike = checkpointed(df.select(*marks).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    several = alike.count()
    if not several:
        return df.withColumn("_copy", F.lit(1))
    alike = F.broadcast(alike) if several <= BROADCAST_ROWS else alike
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*comparable(df, names))))
    return df.join(alike, same, "left_anti").withColumn("_copy", F.lit(1)).unionByName(df.join(alike, same, "left_semi").withColumn("_copy", place))


RESULT = ["row_bytes", "shard", "shard_depth", "shard_bytes", "shard_rows", "oversize"]


def shard(df: DataFrame, size: Column, *, limit: int = LIMIT, by: list[str] | None = None) -> DataFrame:
    """df with row_bytes (``size``, an expression over df), shard (its prefix bits, "" for the only one), shard_depth, shard_bytes, shard_rows and oversize."""
    kept = without(df, RESULT).columns
    df, of = renamed(df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(size, F.lit(0)).cast("bigint").alias("")))
    *plain, last = df.columns
    df = df.withColumnRenamed(last, "_bytes")
    names = [f"`{c}`" for c in plain]
    if by is None:
        marks = comparable(df, plain)
        if any(str(m) != str(F.col(n)) for m, n in zip(marks, names, strict=True)):
            # Columns that can't be grouped by travel beside what stands for them.
            held = df.select(F.struct(*names).alias("_row"), "_bytes", *[m.alias(f"_m{i}") for i, m in enumerate(marks)])
            marks = [f"_m{i}" for i in range(len(plain))]
            counted = held.groupBy(*marks, "_bytes").agg(F.count(F.lit(1)).alias("_n"), F.first("_row").alias("_row"))
            rows = numbered(counted, "_n", "_copy").withColumn("_h", row_hash([F.col(c) for c in marks], F.col("_copy")))
            rows = rows.select(*[F.col("_row").getField(c).alias(c) for c in plain], "_bytes", "_copy", "_h")
        else:
            counted = df.groupBy(*names, "_bytes").agg(F.count(F.lit(1)).alias("_n"))
            rows = numbered(counted, "_n", "_copy").withColumn("_h", row_hash([F.col(c) for c in names], F.col("_copy")))
    else:
        keys = [*map(of, by), "_bytes"]
        rows = _copies(df, keys, plain).withColumn("_h", row_hash([F.col(c) for c in keys], F.col("_copy")))
    tables = directory(checkpointed(rows.select(F.col("_h").alias("h"), F.col("_bytes").alias("bytes"))), limit)
    out = None
    for depth, cells in tables:
        cells = cells.select(F.col("leaf").alias("_leaf"), "shard", F.col("depth").alias("shard_depth"), "shard_bytes", "shard_rows")
        # A few cells for each shard: handed out, so that the rows stay where they are.
        cells = F.broadcast(cells) if cells.count() <= BROADCAST_ROWS else cells
        hit = rows.withColumn("_leaf", prefix(F.col("_h"), depth)).join(cells, "_leaf")
        out = hit if out is None else out.unionByName(hit)
    out = out.select(*names, F.col("_bytes").alias("row_bytes"), "shard", "shard_depth", "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("oversize"))
    return out.toDF(*kept, *RESULT)


def write_shards(placed: DataFrame, folder: str) -> None:
    """The rows of ``shard`` as Parquet, those of each shard in a folder of its own."""
    even = placed.repartitionByRange("shard", F.xxhash64(*comparable(placed, placed.columns)))
    # The only shard's name is empty, which no folder can be.
    even.withColumn("_folder", F.concat(F.lit("p"), "shard")).write.partitionBy("_folder").parquet(folder)


def read_shards(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """What ``write_shards`` wrote; schema is that of its rows."""
    return spark.read.schema(schema).parquet(folder).select(*[f"`{c}`" for c in schema.names])
