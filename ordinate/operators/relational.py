"""The operators of a collection as functions from DataFrames to DataFrames.

A collection is a DataFrame with a key column ``k`` (see functions.keys) and any
payload columns, usually one Variant column ``doc``.  Reads become filters on
``k`` that reach the Parquet scan, writes become latest-wins merges, and nothing
is collected.  Batches of keys are semi, anti and left joins; Spark chooses how.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..plans.checkpoints import checkpointed

PUT, DELETE = 0, 1


def between(low: bytes | None, high: bytes | None, k: str = "k") -> Column | None:
    """low <= k < high, each side open if None."""
    sides = ([F.col(k) >= F.lit(low)] if low is not None else []) + ([F.col(k) < F.lit(high)] if high is not None else [])
    return None if not sides else sides[0] if len(sides) == 1 else sides[0] & sides[1]


def _where(df: DataFrame, condition: Column | None) -> DataFrame:
    return df if condition is None else df.where(condition)


# Reads


def get(df: DataFrame, key) -> DataFrame:
    return df.where(F.col("k") == F.lit(K.encode(key))).limit(1)


def get_many(df: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (k and others) with the payload of the keys that exist, null where there is none."""
    return probes.join(df, "k", "left")


def contains(df: DataFrame, probes: DataFrame, name: str = "found") -> DataFrame:
    """probes with a flag: whether the key exists. (A collection holds a key once, so nothing has to be made distinct.)"""
    there = df.select("k").withColumn(name, F.lit(True))
    return probes.join(there, "k", "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def length(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("k").alias(name))


def key_range(df: DataFrame, start=None, stop=None) -> DataFrame:
    """start <= key < stop; an open side is None."""
    return _where(df, between(*K.range_bounds(start, stop)))


def prefix(df: DataFrame, p) -> DataFrame:
    return _where(df, between(*K.prefix_bounds(p)))


def in_order(df: DataFrame, reverse: bool = False) -> DataFrame:
    return df.orderBy(F.col("k").desc() if reverse else F.col("k"))


def first(df: DataFrame) -> DataFrame:
    return in_order(df).limit(1)


def last(df: DataFrame) -> DataFrame:
    return in_order(df, True).limit(1)


def ranked(df: DataFrame, name: str = "rank", reverse: bool = False, parts: int | None = None) -> DataFrame:
    """df with the place of each row in key order, from 1.

    Range partitions are sorted each by itself; only their sizes meet, so no
    task sees all rows.  The sorted rows are written to the checkpoint folder,
    as the bounds of the partitions are drawn anew whenever they are planned.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.col("k").desc() if reverse else F.col("k").asc()
    place = F.monotonically_increasing_id()
    laid = df.repartitionByRange(parts, by).sortWithinPartitions(by).withColumn("_p", F.shiftright(place, 33)).withColumn("_at", place.bitwiseAND(F.lit((1 << 33) - 1)))
    laid = checkpointed(laid)
    sizes = laid.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition: a bound set by the number of partitions.
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = laid.join(F.broadcast(starts), "_p").withColumn(name, F.col("_start") + F.col("_at") + 1)
    return out.drop("_p", "_at", "_start")


# Writes: changes are rows (k, seq, op, payload); seq orders them


def puts(df: DataFrame, seq: Column) -> DataFrame:
    return df.withColumn("seq", seq).withColumn("op", F.lit(PUT))


def deletes(keys: DataFrame, seq: Column) -> DataFrame:
    return keys.select("k").withColumn("seq", seq).withColumn("op", F.lit(DELETE))


def latest(changes: DataFrame) -> DataFrame:
    """The state that a log of changes leads to: of each key the last change, if it is a put."""
    payload = [c for c in changes.columns if c not in ("k", "seq", "op")]
    merged = changes.groupBy("k").agg(F.max_by(F.struct("op", *payload), F.col("seq")).alias("last"))
    return merged.where(F.col("last.op") == PUT).select("k", *[F.col(f"last.{c}").alias(c) for c in payload])


def apply(base: DataFrame, changes: DataFrame) -> DataFrame:
    """base with a log of changes applied: untouched keys pass by, the others take their last change."""
    untouched = base.join(changes.select("k").distinct(), "k", "left_anti")
    return untouched.unionByName(latest(changes).select(*base.columns))


def upsert(base: DataFrame, rows: DataFrame, seq: Column | None = None) -> DataFrame:
    """base with rows put; among rows of one key the largest seq wins."""
    return apply(base, puts(rows, seq if seq is not None else F.lit(0)))


def delete(base: DataFrame, keys: DataFrame) -> DataFrame:
    return base.join(keys.select("k"), "k", "left_anti")


def setdefault(base: DataFrame, rows: DataFrame) -> DataFrame:
    """base and those rows whose key it lacks."""
    return base.unionByName(rows.join(base.select("k"), "k", "left_anti").select(*base.columns))


def pop(base: DataFrame, key) -> tuple[DataFrame, DataFrame]:
    """The row of a key (none if it is missing), and the rest."""
    return get(base, key), base.where(F.col("k") != F.lit(K.encode(key)))


def pop_first(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The row of the smallest key, and the rest."""
    taken = first(base)
    return taken, delete(base, taken)


def clear(base: DataFrame) -> DataFrame:
    return base.limit(0)
