"""Helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word as most contracts here define it: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Maps A-Z to a-z and leaves every other byte alone.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Make checkpoint() usable: the cluster's folder, or a temporary one in local mode (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="ordinate-ckpt-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; what lies there goes when the application ends."""
    ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"
    path, fs = _file_system(spark, folder)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    path, fs = _file_system(spark, folder)
    fs.delete(path, True)


def _file_system(spark: SparkSession, folder: str):
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(sc._jsc.hadoopConfiguration())


class Workspace:
    """Tables of one computation, written to the shared folder so that no lost executor makes anything be computed twice, and removed once they are of no use."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, shared_folder(spark, name)
        self.names: set[str] = set()

    def store(self, name: str, df: DataFrame) -> DataFrame:
        at = f"{self.folder}/{name}"
        df.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(at)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        for name in names or tuple(self.names):
            self.names.discard(name)
            remove(self.spark, f"{self.folder}/{name}")

    def keep(self, *names: str) -> None:
        """Drop all others."""
        for name in self.names - set(names):
            self.drop(name)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder now and read it from there."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without the columns that an operator is about to add (names compare without case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def renamed(df: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """df with its columns named c0, c1 and so on, like no helper column; and what each name became."""
    new = [f"c{i}" for i in range(len(df.columns))]
    at = {n.lower(): c for n, c in zip(df.columns, new, strict=True)}
    return df.toDF(*new), lambda n: at[n.lower()]


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def comparable(df: DataFrame, names: Iterable[str]) -> list[Column]:
    """The named columns as values that can be grouped, ordered and hashed: maps and variants as JSON."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [F.col(f"`{n}`") if _orderable(kinds[n]) else F.to_json(F.struct(F.col(f"`{n}`").alias("v"))) for n in names]


def md5_int(value: Column, digits: int = 13) -> Column:
    """The first hex digits of an MD5 as a number; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def numbered(df: DataFrame, n: str, name: str, chunk: int = 1 << 16) -> DataFrame:
    """Each row n times, with ``name`` counting from 1; no array is longer than a chunk or n / chunk."""
    start, end = F.col("_from"), F.least(F.col("_from") + (chunk - 1), F.col(n))
    out = df.where(F.col(n) > 0).withColumn("_from", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n).cast("bigint"), F.lit(chunk).cast("bigint"))))
    return out.withColumn(name, F.explode(F.sequence(start, end.cast("bigint")))).drop("_from")


def binary_list(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to executors that don't have it installed, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        root = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="ordinate-")  # the driver serves the file from here as long as it lives
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/{root.name}.zip", "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(f"{folder}/{root.name}.zip")


def give_back() -> None:
    """Hand this process's free memory to the system; a Python worker lives on through all jobs and would hold its highest use for good."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it, and needs it
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow, with this package at hand on the executors; each task gives its memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def apply_arrow(df: DataFrame, keys: Iterable[str], work: Callable[[pa.Table], pa.Table], schema, *, large: int = 1 << 20) -> DataFrame:
    """df.groupBy(keys).applyInArrow, with this package at hand on the executors; groups of ``large`` bytes or more give their memory back."""

    def run(group: pa.Table) -> pa.Table:
        out = work(group)
        if group.nbytes >= large:
            give_back()
        return out

    ship(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(run, schema)


def arrow_columns(df: DataFrame, fields: list[tuple[str, str]], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]) -> DataFrame:
    """df and further columns, computed batch by batch in one narrow pass.

    ``make`` is called once in each task and returns the function that turns a
    batch into the new columns.  Input columns of the same names are replaced.
    """
    df = without(df, [n for n, _ in fields])
    schema = T.StructType(list(df.schema.fields) + [T.StructField(n, T._parse_datatype_string(t), True) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            new = work(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *[n for n, _ in fields]])

    return map_arrow(df, run, schema)
