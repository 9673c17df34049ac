"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words: the whole corpus shared out by
weight, held to ``most`` times the source's own size, what is cut off reshared
by weight until no source is above its limit.  Within a source each document is
expected ``rate = target / source size`` times.  The documents are laid in an
order that climbs in size, the expected copies are summed along it, one random
offset of the source is added, and a document is emitted once for each integer
that the running sum crosses.  The climb in size keeps the words taken near the
target, as every stretch of like-sized documents gives its share.

The running sum needs the position of a document in its source.  It is built
from counts of nested cells (size class, then two levels of hash bits), so no
task ever holds more than one small cell of a source, however large the source;
only (source, id, size) rows move, never texts.

Edge cases: a null source is a source of its own, last in the order of weights;
a null text has size 0; a source of total size 0 has target 0 and takes
nothing; repeated rows are counted first and share their place in the order;
null ids are an id like any other; an empty table gives an empty result; extra
columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, comparable, md5_int, numbered, renamed


def size_class(size: Column) -> Column:
    """Classes about 3 to 6 % wide: the bit length and the four bits after the first."""
    bits = F.length(F.bin(size))
    top = F.call_function("shiftright", size, F.greatest(bits - 5, F.lit(0)).cast("int"))
    return (bits * 64 + top).cast("int")


def targets(totals: DataFrame, *, most: float = 3.0, cycle: int = 3) -> DataFrame:
    """Adds weight and target to (source, source_size), one row for each source.

    The resharing has a closed form: with a level L, target = min(most * size,
    L * weight); sources reach their limit in the order of most * size / weight.
    One row for each source meets in one task here; sources are counted in
    thousands at most, as they are named data sets.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("reach", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    out = totals.withColumn("weight", (F.pmod(F.row_number().over(by_name) - 1, F.lit(cycle)) + 1).cast("bigint"))
    out = out.withColumn("limit", F.lit(most) * F.col("source_size")).withColumn("reach", F.col("limit") / F.col("weight"))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("left_words", F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    out = out.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    out = out.withColumn("level", F.when(F.col("left_words") / F.col("left_weight") < F.col("reach"), F.col("left_words") / F.col("left_weight")))
    # The first source, in order of reach, that the level doesn't fill sets the level for all after it.
    out = out.withColumn("level", F.first("level", ignorenulls=True).over(by_limit.rowsBetween(Window.unboundedPreceding, 0)))
    return out.select("source", "source_size", "weight", F.coalesce(F.least(F.col("limit"), F.col("level") * F.col("weight")), F.col("limit")).alias("target"))


def plan_copies(sizes: DataFrame, *, seed: str = "mix", most: float = 3.0) -> DataFrame:
    """From rows (id, source, size): distinct (id, source, size), each with n equal rows, source_size, target, and the place, rate and offset from which crossed() counts copies."""
    kinds = sizes.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    mark = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    h = md5_int(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    kinds = kinds.select("*", mark.alias("mark"), size_class(F.col("size")).alias("bin"), h.alias("h"))
    kinds = kinds.withColumn("a", F.pmod("h", F.lit(256)).cast("int")).withColumn("b", F.pmod(F.shiftright("h", 8), F.lit(256)).cast("int"))
    kinds = checkpointed(kinds)
    keys = ["mark", "bin", "a", "b"]
    counted = kinds.groupBy(*keys).agg(F.sum("n").alias("n"))
    places = None
    for depth in (2, 3, 4):
        level = counted.groupBy(*keys[:depth]).agg(F.sum("n").alias("n"))
        over = Window.partitionBy(*keys[: depth - 1]).orderBy(keys[depth - 1]).rowsBetween(Window.unboundedPreceding, -1)
        level = level.select(*keys[:depth], F.coalesce(F.sum("n").over(over), F.lit(0)).alias(f"at{depth}"))
        places = level if places is None else level.join(places, keys[: depth - 1])
    places = places.select(*keys, (F.col("at2") + F.col("at3") + F.col("at4")).alias("start"))
    inside = Window.partitionBy(*keys).orderBy("size", "h", F.col("id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(places, keys)
    totals = kinds.groupBy("mark").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets(totals, most=most).withColumn("mark", mark).drop("source", "weight")
    goal = goal.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    goal = goal.withColumn("offset", md5_int(F.concat_ws("|", F.lit(seed), F.lit("offset"), F.col("mark"))) / F.lit(float(1 << 52)))
    out = kinds.join(goal, "mark")
    return out.select("id", "source", "size", "n", "source_size", "target", (F.col("start") + F.col("inside")).alias("first"), "rate", "offset")


def crossed(place: Column) -> Column:
    """Integers that the running sum of expected copies, moved by the offset, has passed at a place."""
    return F.floor(F.col("rate") * place + F.col("offset"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix", most: float = 3.0) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, copies and taken (words)."""
    sizes = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    plan = plan_copies(sizes, seed=seed, most=most)
    rows = numbered(plan, "n", "k").withColumn("copies", crossed(F.col("first") + F.col("k")) - crossed(F.col("first") + F.col("k") - 1))
    return rows.select(F.col("id").alias(doc_id), F.col("source").alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix", most: float = 3.0) -> DataFrame:
    """The mixed corpus itself: each row of docs as often as the mix takes it, with the columns of docs.

    Rows that share id, source and size are told apart by their columns; equal
    rows are counted before they move and written out again at the end.
    """
    kept = docs.columns
    docs, of = renamed(docs)
    doc_id, source, text = of(doc_id), of(source), of(text)
    names = [f"`{c}`" for c in docs.columns]
    odd = [n for n, m in zip(names, comparable(docs, docs.columns), strict=True) if str(m) != str(F.col(n))]
    key = F.struct(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    rows = docs.withColumn("_key", key)
    for i, n in enumerate(odd):  # what can't be grouped by travels beside what stands for it
        rows = rows.withColumn(f"_odd{i}", comparable(docs, [n.strip("`")])[0])
    marks = [n for n in names if n not in odd] + [f"_odd{i}" for i in range(len(odd))]
    plan = plan_copies(rows.select("_key.*"), seed=seed, most=most)
    plan = plan.select(F.struct("id", "source", "size").alias("_key"), *[F.col(c).alias(f"_{c}") for c in ("n", "first", "rate", "offset")])
    joined = rows.join(plan, "_key")
    ones = joined.where("_n = 1").withColumn("_c", F.lit(1).cast("bigint")).withColumn("_before", F.lit(0).cast("bigint"))
    many = joined.where("_n > 1").groupBy("_key", *marks, "_n", "_first", "_rate", "_offset").agg(F.count(F.lit(1)).alias("_c"), *[F.first(n).alias(n.strip("`")) for n in odd])
    order = Window.partitionBy("_key").orderBy(*[F.col(c).asc_nulls_first() for c in marks]).rowsBetween(Window.unboundedPreceding, -1)
    many = many.withColumn("_before", F.coalesce(F.sum("_c").over(order), F.lit(0)))
    both = ones.unionByName(many)
    at = lambda place: F.floor(F.col("_rate") * place + F.col("_offset"))
    start = F.col("_first") + F.col("_before")
    return numbered(both.withColumn("_times", at(start + F.col("_c")) - at(start)), "_times", "_k").select(*names).toDF(*kept)
