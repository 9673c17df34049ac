import dataclasses
from datetime import UTC, datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ordinate.functions import documents as D
from ordinate.functions import models as M

leaf = st.one_of(st.none(), st.booleans(), st.integers(-(2**63), 2**63 - 1), st.floats(allow_nan=False), st.text(st.characters(exclude_categories=["Cs"]), max_size=80), st.binary(max_size=80))
names = st.text(st.characters(exclude_categories=["Cs"]), max_size=6)
documents = st.dictionaries(names, st.recursive(leaf, lambda x: st.one_of(st.lists(x, max_size=4), st.dictionaries(names, x, max_size=4)), max_leaves=12), max_size=6)


def same(a, b):
    if isinstance(a, dict):
        return isinstance(b, dict) and a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return isinstance(b, list) and len(a) == len(b) and all(map(same, a, b))
    return type(a) is type(b) and a == b


@given(documents)
@settings(max_examples=200)
def test_round_trip_keeps_types(doc):
    assert same(doc, D.from_variant(D.to_variant(doc)))


def test_large_documents():
    doc = {f"f{i}": i for i in range(300)} | {"list": list(range(70_000)), "text": "x" * 100_000}
    assert D.from_variant(D.to_variant(doc)) == doc


def test_variants_are_sparks(spark):
    doc = {"n": None, "t": True, "i": 7, "big": 2**40, "f": 1.5, "s": "é" * 40, "b": b"\0\xff", "at": datetime(1997, 3, 9, 4, 30, tzinfo=UTC), "l": [1, 2.5, ["x", None]], "d": {"z": 1, "a": {"b": 2}}}
    df = spark.createDataFrame([(D.to_variant(doc),)], "doc variant")
    assert D.from_variant(df.first()["doc"]) == doc
    got = df.select(F.expr("schema_of_variant(doc)").alias("s"), F.expr("variant_get(doc, '$.d.a.b', 'int')").alias("b"), D.field(F.col("doc"), "f", "double").alias("f"), D.field(F.col("doc"), "none", "int").alias("none")).first()
    assert "f: DOUBLE" in got["s"] and "b: BINARY" in got["s"] and "at: TIMESTAMP" in got["s"]
    assert (got["b"], got["f"], got["none"]) == (2, 1.5, None)


@pytest.mark.parametrize(("micros", "expected"), [(123456, 123), (123500, 124), (123600, 124), (-500, -1), (-499, 0), (-1500, -2), (0, 0)])
def test_milliseconds_round_half_away(spark, micros, expected):
    moment = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=micros)
    assert D.millis(moment) == expected
    got = spark.range(1).select(F.unix_micros(D.round_millis(F.timestamp_micros(F.lit(micros)))).alias("m")).first()["m"]
    assert got == expected * 1000


@given(st.datetimes(min_value=datetime(1900, 1, 1), max_value=datetime(2200, 1, 1)), st.integers(-14 * 60, 14 * 60))
def test_times_are_utc(moment, minutes):
    moment = moment.replace(microsecond=moment.microsecond // 1000 * 1000)
    zone = timezone(timedelta(minutes=minutes))
    doc = D.from_variant(D.to_variant({"bare": moment, "zoned": moment.replace(tzinfo=zone)}))
    assert doc["bare"] == moment.replace(tzinfo=UTC) and doc["zoned"] == moment.replace(tzinfo=UTC) - timedelta(minutes=minutes)
    assert doc["bare"].utcoffset() == doc["zoned"].utcoffset() == timedelta(0)


#: Where an unfit value may hide: the document around it, and how its path is told.
hiding = st.sampled_from([(lambda x: {"top": x}, "$.top"), (lambda x: {"list": [0, "a", x]}, "$.list[2]"), (lambda x: {"deep": {"er": [[x]]}}, "$.deep.er[0][0]"), (lambda x: {"ok": 1, "z": {"y": x}}, "$.z.y")])


@given(hiding, st.one_of(st.frozensets(st.integers()), st.tuples(st.integers()), st.complex_numbers(), st.dates().filter(lambda d: not isinstance(d, datetime)), st.decimals(), st.binary().map(bytearray), st.just(int)))
def test_unfit_values_are_told_with_their_place(place, bad):
    around, path = place
    with pytest.raises(TypeError) as e:
        D.to_variant(around(bad))
    assert path in str(e.value)


@given(hiding, st.one_of(st.integers(min_value=2**63), st.integers(max_value=-(2**63) - 1)))
def test_large_ints_are_refused(place, bad):
    around, path = place
    with pytest.raises(ValueError) as e:
        D.to_variant(around(bad))
    assert path in str(e.value)


@given(hiding, st.one_of(st.integers(), st.none(), st.binary()))
def test_names_are_text(place, name):
    around, path = place
    with pytest.raises(TypeError) as e:
        D.to_variant(around({name: 1}))
    assert path in str(e.value)


@given(st.one_of(leaf, st.lists(st.integers())))
def test_documents_are_dicts(bad):
    with pytest.raises(TypeError):
        D.to_variant(bad)


def test_bulk_documents_are_the_same(spark):
    df = spark.sql("select 1 as id, 2.5f as f, timestamp_ntz'2026-01-01 00:00:00.123600' as ts, array(1, 2) as l")
    row = df.select(D.document_of(df).alias("d")).first()["d"]
    assert D.from_variant(row) == {"id": 1, "f": 2.5, "ts": datetime(2026, 1, 1, 0, 0, 0, 124000, tzinfo=UTC), "l": [1, 2]}


@dataclasses.dataclass
class Person:
    name: str
    age: int


class Duck:
    """Has the methods that pydantic's models have."""

    def __init__(self, name):
        self.name = name

    def model_dump(self):
        return {"name": self.name}

    @classmethod
    def model_validate(cls, doc):
        return cls(**doc)


def test_models(spark):
    assert M.dump(Person("A", 1)) == {"name": "A", "age": 1} and M.load(Person, {"name": "A", "age": 1}) == Person("A", 1)
    assert M.dump(Duck("B")) == {"name": "B"} and M.load(Duck, {"name": "B"}).name == "B"
    assert M.dump({"x": 1}) == {"x": 1} and M.load(None, {"x": 1}) == {"x": 1}
    with pytest.raises(TypeError):
        M.load(int, {})
    df = spark.createDataFrame([(b"k", D.to_variant({"name": "A", "age": 3}))], "k binary, doc variant")
    assert M.schema(Person).simpleString() == "struct<name:string,age:bigint>"
    assert M.typed(df, Person).collect()[0].asDict() == {"k": bytearray(b"k"), "name": "A", "age": 3}


@pytest.mark.parametrize("column", ["cast(1 as decimal(9, 2))", "date'2020-02-02'", "map('a', 1)", "interval '1' day", "array(struct(date'2020-02-02' as d))"])
def test_bulk_refuses_what_the_driver_refuses(spark, column):
    with pytest.raises(TypeError, match="can't hold"):
        D.document_of(spark.sql(f"select {column} as c"))


def test_bulk_rounds_times_at_any_depth(spark):
    df = spark.sql("select struct(array(timestamp_ntz'2001-01-01 00:00:00.000700') as l, 1.5f as f) as s, cast(null as struct<x:int>) as none")
    got = D.from_variant(df.select(D.document_of(df).alias("d")).first()["d"])
    assert got == {"s": {"l": [datetime(2001, 1, 1, 0, 0, 0, 1000, tzinfo=UTC)], "f": 1.5}, "none": None}
