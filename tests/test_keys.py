import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ordinate import Error
from ordinate.functions import keys as K

INTS = [-(2**63), -(2**40), -256, -1, 0, 1, 255, 2**40, 2**63 - 1]
TEXTS = ["", "a", "a\0", "a\0b", "a\x01", "ab", "é", "\U0001f600"]
RAWS = [b"", b"\0", b"\0\xff", b"a", b"\xff"]
SCALARS = [*INTS, *TEXTS, *RAWS]
part = st.one_of(st.integers(-(2**63), 2**63 - 1), st.text(st.characters(exclude_categories=["Cs"])), st.binary())
parts = st.lists(part, max_size=4).map(tuple)


def order(key):
    """The stated order, from scratch: type, then value, then length."""
    rank = {int: 1, str: 2, bytes: 3}
    return [(rank[type(p)], p.encode() if isinstance(p, str) else p) for p in (key if isinstance(key, tuple) else (key,))]


def test_order_of_all_pairs():
    keys = [(), *SCALARS, *itertools.product(SCALARS, repeat=2)]
    by_code = sorted(keys, key=K.encode)
    # Scalars and their 1-tuples don't both occur, so the order is strict.
    assert [order(k) for k in by_code] == sorted(map(order, keys))
    assert len({K.encode(k) for k in keys}) == len(keys)


@given(parts, parts)
@settings(max_examples=300)
def test_order_and_round_trip_of_any_keys(a, b):
    assert (K.encode(a) < K.encode(b)) == (order(a) < order(b))
    assert K.decode(K.encode(a)) == (a[0] if len(a) == 1 else a)


def test_a_scalar_is_the_tuple_of_it():
    assert K.encode(("a",)) == K.encode("a")
    assert K.decode(K.encode((7,))) == 7
    assert K.decode(K.encode(())) == ()


#: Anything that is not an int, a str or bytes; alone, or between fit components.
misfit = st.one_of(st.floats(), st.booleans(), st.none(), st.complex_numbers(), st.lists(st.integers(), max_size=2), st.frozensets(st.text(), max_size=2), st.dictionaries(st.text(), st.integers(), max_size=1), parts, st.binary().map(bytearray), st.dates())


@given(parts, misfit, parts)
def test_unfit_types(before, bad, after):
    if not isinstance(bad, tuple):
        with pytest.raises(TypeError):
            K.encode(bad)
    with pytest.raises(TypeError):
        K.encode((*before, bad, *after))


@given(parts, st.one_of(st.integers(min_value=2**63), st.integers(max_value=-(2**63) - 1), st.text(st.characters(categories=["Cs"]), min_size=1)))
def test_unfit_values(before, bad):
    for k in (bad, (*before, bad)):
        with pytest.raises(ValueError):
            K.encode(k)


@pytest.mark.parametrize("raw", [b"\x01\x80", b"\x02ab", b"\x09", b"\x02\xff\x00", b"\x02a\x00\xff"])
def test_corrupt_bytes(raw):
    with pytest.raises(Error):
        K.decode(raw)


def test_successor():
    assert K.successor(b"ab") == b"ac"
    assert K.successor(b"a\xff\xff") == b"b"
    assert K.successor(b"\xff\xff") is None
    assert K.successor(b"") is None


def starts(key, p):
    """The stated rule of prefixes, on keys themselves."""
    key = key if isinstance(key, tuple) else (key,)
    if isinstance(p, tuple):
        return key[: len(p)] == p and list(map(type, key[: len(p)])) == list(map(type, p))
    return len(key) > 0 and type(key[0]) is type(p) and key[0].startswith(p)


@given(parts, st.one_of(st.text(max_size=2, alphabet="a\0b"), st.binary(max_size=2), parts))
@settings(max_examples=300)
def test_prefix_bounds(key, p):
    low, high = K.prefix_bounds(p)
    code = K.encode(key)
    assert (code >= low and (high is None or code < high)) == starts(key, p)


def test_prefixes_that_are_exact():
    keys = [(), *SCALARS, *itertools.product(SCALARS, repeat=2)]
    for p in ["", "a", "a\0", b"", b"\0", (), ("a",), (1,), ("a", 1), ("a\0",)]:
        low, high = K.prefix_bounds(p)
        assert [k for k in keys if K.encode(k) >= low and (high is None or K.encode(k) < high)] == [k for k in keys if starts(k, p)]
    with pytest.raises(TypeError):
        K.prefix_bounds(5)
    with pytest.raises(ValueError):
        K.prefix_bounds(2**63)


def test_range_bounds():
    assert K.range_bounds(None, None) == (None, None)
    with pytest.raises(TypeError):
        K.range_bounds(1, "z")
    with pytest.raises(TypeError):
        K.range_bounds(1, ("a",))
    with pytest.raises(TypeError):
        K.range_bounds(True, False)


def test_columns_agree_with_the_driver(spark):
    rows = [(i, s, r) for i, s, r in itertools.product(INTS, TEXTS, RAWS)]
    df = spark.createDataFrame(rows, "i bigint, s string, b binary")
    i, s, b = K.int_part(F.col("i")), K.str_part(F.col("s")), K.bytes_part(F.col("b"))
    out = df.select("*", i.alias("ki"), s.alias("ks"), b.alias("kb"), K.key(s, i, b).alias("k"))
    out = out.select("*", K.decode_int(F.col("ki")).alias("di"), K.decode_str(F.col("ks")).alias("ds"), K.decode_bytes(F.col("kb")).alias("db"), K.decode_int(F.col("k"), 1).alias("_"), K.decode_parts(F.col("k")).alias("p"))
    for r in out.collect():
        raw = bytes(r["b"])
        assert bytes(r["ki"]) == K.encode(r["i"]) and bytes(r["ks"]) == K.encode(r["s"]) and bytes(r["kb"]) == K.encode(raw)
        assert bytes(r["k"]) == K.encode((r["s"], r["i"], raw))
        assert (r["di"], r["ds"], bytes(r["db"])) == (r["i"], r["s"], raw)
        assert [p["t"] for p in r["p"]] == [2, 1, 3] and [p["i"] is None for p in r["p"]] == [True, False, True] and (r["p"][0]["s"], r["p"][1]["i"], bytes(r["p"][2]["b"])) == (r["s"], r["i"], raw)


def test_spark_sorts_keys_in_order(spark):
    keys = [(), *SCALARS, *itertools.product(SCALARS, repeat=2)]
    df = spark.createDataFrame([(K.encode(k),) for k in reversed(keys)], "k binary")
    assert [K.decode(bytes(r["k"])) for r in df.orderBy("k").collect()] == sorted(keys, key=order)


def test_key_of_rejects_other_types(spark):
    with pytest.raises(TypeError):
        K.key_of(spark.sql("select 1.5d as x"), "x")


def test_parts_of_long_and_empty_keys(spark):
    long = "ab\0" * 20_000
    keys = [(), ("",), (b"",), (long, -1, long.encode()), (0, 0, 0), ("\0", b"\0\xff", "\xff")]
    rows = spark.createDataFrame([(i, K.encode(k)) for i, k in enumerate(keys)], "i int, k binary").select("i", K.decode_parts(F.col("k")).alias("p"))
    for r in rows.collect():
        got = tuple(p["i"] if p["t"] == 1 else p["s"] if p["t"] == 2 else bytes(p["b"]) for p in r["p"])
        assert got == keys[r["i"]]
