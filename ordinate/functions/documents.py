"""Documents as Variant values.

A document is a dict with str keys whose values are None, bool, int (64 bits),
float, str, bytes, datetime, dict or list.  On the driver it is written in the
public binary encoding of Variant, so that no type is lost on the way (a float
stays a double, bytes stay bytes); in bulk ``to_variant_object`` makes the same
from a struct.
"""

from __future__ import annotations

import struct
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import VariantVal

_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)

# Fixed values of the Variant encoding: basic types, and the primitive types that documents use.
PRIMITIVE, SHORT_STRING, OBJECT, ARRAY = 0, 1, 2, 3
NULL, TRUE, FALSE, INT32, INT64, DOUBLE, TIMESTAMP, BINARY, LONG_STRING = 0, 1, 2, 5, 6, 7, 12, 15, 16


def millis(moment: datetime) -> int:
    """Milliseconds since 1970, half away from zero; a datetime without zone is UTC."""
    moment = moment.replace(tzinfo=UTC) if moment.tzinfo is None else moment
    micros = (moment - _EPOCH) // timedelta(microseconds=1)
    whole, rest = divmod(abs(micros), 1000)
    return (whole + (rest >= 500)) * (1 if micros >= 0 else -1)


def round_millis(ts: Column) -> Column:
    """A timestamp column rounded to milliseconds like ``millis``."""
    return F.timestamp_millis(F.round(F.unix_micros(ts) / F.lit(1000)).cast("bigint"))


def _width(n: int) -> int:
    return max(1, (n.bit_length() + 7) // 8)


def _little(n: int, width: int) -> bytes:
    return n.to_bytes(width, "little")


def _primitive(kind: int, body: bytes = b"") -> bytes:
    return bytes([kind << 2 | PRIMITIVE]) + body


class _Writer:
    def __init__(self, names: list[str]):
        self.number = {n: i for i, n in enumerate(names)}

    def value(self, v, path: str) -> bytes:
        if v is None:
            return _primitive(NULL)
        if isinstance(v, bool):
            return _primitive(TRUE if v else FALSE)
        if isinstance(v, int):
            if -(2**31) <= v < 2**31:
                return _primitive(INT32, struct.pack("<i", v))
            if -(2**63) <= v < 2**63:
                return _primitive(INT64, struct.pack("<q", v))
            raise ValueError(f"an int must fit 64 bits: {v} at {path}")
        if isinstance(v, float):
            return _primitive(DOUBLE, struct.pack("<d", v))
        if isinstance(v, str):
            raw = v.encode()
            return bytes([len(raw) << 2 | SHORT_STRING]) + raw if len(raw) < 64 else _primitive(LONG_STRING, struct.pack("<I", len(raw)) + raw)
        if isinstance(v, bytes):
            return _primitive(BINARY, struct.pack("<I", len(v)) + v)
        if isinstance(v, datetime):
            return _primitive(TIMESTAMP, struct.pack("<q", millis(v) * 1000))
        if isinstance(v, dict):
            return self.object(v, path)
        if isinstance(v, list):
            return self.array([self.value(x, f"{path}[{i}]") for i, x in enumerate(v)])
        raise TypeError(f"a document can't hold {type(v).__name__} at {path}")

    def object(self, v: dict, path: str) -> bytes:
        # Fields come in the order of their names, as UTF-16 units.
        fields = sorted(v, key=lambda n: n.encode("utf-16-be", "surrogatepass"))
        bodies = [self.value(v[n], f"{path}.{n}") for n in fields]
        ids, offsets, data = [self.number[n] for n in fields], [0], b"".join(bodies)
        for b in bodies:
            offsets.append(offsets[-1] + len(b))
        id_width, width, large = _width(max(ids, default=0)), _width(len(data)), len(fields) > 255
        head = (large << 4 | (id_width - 1) << 2 | (width - 1)) << 2 | OBJECT
        return bytes([head]) + _little(len(fields), 4 if large else 1) + b"".join(_little(i, id_width) for i in ids) + b"".join(_little(o, width) for o in offsets) + data

    def array(self, bodies: list[bytes]) -> bytes:
        offsets, data = [0], b"".join(bodies)
        for b in bodies:
            offsets.append(offsets[-1] + len(b))
        width, large = _width(len(data)), len(bodies) > 255
        head = (large << 2 | (width - 1)) << 2 | ARRAY
        return bytes([head]) + _little(len(bodies), 4 if large else 1) + b"".join(_little(o, width) for o in offsets) + data


def _names(v, path: str, out: set[str]) -> None:
    """Collect the field names, and check that they are names."""
    if isinstance(v, dict):
        for n, x in v.items():
            if not isinstance(n, str):
                raise TypeError(f"non-string field name at {path}: {n!r}")
            out.add(n)
            _names(x, f"{path}.{n}", out)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            _names(x, f"{path}[{i}]", out)


def to_variant(document) -> VariantVal:
    if not isinstance(document, dict):
        raise TypeError(f"a document must be a mapping (dict), not {type(document).__name__}")
    found: set[str] = set()
    _names(document, "$", found)
    names = sorted(found)
    raw = [n.encode() for n in names]
    width = _width(max(len(names), sum(map(len, raw))))
    offsets = [0]
    for r in raw:
        offsets.append(offsets[-1] + len(r))
    metadata = bytes([1 | (width - 1) << 6]) + _little(len(names), width) + b"".join(_little(o, width) for o in offsets) + b"".join(raw)
    return VariantVal(_Writer(names).value(document, "$"), metadata)


def from_variant(v: VariantVal) -> dict:
    """The document again; times come back aware, in UTC."""
    return _utc(v.toPython())


def _utc(v):
    if isinstance(v, datetime):
        return v.astimezone(UTC) if v.tzinfo else v.replace(tzinfo=UTC)
    if isinstance(v, dict):
        return {n: _utc(x) for n, x in v.items()}
    if isinstance(v, list):
        return [_utc(x) for x in v]
    return bytes(v) if isinstance(v, bytearray) else v


def as_utc(df: DataFrame, column: str) -> Column:
    """A time column as an instant: one without zone is UTC, whatever zone the session is in."""
    c = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.from_utc_timestamp(c.cast("timestamp"), F.current_timezone())
    return c


#: Types of Spark that hold what a document can hold, besides structs, arrays and times.
_PLAIN = (T.NullType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType, T.StringType, T.BinaryType, T.VariantType)


def _fit(c: Column, kind: T.DataType, path: str) -> Column:
    """A column as documents hold it: times as instants in milliseconds, floats as doubles, at any depth."""
    if isinstance(kind, _PLAIN):
        return c
    if isinstance(kind, T.FloatType):
        return c.cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return round_millis(F.from_utc_timestamp(c.cast("timestamp"), F.current_timezone()))
    if isinstance(kind, T.TimestampType):
        return round_millis(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _fit(x, kind.elementType, f"{path}[]"))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_fit(c[f.name], f.dataType, f"{path}.{f.name}").alias(f.name) for f in kind.fields]))
    raise TypeError(f"a document can't hold {kind.simpleString()} at {path}")


def document_of(df: DataFrame, *columns: str) -> Column:
    """A document column of the named columns (all by default), times rounded to milliseconds, floats as doubles. Decimals, dates, maps and intervals are refused, as on the driver."""
    fields = [f for f in df.schema.fields if not columns or f.name in columns]
    return F.to_variant_object(F.struct(*[_fit(F.col(f"`{f.name}`"), f.dataType, f"$.{f.name}").alias(f.name) for f in fields]))


def field(document: Column, name: str, kind: str) -> Column:
    """A field of a document as a typed column; null where it is missing or of another kind."""
    return F.try_variant_get(document, f"$['{name}']" if not name.isidentifier() else f"$.{name}", kind)
