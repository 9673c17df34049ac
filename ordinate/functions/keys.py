"""Order-preserving keys.

A key is an int (64 bits), a str, bytes, or a flat tuple of them.  Its encoding
is a byte string whose unsigned byte order is the order of keys: by component,
ints before strs before bytes, then by value, a shorter tuple before longer ones
that begin with it.  A scalar and the tuple of it alone are the same key.

The same encoding exists twice: for single keys on the driver (``encode``), and
for whole columns as built-in Spark functions (``int_part``, ``str_part``,
``bytes_part``, ``key``), so that bulk data never leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Error

# The tag byte of each type, and how a NUL inside text is told from the end of it.
INT, STR, BYTES = 0x01, 0x02, 0x03
NUL, ESCAPED_NUL, END = b"\x00", b"\x00\xff", b"\x00"

SMALLEST, LARGEST = -(2**63), 2**63 - 1


def _body(part) -> bytes:
    """One component without its end mark."""
    if isinstance(part, str):
        try:
            return bytes([STR]) + part.encode().replace(NUL, ESCAPED_NUL)
        except UnicodeEncodeError as e:
            raise ValueError(f"a key can't hold lone surrogates: {part!r}") from e
    if isinstance(part, bytes):
        return bytes([BYTES]) + part.replace(NUL, ESCAPED_NUL)
    if isinstance(part, int) and not isinstance(part, bool):
        if not SMALLEST <= part <= LARGEST:
            raise ValueError(f"an int key must fit 64 bits: {part}")
        return bytes([INT]) + (part - SMALLEST).to_bytes(8, "big")
    raise TypeError(f"a key is made of int, str and bytes, not {type(part).__name__}")


def encode(key) -> bytes:
    parts = key if isinstance(key, tuple) else (key,)
    return b"".join(_body(p) + (b"" if isinstance(p, int) else END) for p in parts)


def _parts(raw: bytes) -> Iterator:
    at = 0
    while at < len(raw):
        tag, at = raw[at], at + 1
        if tag == INT:
            if at + 8 > len(raw):
                raise Error("corrupt key: an int is cut off")
            yield int.from_bytes(raw[at : at + 8], "big") + SMALLEST
            at += 8
        elif tag in (STR, BYTES):
            end = at
            while (end := raw.find(NUL, end)) >= 0 and raw[end : end + 2] == ESCAPED_NUL:
                end += 2
            if end < 0:
                raise Error("corrupt key: text has no end")
            body = raw[at:end].replace(ESCAPED_NUL, NUL)
            try:
                yield body.decode() if tag == STR else body
            except UnicodeDecodeError as e:
                raise Error("corrupt key: text is not UTF-8") from e
            at = end + 1
        else:
            raise Error(f"corrupt key: unknown tag {tag}")


def decode(raw: bytes):
    parts = tuple(_parts(bytes(raw)))
    return parts[0] if len(parts) == 1 else parts


def successor(raw: bytes) -> bytes | None:
    """The smallest byte string above all that begin with raw; None if there is none."""
    stem = raw.rstrip(b"\xff")
    return stem[:-1] + bytes([stem[-1] + 1]) if stem else None


def prefix_bounds(prefix) -> tuple[bytes, bytes | None]:
    """The half-open range of encoded keys that begin with a prefix.

    A str or bytes prefix is a beginning of the first component, whatever
    follows it; a tuple is a run of whole leading components.
    """
    if isinstance(prefix, tuple):
        low = encode(prefix)
        # The next component begins with a tag, an escaped NUL would go on with FF: this bound parts them.
        return low, low + b"\xff" if low else None
    low = _body(prefix)
    if low[0] == INT:
        raise TypeError("a prefix is a str, bytes or a tuple, not an int")
    return low, successor(low)


def range_bounds(start, stop) -> tuple[bytes | None, bytes | None]:
    if start is not None and stop is not None and type(start) is not type(stop):
        raise TypeError(f"the bounds of a range must be of one type, not {type(start).__name__} and {type(stop).__name__}")
    return tuple(None if bound is None else encode(bound) for bound in (start, stop))


# Columns


def _escaped(raw: Column) -> Column:
    """Bytes with every 00 followed by FF. Pairs of hex digits are set apart first, as 1001 holds no byte 00."""
    apart = F.regexp_replace(F.hex(raw), "(..)", "$1 ")
    return F.unhex(F.replace(F.replace(apart, F.lit("00 "), F.lit("00FF ")), F.lit(" "), F.lit("")))


def int_part(c: Column) -> Column:
    # Its eight bytes, largest first, the sign turned.
    return F.unhex(F.concat(F.lit("01"), F.lpad(F.hex(c.cast("bigint").bitwiseXOR(F.lit(SMALLEST).cast("bigint"))), 16, "0")))


def str_part(c: Column) -> Column:
    raw = F.encode(c, "UTF-8")
    return F.concat(F.lit(bytes([STR])), F.when(F.contains(c, F.lit("\0")), _escaped(raw)).otherwise(raw), F.lit(END))


def bytes_part(c: Column) -> Column:
    return F.concat(F.lit(bytes([BYTES])), F.when(F.contains(c, F.lit(NUL)), _escaped(c)).otherwise(c), F.lit(END))


def key(*parts: Column) -> Column:
    """The key of several components, each from int_part, str_part or bytes_part. Null if any is null."""
    return F.concat(*parts) if parts else F.lit(b"")


def key_of(df, *columns: str) -> Column:
    """The key of the named columns, encoded by their types."""
    makers = {"string": str_part, "binary": bytes_part, "bigint": int_part, "int": int_part, "smallint": int_part, "tinyint": int_part}
    types = dict(df.dtypes)
    for c in columns:
        if types[c] not in makers:
            raise TypeError(f"column {c} of type {types[c]} can't be part of a key")
    return key(*[makers[types[c]](F.col(f"`{c}`")) for c in columns])


def decode_int(k: Column, at: int = 1) -> Column:
    """The int component that starts at byte ``at`` (from 1) of a key."""
    return F.conv(F.substring(F.hex(k), 2 * at + 1, 16), 16, -10).cast("bigint").bitwiseXOR(F.lit(SMALLEST).cast("bigint"))


def _text(k: Column) -> Column:
    body = F.regexp_replace(F.substring(F.hex(k), F.lit(3), F.length(F.hex(k)) - 4), "(..)", "$1 ")
    return F.unhex(F.replace(F.replace(body, F.lit("00 FF "), F.lit("00 ")), F.lit(" "), F.lit("")))


def decode_str(k: Column) -> Column:
    """The str of a key of one component."""
    return F.decode(_text(k), "UTF-8")


def decode_bytes(k: Column) -> Column:
    """The bytes of a key of one component."""
    return _text(k)


#: One component in hex pairs, each followed by a blank: nine bytes, or bytes up to a 00 that no FF follows.
_COMPONENT = "01 [0-9A-F ]{24}|0[23] [0-9A-F ]*?00 (?!FF )"


def decode_parts(k: Column) -> Column:
    """All components of keys of any shape: for each its tag t, and its value in i, s or b."""
    found = F.regexp_extract_all(F.regexp_replace(F.hex(k), "(..)", "$1 "), F.lit(_COMPONENT), F.lit(0))

    def one(x: Column) -> Column:
        tag = F.substring(x, 2, 1).cast("tinyint")
        number = F.conv(F.replace(F.substring(x, 4, 24), F.lit(" "), F.lit("")), 16, -10).cast("bigint").bitwiseXOR(F.lit(SMALLEST).cast("bigint"))
        body = F.unhex(F.replace(F.replace(F.substring(x, F.lit(4), F.length(x) - 6), F.lit("00 FF "), F.lit("00 ")), F.lit(" "), F.lit("")))
        fields = (tag.alias("t"), F.when(tag == INT, number).alias("i"), F.when(tag == STR, F.decode(body, "UTF-8")).alias("s"), F.when(tag == BYTES, body).alias("b"))
        return F.struct(*fields)

    return F.transform(found, one)
