"""Documents as instances of a model: a dataclass, or a class with the validate and dump methods that pydantic uses."""

from __future__ import annotations

import dataclasses
import typing
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .documents import field


def dump(value):
    """What is to be stored for a value: a model instance becomes a dict, anything else stays for the codec to judge."""
    if not isinstance(value, dict):
        if callable(getattr(type(value), "model_dump", None)):
            return value.model_dump()
        if dataclasses.is_dataclass(type(value)):
            return dataclasses.asdict(value)
    return value


def load(model, document: dict):
    """A stored document as the model asks for it; an unfit model is told here, on reading."""
    if model is None:
        return document
    validate = getattr(model, "model_validate", None)
    if validate is not None:
        return validate(document)
    if isinstance(model, type) and dataclasses.is_dataclass(model):
        return model(**document)
    raise TypeError(f"not a model: {model!r}")


_KINDS = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(), datetime: T.TimestampType()}


def _kind(hint) -> T.DataType:
    if hint in _KINDS:
        return _KINDS[hint]
    inner = typing.get_args(hint)
    if typing.get_origin(hint) is list:
        return T.ArrayType(_kind(inner[0]))
    if typing.get_origin(hint) is dict:
        return T.MapType(T.StringType(), _kind(inner[1]))
    if type(None) in inner and len(inner) == 2:
        return _kind(next(x for x in inner if x is not type(None)))
    if isinstance(hint, type):
        return schema(hint)
    raise TypeError(f"no column type for {hint!r}")


def schema(model) -> T.StructType:
    """The columns of a model, by its annotations."""
    return T.StructType([T.StructField(n, _kind(h)) for n, h in typing.get_type_hints(model).items() if not n.startswith("_") and typing.get_origin(h) is not typing.ClassVar])


def typed(df: DataFrame, model, document: Column | str = "doc") -> DataFrame:
    """df with the document's fields as typed columns in its place."""
    from pyspark.sql import functions as F

    column = F.col(document) if isinstance(document, str) else document
    others = [c for c in df.columns if c != document]
    return df.select(*others, *[field(column, f.name, f.dataType.simpleString()).alias(f.name) for f in schema(model).fields])
