"""Ordered collections of schemaless documents on Spark."""

from .collection import Collection
from .database import Database, open
from .errors import Error

__all__ = ["Collection", "Database", "Error", "open"]
