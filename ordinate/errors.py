"""The one exception of the storage layer."""


class Error(Exception):
    """A storage fault, corrupt bytes, or the use of a closed database."""
