"""Operators for preparing training corpora at scale.

Each module holds one operator with a general interface; ``queries`` binds the
operators to the tables of a data folder.  Nothing outside this subpackage
imports it.
"""
