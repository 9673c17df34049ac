"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become lower-cased ASCII-or-wider words; the patterns are the windows of
``window`` consecutive words of the benchmark items (an item of fewer words is
one shorter pattern).  For each pattern length a Wu-Manber searcher slides over
the document's words: a shift table over blocks of words says how far the
search may jump, a block with shift 0 selects the bucket of patterns that end
with it, a prefix narrows the bucket, and a direct comparison of the words
confirms the occurrence.

Scale: documents are scanned in one narrow pass, with no shuffle.  Patterns
reach the executors in blocks of at most ``block_bytes`` of benchmark text; a
larger benchmark makes more passes over the same stream of rows, one behind
the other, each adding its hits to two helper columns.

Edge cases: null or wordless texts have no words and no hits; a null or
wordless item has no window; items repeated under one id count once; an item
whose id is null marks words as hit but is not listed; repeated documents are
judged row by row; an empty benchmark hits nothing; input columns named like an
output column are replaced.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_columns, binary_list, renamed, without

#: Every byte outside 0-9, a-z (after lower-casing) and UTF-8's upper half parts words.
_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


RESULT = [("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items", "array<string>"), ("items_sha256", "string"), ("contaminated", "boolean")]


def split_words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class WuManber:
    """Finds every occurrence of word patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set]):
        self.length, self.block = length, min(3, length)
        last = length - self.block
        self.default = last + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[list[bytes], set]]]] = {}
        for words, items in patterns.items():
            for j in range(last + 1):
                piece = words[j : j + self.block]
                self.shift[piece] = min(self.shift.get(piece, self.default), last - j)
            bucket = self.buckets.setdefault(words[last:], {})
            bucket.setdefault(words[:2], []).append((list(words), items))

    def search(self, words: list[bytes]):
        """Yield (start, items) of each occurrence."""
        size, block, default, shift = self.length, self.block, self.default, self.shift
        end, n = size, len(words)
        while end <= n:
            piece = tuple(words[end - block : end])
            step = shift.get(piece, default)
            if step:
                end += step
                continue
            start = end - size
            for pattern, items in self.buckets[piece].get(tuple(words[start : start + min(2, size)]), ()):
                if words[start:end] == pattern:
                    yield start, items
                    break
            end += 1


def searchers(items: list[tuple[str | None, bytes | None]], window: int) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], set]] = {}
    for item, text in items:
        words = split_words(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            by_length.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set()).update([item] if item is not None else [])
    return [WuManber(size, patterns) for size, patterns in sorted(by_length.items())]


def find_hits(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (sorted array of string ids), items_sha256 and contaminated."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("body"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("body") + 32), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, math.ceil(total / block_bytes))
    docs = without(docs, [n for n, _ in RESULT])
    names = docs.columns
    out, of = renamed(docs)
    text = of(text)
    for k in range(blocks):
        chosen = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == k).collect()
        held = [(r["item"], r["body"].encode() if r["body"] is not None else None) for r in chosen]
        fields = RESULT if k == blocks - 1 else [(f"_spans{k}", "array<bigint>"), (f"_items{k}", "array<string>")]
        out = arrow_columns(out, fields, _scan(held, window, text, k, last=k == blocks - 1))
    out = out.drop(*[f"_{n}{k}" for n in ("spans", "items") for k in range(blocks - 1)])
    return out.toDF(*names, *[n for n, _ in RESULT])


def _scan(held: list, window: int, text: str, k: int, *, last: bool):
    """The pass over the documents with block k of the benchmark; it carries on what block k - 1 found."""

    def make():
        tools = searchers(held, window)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = binary_list(batch.column(text))
            old = [batch.column(f"_{n}{k - 1}").to_pylist() for n in ("spans", "items")] if k else [[None] * len(texts)] * 2
            counts, hits, found = [], [], []
            for body, spans, ids in zip(texts, *old, strict=True):
                words = split_words(body)
                spans, ids = list(spans or []), set(ids or [])
                for tool in tools:
                    for start, items_here in tool.search(words):
                        ids |= items_here
                        if spans and spans[-2] <= start <= spans[-1]:
                            spans[-1] = max(spans[-1], start + tool.length)
                        else:
                            spans += [start, start + tool.length]
                counts.append(len(words))
                hits.append(spans)
                found.append(sorted(ids))
            if not last:
                return [pa.array(hits, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))]
            n_hit = [covered(s) for s in hits]
            return [
                pa.array(counts, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([len(f) for f in found], pa.int64()),
                pa.array(found, pa.list_(pa.string())),
                pa.array([hashlib.sha256(",".join(f).encode()).hexdigest() for f in found], pa.string()),
                pa.array([h > 0 and 20 * h >= n for h, n in zip(n_hit, counts, strict=True)], pa.bool_()),
            ]

        return work

    return make


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, with their columns alone, that are not contaminated."""
    hidden = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{options.get('text', 'text')}`").alias("_text"))
    found = find_hits(hidden, benchmark, **options | {"text": "_text"})
    return found.where(~F.col("contaminated")).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def covered(spans: list[int]) -> int:
    """How many positions the [start, end) pairs cover together."""
    total, reach = 0, -1
    for start, end in sorted(zip(spans[::2], spans[1::2], strict=True)):
        start = max(start, reach)
        if end > start:
            total += end - start
            reach = end
    return total
