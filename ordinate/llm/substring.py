"""Substring deduplication on a compacted De Bruijn graph of words.

Every window of ``k`` consecutive words is an edge between its first and its
last k - 1 words.  Edges that stand in one document only are left out early: of
each group of documents only a few hash bits of each edge travel, sorted and
delta-coded, and a bit for each comes back that tells whether another group has
it too.  What is left travels with a 96-bit name and the coordinates (document,
position) of its first occurrence in the group; the join of equal edges gives
each the coordinates of its first occurrence of all, its source.

Edges of a document whose sources advance in step form one nonbranching path: a
branch would send the next edge to another source.  Each such path compacts to
one span (start, length, source document, source position).  The step by step
agreement with the source's coordinates is what verifies a long span; it rests
on 96 bits for every edge in it.

A word is removed if a window that covers it has its source in a document with a
smaller id.

Scale: texts move once, to groups of about ``group_bytes``, and the three passes
over the groups share that shuffle.  Within a group equal edges are merged
before they move, so a passage or document that is repeated without end adds at
most one entry a group.  If rows share ids, the rows are dealt by partition as
well, so that an id repeated without end spreads over groups, and laid down once.

Edge cases: null and blank texts have no words; texts of fewer than k words have
no window; rows of one id never remove each other's words; a null id counts as
larger than any other, so its words can be removed but it is no source (nor is
the largest id there can be, 2**63 - 1); repeated rows are each returned; an
empty table gives no rows; extra columns are not touched.  Ids are integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, binary_list, checkpointed, ship
from .hashing import U64, Hasher, hashed

_LOW = U64(0xFFFFFFFF)
_LAST = np.iinfo(np.int64).max
_RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string, spans array<struct<start:int,words:int,source:bigint,source_start:int>>"


def pack(keys: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as differences, byte by byte, so that the next compressor finds the zeros."""
    steps = np.diff(keys.astype(np.uint32), prepend=np.uint32(0)).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(data) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def short(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket number and 32 further bits: what stands for a window where repeats are sought."""
    return ((tokens >> U64(32)) % U64(buckets) << U64(32)) | (tokens & _LOW)


def stretches(starts: np.ndarray, end: int) -> list[slice]:
    """From each start to the next one, the last to the end."""
    edges = [*starts.tolist(), end] if len(starts) else []
    return [slice(lo, hi) for lo, hi in zip(edges, edges[1:], strict=False)]


def by_bucket(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The stretches of sorted short keys that share a bucket."""
    top = (keys >> U64(32)).astype(np.int64)
    for s in stretches(np.flatnonzero(np.diff(top, prepend=-1)), len(top)):
        yield int(top[s.start]), s


class Windows:
    """All windows of a group's documents: full names, the document and the position of each."""

    def __init__(self, group: pa.Table, k: int, seeds: tuple[int, ...]):
        texts = binary_list(group.column("text").combine_chunks()) if group.num_rows else []
        ids = np.array([x if x is not None else _LAST for x in group.column("doc_id").to_pylist()], np.int64)
        # Documents in the order of their ids: of equal windows the first one by number is then the first occurrence.
        self.order = np.argsort(ids, kind="stable")
        ids = ids[self.order]
        self.texts = [texts[i] for i in self.order]
        tools = [Hasher(s) for s in seeds]
        names, counts = [[] for _ in tools], []
        self.n_words = np.zeros(len(ids), np.int64)
        for i, words in hashed(self.texts, tools):
            self.n_words[i] = len(words[0])
            for out, tool, w in zip(names, tools, words, strict=True):
                out.append(tool.runs(w, k))
            counts.append(len(names[0][-1]))
        counts = np.array(counts, np.int64)
        self.names = [np.concatenate([np.empty(0, U64), *n]) for n in names]
        self.row = np.repeat(np.arange(len(ids)), counts)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.place = np.arange(len(self.row)) - self.first[self.row]
        self.ids = ids
        self.doc = self.ids[self.row]

    def runs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The given windows in order of their names, where each run of equal ones starts, and the first occurrence of each run."""
        order = at[np.argsort(self.names[0][at])]
        one, two = self.names[0][order], self.names[1][order] & _LOW
        fresh = np.ones(len(order), bool)
        fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        starts = np.flatnonzero(fresh)
        return order, starts, np.minimum.reduceat(order, starts) if len(starts) else order


def _rare(windows: Windows, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct short names in order, and for each window which of them it has."""
    return np.unique(short(windows.names[0], buckets), return_inverse=True)


def dedup_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 13, group_bytes: int = 4 << 20, bucket_bytes: int = 16 << 20, seed: int = 3, keep_text: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256, kept (text, if keep_text), spans."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    groups, buckets = max(8, math.ceil(size / group_bytes)), max(16, math.ceil(size / bucket_bytes))
    # A document's group follows from its id. Rows of one id are dealt by partition too, and laid down, as that may change when a plan runs again.
    alike = not rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    place = [F.spark_partition_id()] if alike else []
    grouped = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", *place), F.lit(groups)).cast("int"))
    grouped = checkpointed(grouped) if alike else grouped
    seeds = (seed, seed + 1)

    def tell(group: pa.Table) -> pa.Table:
        keys = np.unique(short(Windows(group, k, seeds[:1]).names[0], buckets))
        found = list(by_bucket(keys))
        g = group.column("g")[0].as_py()
        return pa.table({"bucket": pa.array([b for b, _ in found], pa.int32()), "g": pa.array([g] * len(found), pa.int32()), "low": pa.array([pack(keys[s] & _LOW) for _, s in found], pa.binary())})

    def shared(group: pa.Table) -> pa.Table:
        parts = [unpack(x.as_buffer()) for x in group.column("low")]
        everything = np.sort(np.concatenate(parts))
        twice = np.unique(everything[1:][everything[1:] == everything[:-1]])
        out = [np.packbits(_within(p, twice)).tobytes() for p in parts]
        return pa.table({"g": group.column("g"), "bucket": group.column("bucket"), "bits": pa.array(out, pa.binary())})

    def edges(group: pa.Table, replies: pa.Table) -> pa.Table:
        """The group's edges that stand in several documents, with their first occurrence here."""
        w = Windows(group, k, seeds)
        keys, which = _rare(w, buckets)
        live = np.zeros(len(keys), bool)
        bits = dict(zip(replies.column("bucket").to_pylist(), replies.column("bits"), strict=True))
        for b, s in by_bucket(keys):
            if b in bits:
                live[s] = np.unpackbits(np.frombuffer(bits[b].as_buffer(), np.uint8), count=s.stop - s.start).astype(bool)
        _, _, at = w.runs(np.flatnonzero(live[which]))
        k1, k2 = w.names[0][at], w.names[1][at] & _LOW
        bucket = (k1 >> U64(40)) % U64(buckets)
        order = np.argsort(bucket, kind="stable")
        at, k1, k2, bucket = at[order], k1[order], k2[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
        found = stretches(cuts, len(at))
        doc, place = w.doc[at], w.place[at].astype("<u4")
        g = group.column("g")[0].as_py() if group.num_rows else 0
        return pa.table(
            {"bucket": pa.array([int(bucket[s.start]) for s in found], pa.int32()), "g": pa.array([g] * len(found), pa.int32())}
            | {n: pa.array([_planes(v[s]) for s in found], pa.binary()) for n, v in (("k1", k1), ("k2", k2.astype("<u4")), ("doc", doc), ("place", place))}
        )

    def sources(group: pa.Table) -> pa.Table:
        """For each group the edges whose first occurrence of all is in a smaller document elsewhere, with its coordinates."""
        col = {n: [_unplanes(x.as_buffer(), t) for x in group.column(n)] for n, t in (("k1", "<u8"), ("k2", "<u4"), ("doc", "<i8"), ("place", "<u4"))}
        sizes = [len(x) for x in col["k1"]]
        k1, k2, doc, place = (np.concatenate(col[n]) for n in ("k1", "k2", "doc", "place"))
        part = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((place, doc, k2, k1))
        first = np.ones(len(order), bool)
        first[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
        starts = np.flatnonzero(first)
        source = order[np.repeat(starts, np.diff(starts, append=len(order)))]
        better = doc[source] < doc[order]
        mine, source = order[better], source[better]
        back = np.argsort(mine)  # parts in order, each part's edges by name
        mine, source = mine[back], source[back]
        cuts = np.searchsorted(part[mine], np.arange(len(sizes) + 1))
        out = {n: pa.array([_planes(v[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)], pa.binary()) for n, v in (("k1", k1[mine]), ("k2", k2[mine]), ("doc", doc[source]), ("place", place[source]))}
        return pa.table({"g": group.column("g")} | out)

    def compacted(group: pa.Table, replies: pa.Table) -> pa.Table:
        w = Windows(group, k, seeds)
        k1, k2 = w.names[0], w.names[1] & _LOW
        # First occurrence within the group, then what other groups know.
        order, starts, heads = w.runs(np.arange(len(k1)))
        lead = np.repeat(heads, np.diff(starts, append=len(order)))
        source, place = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        source[order], place[order] = w.doc[lead], w.place[lead]
        if replies.num_rows:
            r1, r2, rd, rp = (np.concatenate([_unplanes(x.as_buffer(), t) for x in replies.column(n)]) for n, t in (("k1", "<u8"), ("k2", "<u4"), ("doc", "<i8"), ("place", "<u4")))
            by_name = np.lexsort((r2, r1))
            r1, r2, rd, rp = r1[by_name], r2[by_name].astype(U64), rd[by_name], rp[by_name]
            # Both sides in order of their names: one merge.
            lo, hi = np.searchsorted(r1, k1[heads]), np.searchsorted(r1, k1[heads], "right")
            for step in range(int((hi - lo).max(initial=0))):
                here = np.flatnonzero(lo + step < hi)
                at = (lo + step)[here]
                here, at = here[r2[at] == k2[heads[here]]], at[r2[at] == k2[heads[here]]]
                value = np.full(len(starts), -1, np.int64)
                value[here] = at
                spread = np.repeat(value, np.diff(starts, append=len(order)))
                hit = order[spread >= 0]
                source[hit], place[hit] = rd[spread[spread >= 0]], rp[spread[spread >= 0]]
        copied = source < w.doc
        n, removed, digest, kept, spans = [], [], [], [], []
        for i, body in enumerate(w.texts):
            words = body.split() if body else []
            span = slice(w.first[i], w.first[i + 1])
            found = paths(copied[span], source[span], place[span], k) if copied[span].any() else []
            gone = np.zeros(len(words) + 1, np.int64)
            for start, size, _, _ in found:
                gone[start] += 1
                gone[start + size] -= 1
            stays = np.cumsum(gone[:-1]) == 0
            left = b" ".join(words if not found else [x for x, ok in zip(words, stays.tolist(), strict=True) if ok])
            n.append(len(words))
            removed.append(int(len(words) - stays.sum()))
            digest.append(hashlib.sha256(left).hexdigest())
            kept.append(left if keep_text else None)
            spans.append([dict(zip(("start", "words", "source", "source_start"), x, strict=True)) for x in found])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))
        return pa.table({"doc_id": group.column("doc_id").take(pa.array(w.order)), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "spans": pa.array(spans, kind)})

    ship(docs.sparkSession)
    told = grouped.groupBy("g").applyInArrow(tell, "bucket int, g int, low binary")
    bits = told.groupBy("bucket").applyInArrow(shared, "g int, bucket int, bits binary")
    # Edges shared within one group only need no reply: the last pass sees them by itself.
    named = grouped.groupBy("g").cogroup(bits.groupBy("g")).applyInArrow(edges, "bucket int, g int, k1 binary, k2 binary, doc binary, place binary")
    known = named.groupBy("bucket").applyInArrow(sources, "g int, k1 binary, k2 binary, doc binary, place binary")
    out = grouped.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(compacted, _RESULT)
    return out if keep_text else out.drop("kept")


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte: the high bytes of small numbers then compress away."""
    width = values.dtype.itemsize
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes()


def _unplanes(data, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def paths(copied: np.ndarray, source: np.ndarray, place: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
    """Maximal runs of copied windows whose sources advance in step: (start, words, source document, its position)."""
    at = np.flatnonzero(copied)
    start = np.ones(len(at), bool)
    start[1:] = (at[1:] != at[:-1] + 1) | (source[at][1:] != source[at][:-1]) | (place[at][1:] != place[at][:-1] + 1)
    heads = np.flatnonzero(start)
    return [(int(at[s.start]), int(at[s.stop - 1] - at[s.start] + k), int(source[at[s.start]]), int(place[at[s.start]])) for s in stretches(heads, len(at))]


def repeated_paths(result: DataFrame) -> DataFrame:
    """The nonbranching paths of the repeated part of the graph: source, source_start, words, copies.

    A path ends where some copy begins or ends: there the graph branches.  All
    spans of a source meet at these places; between two neighbouring ones every
    copy goes the same way, so the windows between them are one path.  Only
    begins and ends are sorted, of which a source has no more than words.
    """
    spans = result.select(F.explode("spans").alias("s")).select("s.*")
    ends = spans.select("source", F.explode(F.array(F.struct(F.col("source_start").alias("at"), F.lit(1).alias("d")), F.struct((F.col("source_start") + F.col("words")).alias("at"), F.lit(-1).alias("d")))).alias("e")).select("source", "e.*")
    nodes = ends.groupBy("source", "at").agg(F.sum("d").alias("d"))
    along = Window.partitionBy("source").orderBy("at")
    paths = nodes.withColumn("copies", F.sum("d").over(along)).withColumn("to", F.lead("at").over(along))
    return paths.where("copies > 0").select("source", F.col("at").alias("source_start"), (F.col("to") - F.col("at")).cast("int").alias("words"), F.col("copies").cast("bigint").alias("copies"))


def compared(docs: DataFrame, result: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each span (doc_id, start, words, source, source_start) and whether it says word by word what stands at its source.

    Joins by id bring the words of both places together; only documents with spans or sources of spans move.
    """
    spans = result.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    texts = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.regexp_extract_all(F.col(f"`{text}`"), F.lit(WORD), F.lit(0)).alias("w"))
    here = spans.join(texts, F.col("doc_id") == F.col("id")).withColumn("copy", F.sha2(F.array_join(F.slice("w", F.col("start") + 1, F.col("words")), " "), 256)).drop("id", "w")
    there = here.join(texts, F.col("source") == F.col("id")).withColumn("same", F.sha2(F.array_join(F.slice("w", F.col("source_start") + 1, F.col("words")), " "), 256) == F.col("copy"))
    # Rows of one id: one of them says it.
    return there.groupBy("doc_id", "start", "words", "source", "source_start").agg(F.max("same").alias("same"))
