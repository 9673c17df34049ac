"""N-gram Jaccard join with adaptive multi-match prefixes, and its components.

Two documents link when the Jaccard similarity of their sets of word shingles
reaches ``percent`` of 100.  Documents with equal sets form one class and are
handled as one.

1.  *Frequencies.*  Every shingle meets its namesakes once, in buckets of the
    hash; each block of documents gets back which of its shingles occur
    elsewhere and how often.  A class of which fewer than ``percent`` of 100
    shingles occur elsewhere can't link and is done.
2.  *Prefixes.*  The rest put their shingles in one global order, rare ones
    first.  A linked pair shares ``need`` shingles within the first ``n -
    ceil(n * percent / 100) + need`` of either.  Each class chooses the need
    for which the estimated cost of its postings and of its candidates (by the
    frequencies of the shingles) is least; a pair must share the smaller need
    of the two.
3.  *Hot shingles* (in more than ``small`` classes) come last in the order, so
    only a class that is nearly made of them keeps some in its prefix; its need
    is one.  Their postings are never paired off: they are split by salt, every
    member of a split meets a hub, the hubs of ``chunk`` members meet the
    first.  Where a posting list still reaches into several components, one
    member of each meets the list's hub, for ``hub_rounds`` at most, and what
    stays apart then is compared in blocks, each pair that sizes and sketches
    allow.  So each pair with a shared prefix shingle is either verified, or
    connected already, or known not to link.
4.  *Verification* intersects the whole sets, of which only shingles that occur
    elsewhere matter.

Names: a class is told by 128 bits of hash; shingles by 40 bits and their
bucket, so that two shingles of a verified pair are taken for one with a chance
of n * n / 2**46 or less for sets of n.

Scale: the texts don't move.  All shingles are shuffled once, packed, sorted
and delta-coded; those that occur elsewhere return once.  A block sends a
shingle's owners to its bucket only up to ``local_owners``, more are counted
where they are.  Nothing is broadcast by hand, only counts reach the driver, and
every table in between lies in the shared folder until it isn't needed.  The
blocks' names come from the documents in them, so the plan of ``docs`` must
give each task the same rows when it runs again, as scans do; otherwise the
job stops and says so.

Edge cases: null, empty and blank texts have no shingles, no links, and are
their own component; shorter texts than a shingle have one, the whole text;
null ids link like others but never name a component, unless all its ids are
null; rows repeated are each returned; an empty table gives no rows; extra
columns are not touched.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, apply_arrow, binary_list, map_arrow
from .hashing import U64, Hasher, hashed, mix

_LOW = U64((1 << 40) - 1)
_ALONE = 0xFFFF


def shingle_sets(texts: list[bytes | None], words: int, hasher: Hasher) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    for _, (w,) in hashed(texts, [hasher]):
        if len(w) == 0:
            yield np.empty(0, U64)
        else:
            yield np.unique(hasher.runs(w, min(words, len(w))))


def class_of(tokens: np.ndarray) -> bytes:
    """A name of 128 bits for a set."""
    halves = [np.add.reduce(mix(tokens ^ U64(k))) ^ U64(len(tokens)) for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return mix(np.array(halves, U64)).tobytes()


def prefix_size(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def pack(keys: np.ndarray) -> bytes:
    """Sorted numbers of 40 bits as differences, byte by byte, so that the next compressor finds the zeros."""
    steps = np.diff(keys.astype("<u8"), prepend=np.zeros(1, "<u8"))
    return steps.view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()


def unpack(data) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(5, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :5] = planes.T
    return np.cumsum(wide.view("<u8").ravel(), dtype=U64)


def starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where runs of equal entries start."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in sorted_columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def code(df) -> np.ndarray:
    """Frequencies in a byte: exact below 200, powers of two above."""
    df = np.maximum(np.asarray(df, np.float64), 1)
    return np.where(df < 200, df, np.minimum(255, 200 + np.floor(np.log2(np.maximum(df, 200) / 200)))).astype(np.uint8)


def uncode(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.int64)
    return np.where(c < 200, c, 200 * 2 ** np.maximum(0, c - 200))


def best_need(df: np.ndarray, take: int, n: int, small: int) -> int:
    """How many prefix shingles to ask for, when ``df`` are the frequencies in order and ``take`` of them make the shortest prefix.

    The cost is four units for a posting and n for a candidate, of which there
    are at most the entries in the posting lists by the need.
    """
    cheap = int(np.searchsorted(df, small, side="right"))
    if take > cheap:
        return 1
    need = np.arange(1, cheap - take + 2)
    candidates = np.cumsum(df[:cheap].astype(np.int64) - 1)[take - 1 :] / need
    return int(np.argmin(4.0 * (take + need - 1) + n * candidates)) + 1


class Join:
    def __init__(self, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75, small: int = 12, hub_rounds: int = 1, chunk: int = 512, split: int = 4096, local_owners: int = 64, bucket_bytes: int = 8 << 20, block_shingles: int = 1 << 20, one_task: int = 1 << 22, seed: int = 1):
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
        self.words, self.percent, self.small, self.hub_rounds, self.chunk, self.split = words, percent, small, hub_rounds, chunk, split
        self.local_owners, self.block_shingles, self.one_task, self.seed = min(local_owners, _ALONE - 1), block_shingles, one_task, seed
        size = self.docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
        self.rows, self.buckets = size["n"], max(8, math.ceil(size["b"] / bucket_bytes))
        self.space = Workspace(self.spark, "jaccard")

    # Sets and frequencies

    def members(self) -> DataFrame:
        """doc_id, mark (MD5 of the text), n, class (null without shingles): one row for each document."""
        words, seed = self.words, self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = Hasher(seed, lower=True)
            for batch in batches:
                sets = list(shingle_sets(binary_list(batch.column("text")), words, hasher))
                names = [class_of(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary())], names=["doc_id", "mark", "n", "class"])

        kind = dict(self.docs.dtypes)["doc_id"]
        rows = self.docs.select("doc_id", F.md5("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
        return map_arrow(rows, run, f"doc_id {kind}, mark string, n bigint, class binary")

    def blocks(self) -> DataFrame:
        """What blocks of documents send: rows for the buckets (key from 0), and one for the block itself (key below 0).

        To a bucket: low (the shingles, sorted and packed), own (the place of
        the owner in the block, or 65535 for a shingle with many owners), many
        (how many).  To itself: low and own of the shingles with many owners,
        many (their estimated frequency, coded), classes, sizes and the number
        of rows that buckets got.
        """
        words, seed, buckets, limit, local, rows = self.words, self.seed, U64(self.buckets), self.block_shingles, self.local_owners, self.rows
        names = ("key", "block", "low", "own", "many", "classes", "sizes", "pieces")
        types = (pa.int64(), *[pa.binary()] * 6, pa.int64())

        def flush(kept: dict[bytes, np.ndarray], ordinal: int) -> pa.RecordBatch:
            sizes = np.array([len(s) for s in kept.values()], "<u4")
            tokens, own = np.concatenate(list(kept.values())), np.repeat(np.arange(len(sizes), dtype="<u2"), sizes)
            keys = (tokens >> U64(40)) % buckets << U64(40) | tokens & _LOW
            order = np.argsort(keys, kind="stable")
            keys, own = keys[order], own[order]
            first = starts(keys)
            times = np.diff(first, append=len(keys))
            heavy = np.repeat(times > local, times)
            sent = np.zeros(len(keys), bool)
            sent[first] = True
            sent |= ~heavy
            task = TaskContext.get().partitionId()
            block = hashlib.md5(b"".join([*kept, b"%d %d" % (task, ordinal)])).digest()
            out = []
            k, o, alone = keys[sent], np.where(heavy, _ALONE, own)[sent].astype("<u2"), np.repeat(times, times)[sent]
            top = (k >> U64(40)).astype(np.int64)
            at = starts(top)
            for lo, hi in zip(at, [*at[1:], len(top)], strict=True):
                part = slice(lo, hi)
                out.append((int(top[lo]), block, pack(k[part] & _LOW), o[part].tobytes(), alone[part][o[part] == _ALONE].astype("<u4").tobytes(), None, None, None))
            share = rows / len(sizes)  # what a block holds, times the number of such blocks
            out.append((-1 - int.from_bytes(block[:7], "big"), block, keys[heavy].astype("<u8").tobytes(), own[heavy].tobytes(), code(np.repeat(times, times)[heavy] * share).tobytes(), b"".join(kept), sizes.tobytes(), len(out)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=list(names))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, kept, held, ordinal = Hasher(seed, lower=True), {}, 0, 0
            for batch in batches:
                for s in shingle_sets(binary_list(batch.column("text")), words, hasher):
                    if len(s) and (name := class_of(s)) not in kept:
                        kept[name] = s
                        held += len(s)
                        if held > limit or len(kept) == _ALONE:
                            yield flush(kept, ordinal)
                            kept, held, ordinal = {}, 0, ordinal + 1
            if kept:
                yield flush(kept, ordinal)

        return map_arrow(self.docs.select("text"), run, "key bigint, block binary, low binary, own binary, many binary, classes binary, sizes binary, pieces bigint")

    def replies(self, blocks: DataFrame) -> DataFrame:
        """To each block, from each bucket it wrote to: low, own and df (coded) of the shingles that occur elsewhere; and its own row."""

        def count(group: pa.Table) -> pa.Table:
            key = group.column("key")[0].as_py()
            if key < 0:
                return group.rename_columns({"many": "df"})
            low = [unpack(x.as_buffer()) for x in group.column("low")]
            own = [np.frombuffer(x.as_buffer(), "<u2") for x in group.column("own")]
            sizes = [len(x) for x in low]
            all_low, weight = np.concatenate(low), np.ones(sum(sizes), np.int64)
            weight[np.concatenate(own) == _ALONE] = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in group.column("many")])
            order = np.argsort(all_low, kind="stable")
            first = starts(all_low[order])
            df = np.add.reduceat(weight[order], first) if len(first) else weight
            coded = np.empty(len(all_low), np.uint8)
            coded[order] = np.repeat(code(df), np.diff(first, append=len(order)))
            out = []
            for x, o, c in zip(low, own, np.split(coded, np.cumsum(sizes)[:-1]), strict=True):
                keep = (c > 1) & (o != _ALONE)
                out.append((pack(x[keep]), o[keep].tobytes(), c[keep].tobytes()))
            low, own, df = (pa.array(c, pa.binary()) for c in zip(*out, strict=True))
            return pa.table([group.column("key"), group.column("block"), low, own, df, *[group.column(c) for c in ("classes", "sizes", "pieces")]], names=["key", "block", "low", "own", "df", "classes", "sizes", "pieces"])

        return apply_arrow(blocks, ["key"], count, "key bigint, block binary, low binary, own binary, df binary, classes binary, sizes binary, pieces bigint")

    def candidates(self, replies: DataFrame) -> DataFrame:
        """class, n, tokens, df, sketch: each class of which enough shingles occur elsewhere, with those in the global order, their frequencies (coded), and how many of them fall to each of 128 hash cells (null if too many for a byte).

        A class that is in several blocks comes several times.
        """
        percent, small = self.percent, self.small

        def gather(group: pa.Table) -> pa.Table:
            tokens, own, df, header = [], [], [], None
            for r in range(group.num_rows):
                key, low = group.column("key")[r].as_py(), group.column("low")[r].as_buffer()
                if key < 0:
                    header = r
                    tokens.append(np.frombuffer(low, "<u8"))
                else:
                    tokens.append(unpack(low) | U64(key << 40))
                own.append(np.frombuffer(group.column("own")[r].as_buffer(), "<u2"))
                df.append(np.frombuffer(group.column("df")[r].as_buffer(), np.uint8))
            if header is None or group.column("pieces")[header].as_py() != group.num_rows - 1:
                raise RuntimeError("a task got other rows when it ran again: write docs to a table first")
            sizes = np.frombuffer(group.column("sizes")[header].as_buffer(), "<u4").astype(np.int64)
            names = group.column("classes")[header].as_py()
            tokens, own, df = np.concatenate(tokens), np.concatenate(own), np.concatenate(df)
            order = np.lexsort((tokens, np.minimum(df, small + 1), own))
            tokens, own, df = tokens[order], own[order], df[order]
            shared = np.bincount(own, minlength=len(sizes))
            ends = np.cumsum(shared)
            out = {c: [] for c in ("class", "n", "tokens", "df", "sketch")}
            for i in np.flatnonzero((100 * shared >= percent * sizes) & (shared > 0)):
                part = slice(ends[i] - shared[i], ends[i])
                cells = np.bincount((mix(tokens[part]) >> U64(57)).astype(np.int64), minlength=128)
                for c, v in zip(out, (names[16 * i : 16 * i + 16], int(sizes[i]), tokens[part].tobytes(), df[part].tobytes(), cells.astype(np.uint8).tobytes() if cells.max() < 256 else None), strict=True):
                    out[c].append(v)
            return pa.table([pa.array(v, pa.int64() if c == "n" else pa.binary()) for c, v in out.items()], names=list(out))

        return apply_arrow(replies, ["block"], gather, "class binary, n bigint, tokens binary, df binary, sketch binary")

    # Candidate pairs

    def postings(self, sets: DataFrame) -> DataFrame:
        """key, and packed: token, salt, c, n, need, open (whether other splits of the list exist) of prefix shingles."""
        percent, small, split, groups = self.percent, self.small, self.split, self.buckets
        kinds = {"token": "<u8", "salt": "<u4", "c": "<i8", "n": "<u4", "need": "<u4", "open": np.uint8}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cols = {k: [] for k in kinds}
                for c, n, t, d in zip(batch.column("c").to_pylist(), batch.column("n").to_pylist(), batch.column("tokens"), batch.column("df"), strict=True):
                    t, d = np.frombuffer(t.as_buffer(), "<u8"), np.frombuffer(d.as_buffer(), np.uint8)
                    take = prefix_size(n, percent) - (n - len(t))
                    need = best_need(np.minimum(d, small + 1), take, n, small)
                    t, d = t[: take + need - 1], d[: take + need - 1]
                    parts = np.maximum(1, -(-uncode(d) // split))
                    salt = mix(np.array([c], np.int64).view(U64))[0] % parts.astype(U64)
                    for k, v in zip(kinds, (t, salt, c, n, need, parts > 1), strict=True):
                        cols[k].append(np.broadcast_to(v, len(t)).astype(kinds[k]))
                if not cols["token"]:
                    continue
                cols = {k: np.concatenate(v) for k, v in cols.items()}
                key = (mix(cols["token"] + cols["salt"].astype(U64) * U64(0x9E3779B97F4A7C15)) % U64(groups)).astype(np.int64)
                order = np.argsort(key, kind="stable")
                key, cols = key[order], {k: v[order] for k, v in cols.items()}
                at = starts(key)
                ends = [*at[1:], len(key)]
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), *[pa.array([v[lo:hi].tobytes() for lo, hi in zip(at, ends, strict=True)], pa.binary()) for v in cols.values()]], names=["key", *cols])

        return map_arrow(sets.select("c", "n", "tokens", "df"), run, "key bigint, " + ", ".join(f"{k} binary" for k in kinds))

    def met(self, postings: DataFrame) -> DataFrame:
        """Pairs a < b with the number of prefix shingles they share and the need; and, with need 0, the entries of long lists: a the shingle, b the class, shared its size."""
        small, chunk, percent = self.small, self.chunk, self.percent
        kinds = {"token": "<u8", "salt": "<u4", "c": "<i8", "n": "<u4", "need": "<u4", "open": np.uint8}

        def meet(group: pa.Table) -> pa.Table:
            token, salt, c, n, need, is_open = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in group.column(k)]) for k, t in kinds.items())
            order = np.lexsort((c, salt, token))
            token, salt, c, n, need, is_open = token[order], salt[order], c[order], n[order].astype(np.int64), need[order].astype(np.int64), is_open[order]
            first = starts(token, salt)
            size = np.diff(first, append=len(token))
            pairs = []
            for m in np.unique(size[(size > 1) & (size <= small)]):
                at = first[size == m][:, None] + np.arange(m)
                i, j = np.triu_indices(m, 1)
                pairs.append((at[:, i].ravel(), at[:, j].ravel()))
            rank = np.arange(len(token)) - np.repeat(first, size)
            in_long = np.repeat(size > small, size)
            whole = np.repeat(first, size)
            hub = whole + rank // chunk * chunk
            hub = np.where(rank % chunk == 0, whole, hub)
            members = np.flatnonzero(in_long & (rank > 0))
            pairs.append((hub[members], members))
            i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
            fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            i, j = i[fits], j[fits]
            a, b, k = c[i], c[j], np.minimum(need[i], need[j])
            order = np.lexsort((b, a))
            a, b, k = a[order], b[order], k[order]
            at = starts(a, b)
            listed = np.flatnonzero(in_long | (is_open > 0))
            least = np.minimum.reduceat(k, at) if len(at) else k
            return pa.table({"a": np.concatenate([a[at], token[listed].view(np.int64)]), "b": np.concatenate([b[at], c[listed]]), "shared": np.concatenate([np.diff(at, append=len(a)), n[listed]]), "need": np.concatenate([least, np.zeros(len(listed), np.int64)])})

        return apply_arrow(postings, ["key"], meet, "a bigint, b bigint, shared bigint, need bigint")

    # Verification

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs that link."""
        percent = self.percent
        sides = (sets.select(F.col("c").alias(s), F.col("n").alias(f"n_{s}"), F.col("tokens").alias(f"t_{s}")) for s in "ab")
        both = pairs
        for s, side in zip("ab", sides, strict=True):
            both = both.join(side.join(pairs.select(s).distinct(), s, "left_semi"), s)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for m, n, x, y in zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), batch.column("t_a"), batch.column("t_b"), strict=True):
                    both = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")]))
                    inter = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * inter >= percent * (m + n - inter))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

        return map_arrow(both.select("a", "b", "n_a", "n_b", "t_a", "t_b"), run, "a bigint, b bigint")

    # Long lists

    def _open(self, lists: DataFrame, labels: DataFrame, k: int) -> DataFrame:
        """key, c, n, root of the long lists that reach into several components; of lists with the same members one stays."""
        rooted = lists.join(labels.select(F.col("v").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
        same = [F.sum(F.xxhash64("c", F.lit(i)).cast("decimal(20,0)")).alias(f"h{i}") for i in (0, 1)]
        keys = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m"), *same).where("lo < hi")
        # Their names are a table of their own, which Spark broadcasts if it is small.
        keys = self.space.store(f"keys{k}", keys.groupBy("m", "h0", "h1").agg(F.min("key").alias("key")).select("key"))
        return self.space.store(f"open{k}", rooted.join(keys, "key", "left_semi").select("key", "c", "n", "root"))

    def _hub_pairs(self, rows: DataFrame, k: int) -> DataFrame:
        """One member of each component in a list, paired with that of the component that holds most of the list."""
        pick = F.min(F.struct(F.xxhash64("c", F.lit(k)).alias("h"), "c", "n"))
        heads = rows.groupBy("key", "root").agg(pick.alias("s"), F.count(F.lit(1)).alias("m")).select("key", "root", "s.c", "s.n", "m")
        hubs = heads.groupBy("key").agg(F.max(F.struct("m", F.xxhash64("root", F.lit(k)), "root", "c", "n")).alias("s")).select("key", F.col("s.root").alias("root2"), F.col("s.c").alias("c2"), F.col("s.n").alias("n2"))
        pairs = heads.join(hubs, "key").where("root != root2").where(f"100 * least(n, n2) >= {self.percent} * greatest(n, n2)")
        return pairs.select(F.least("c", "c2").alias("a"), F.greatest("c", "c2").alias("b")).distinct()

    def _cross_pairs(self, rows: DataFrame, sets: DataFrame, block: int = 512, first: int = 64) -> DataFrame:
        """a < b: the members of a list that are in different components and that sizes and sketches let link.

        The component that holds most of a list is not compared with itself:
        its members meet the others only, block by block.  A pair that meets
        in several lists is told in the first of them, as far as the ``first``
        smallest lists of each class tell.
        """
        percent = self.percent
        most = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max(F.struct("m", "root")).alias("s"), F.sum("m").alias("all"))
        low = rows.groupBy("c").agg(F.slice(F.sort_array(F.collect_list("key")), 1, first).alias("low"))
        most = self.space.store("most", most.select("key", F.col("s.root").alias("main"), F.ceil(F.col("s.m") / block).alias("mains"), F.ceil((F.col("all") - F.col("s.m")) / block).alias("others")))
        place = F.xxhash64("c", F.lit(7))
        rows = rows.join(most, "key").withColumn("is_main", F.col("root") == F.col("main"))
        rows = rows.withColumn("at", F.when(F.col("is_main"), -1 - F.pmod(place, F.col("mains"))).otherwise(F.pmod(place, F.col("others"))))
        others, mains = F.sequence(F.lit(0).cast("bigint"), F.col("others") - 1), F.sequence(-F.col("mains"), F.lit(-1).cast("bigint"))
        rows = rows.withColumn("with", F.explode(F.when(F.col("is_main"), others).otherwise(F.concat(mains, others))))
        rows = rows.join(sets.select("c", "sketch").join(low, "c"), "c").select("key", F.least("at", "with").alias("lo"), F.greatest("at", "with").alias("hi"), "at", "c", "n", "root", "sketch", "low")

        def compare(group: pa.Table) -> pa.Table:
            at, lo, c, n, root = (group.column(x).to_numpy() for x in ("at", "lo", "c", "n", "root"))
            full = np.array([255 * 128 if x is None else 0 for x in group.column("sketch").to_pylist()])
            cells = np.array([np.frombuffer(x, np.uint8) if x is not None else np.full(128, 255, np.uint8) for x in group.column("sketch").to_pylist()])
            key, low, out = group.column("key")[0].as_py(), [set(x) for x in group.column("low").to_pylist()], []
            one = np.flatnonzero(at == lo)
            other = one if group.column("hi")[0].as_py() == lo[0] else np.flatnonzero(at != lo)
            for i in one:
                j = other[(root[other] != root[i]) & (100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i]))]
                common = np.minimum(cells[j], cells[i]).sum(axis=1, dtype=np.int64)
                ok = ((100 + percent) * common >= percent * (n[j] + n[i])) | (full[j] > 0) | (full[i] > 0)
                j = np.array([x for x in j[ok].tolist() if min(low[i] & low[x], default=key) == key], np.int64)
                out.append(np.stack([np.minimum(c[i], c[j]), np.maximum(c[i], c[j])]))
            a, b = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.empty((2, 0), np.int64)
            return pa.table({"a": a, "b": b})

        return apply_arrow(rows, ["key", "lo", "hi"], compare, "a bigint, b bigint").distinct()

    # All together

    def run(self) -> DataFrame:
        """doc_id, mark, n_shingles, class, root (names the component; null without shingles), component_id."""
        space = self.space
        members = space.store("members", self.members())
        found = self.candidates(self.replies(self.blocks()))
        one = found.groupBy("class").agg(F.first(F.struct("n", "tokens", "df", "sketch")).alias("s")).select("class", "s.*")
        sets = space.store("sets", one.withColumn("c", F.monotonically_increasing_id()))
        met = space.store("met", self.met(self.postings(sets)))
        pairs = met.where("need > 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need")).where("shared >= need").select("a", "b")
        pairs = space.store("pairs", pairs)
        links = space.store("links", self.verified(pairs, sets))
        labels = components(links, self.one_task, space, "labels")
        lists = met.where("need = 0").select(F.col("a").alias("key"), F.col("b").alias("c"), F.col("shared").alias("n"))
        for k in range(self.hub_rounds + 1):
            rows = self._open(lists, labels, k)
            if rows.isEmpty():
                break
            more = self._hub_pairs(rows, k) if k < self.hub_rounds else self._cross_pairs(rows, sets)
            more = space.store(f"pairs{k}", more.join(pairs, ["a", "b"], "left_anti"))
            links = links.unionByName(space.store(f"links{k}", self.verified(more, sets)))
            pairs = pairs.unionByName(more)
            labels = components(links, self.one_task, space, f"labels{k}")
        out = space.store("result", self._result(members, sets, labels))
        space.keep("result")
        return out

    @staticmethod
    def _result(members: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
        classes = members.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
        linked = sets.select("class", F.col("c").alias("v")).join(labels, "v").join(classes, "class").select("class", F.col("root").cast("string").alias("root"), "least")
        # A component may hold a large part of all classes: its name goes to several parts of them.
        part = F.pmod(F.xxhash64("class"), F.lit(16))
        names = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint"))))
        named = linked.withColumn("part", part).join(names, ["root", "part"]).select("class", "root", "component_id")
        alone = classes.join(linked.select("class"), "class", "left_anti").select("class", F.hex("class").alias("root"), F.col("least").alias("component_id"))
        out = members.join(named.unionByName(alone), "class", "left")
        return out.select("doc_id", "mark", F.col("n").alias("n_shingles"), "class", "root", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of a graph and the least vertex that each is connected with."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        x, y = root[i], root[j]
        if (x == y).all():
            return names, names[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as v, root; at no time more of them than vertices and a batch."""
    v, root = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        a, b = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((v, root)))
        v, root = _forest(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(root)], names=["v", "root"])


def components(links: DataFrame, one_task: int, space: Workspace, name: str) -> DataFrame:
    """v, root: the least member of each linked vertex's component.

    Up to ``one_task`` links fit one task.  More are first contracted in parts of that
    size, then by alternating large and small stars until nothing changes.
    """
    n = links.count()
    parts = links.coalesce(1) if n <= one_task else links.repartition(-(-n // one_task), "a")
    edges = space.store(name, map_arrow(parts, _contracted, "v bigint, root bigint"))
    if n <= one_task:
        return edges
    edges = edges.select(F.col("v").alias("u"), F.col("root").alias("v")).where("u != v").distinct()
    before, k = None, 0
    while True:
        # Large star: every larger neighbour moves to the least neighbour.
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        # Small star: every vertex and its smaller neighbours move to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = space.store(f"{name}-{k}", small.where("u != v").distinct())
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        if k > 0:
            space.drop(f"{name}-{k - 1}")
        before, k = now, k + 1
    return edges.select(F.col("u").alias("v"), F.col("v").alias("root")).union(edges.select("v", F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: doc_id, mark (MD5 of the text), n_shingles, class, root, component_id."""
    return Join(docs, **options).run()


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs, with their columns alone, that stay: of each component the row with the smallest id (then the smallest MD5), and every text without shingles."""
    found = near_duplicates(docs, doc_id=doc_id, text=text, **options)
    space = Workspace(docs.sparkSession, "kept")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark"))
    linked = found.where("class is not null")
    kept = linked.groupBy("root").agg(first.alias("s")).select("s.doc_id", "s.mark")
    bare = found.where("class is null").select("doc_id", "mark").distinct()
    kept = space.store("kept", kept.unionByName(bare))
    hidden = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), _row_key(F.col(f"`{doc_id}`"), F.md5(f"`{text}`")).alias("_key"))
    chosen = hidden.join(kept.select(_row_key(F.col("doc_id"), F.col("mark")).alias("_key")), "_key", "left_semi")
    # A row that is repeated has the same key; only one of them stays.
    repeated = linked.groupBy("doc_id", "mark").count().where("count > 1").select(_row_key(F.col("doc_id"), F.col("mark")).alias("_key"))
    repeated = space.store("repeated", repeated)
    if not repeated.isEmpty():
        several = chosen.join(repeated, "_key", "left_semi").groupBy("_key").agg(F.first("_row").alias("_row")).select("_row", "_key")
        chosen = chosen.join(repeated, "_key", "left_anti").unionByName(several)
    return chosen.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def _row_key(doc_id, mark):
    return F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(mark, F.lit("null")))
