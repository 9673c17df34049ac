"""Toxic passages by maximum-scoring segments.

Each token has a log-odds score: how much likelier it is in toxic text than in
other text, smoothed by a Dirichlet prior that follows the corpus.  Tokens whose
log-odds are ln 4 or more either way keep them, the others share one negative
background score.  A linear scan (Ruzzo and Tompa's) finds every maximal segment
of a text.  Under the background model the segments of n tokens that score S or
more are K n e^-S in number, and the best of them follows an extreme-value law;
K is estimated from the documents that are not toxic, by counting their segments
of ln 4 or more.  The evidence of a segment is S - ln(K n); that of a document's
significant segments is summed, and a logistic curve turns it into a score from
0 to 1.

The labelled documents of the learning folds (one of each distinct text) give
the candidate tokens; all documents give the corpus frequencies that shape the
prior; then all documents are scanned.  Texts stay in place while the labels to
learn from are ``in_place`` or fewer, which are then sent to them; with more,
labelled texts meet them in one shuffle.  A token of the toxic side stands in
``least_docs`` toxic documents at least; one of the other side in as many as its
log-odds need.  The model grows with the vocabulary and is sent to the executors
whole.  The prior counts ``least_prior`` documents of each class at least, so that
a rare word's score is held down and not the word.  Candidates beyond
``handed_out`` meet their corpus frequencies by a join.  The logistic curve has two
coefficients and is fitted to about ``max_fit`` labelled documents at most, chosen by
a hash of their ids.

Edge cases: null and empty texts have no evidence and get the curve's value at
none; a null id belongs to no fold (held_out gives null), is not learnt from and
is scored like any other; rows repeated are scored each; labels repeated or in
conflict for one id count as toxic if most say so (ties do); labels of unknown
ids or null labels are passed over; without any toxic label every score is 0;
extra columns pass through, those named like an output column are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apply_arrow, arrow_columns, checkpointed, map_arrow

#: ASCII bytes that part tokens: all but letters.
_PARTS = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def tokens_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_PARTS).split() if text else []


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    background: float = -1.0
    log_k: float = 0.0
    slope: float = 1.0
    intercept: float = 0.0


def segments(hits: list[tuple[int, float]], n: int, background: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of n tokens, given the tokens that have a score of their own.

    Each stretch between hits counts as one negative item, so the scan is
    linear in the hits.
    """
    done: list[list] = []  # candidates: start, end, left sum, right sum
    total, at = 0.0, 0
    for place, weight in hits:
        total += background * (place - at)
        left, total, at = total, total + weight, place + 1
        if weight <= 0:
            continue
        current = [place, place + 1, left, total]
        while True:
            j = len(done) - 1
            while j >= 0 and done[j][2] >= current[2]:
                j -= 1
            if j < 0 or done[j][3] >= current[3]:
                done.append(current)
                break
            current = [done[j][0], current[1], done[j][2], current[3]]
            del done[j:]
    return [(s, e, right - left) for s, e, left, right in done]


def passages(text: str | None, model: Model, *, least: float = 0.0) -> tuple[int, float, list[tuple[int, int, float]]]:
    """The number of tokens, the summed evidence, and every significant segment (token start, end, evidence)."""
    tokens = tokens_of(text)
    get = model.weights.get
    hits = [(i, w) for i, w in enumerate(map(get, tokens)) if w is not None]
    if not any(w > 0 for _, w in hits):
        return len(tokens), 0.0, []
    floor = math.log(len(tokens)) + model.log_k
    found = [(s, e, score - floor) for s, e, score in segments(hits, len(tokens), model.background) if score - floor > least]
    return len(tokens), sum(x[2] for x in found), found


def learners(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, learn: Column | None) -> tuple[DataFrame, DataFrame]:
    """The rows (id, body) that may be learnt from, and (id, toxic) of those to learn from: one id for each distinct text and label."""
    toxic = F.when(F.avg(F.col(label).cast("double")) >= 0.5, 1).otherwise(0).cast("int").alias("toxic")
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(toxic)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body"))
    if learn is not None:
        rows, marks = rows.where(learn), marks.where(learn)
    named = rows.select("id", F.md5("body").alias("mark")).join(marks, "id")
    return rows, checkpointed(named.groupBy("mark", "toxic").agg(F.min("id").alias("id")).select("id", "toxic").distinct())


def _counted(df: DataFrame, known: frozenset[bytes] | None, *, least: int = 0, least_plain: int = 0, buckets: int = 1, flush_at: int = 150_000) -> DataFrame:
    """(token, toxic, plain): in how many rows of (body, toxic) a token stands, if it stands in ``least`` toxic ones or ``least_plain`` others; the empty token counts all rows.

    Tokens travel by the bucket of a checksum, many to a row, and are summed
    bucket by bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = sorted(held[0].keys() | held[1].keys(), key=lambda t: (zlib.crc32(t) % buckets, t))
            where = [zlib.crc32(t) % buckets for t in names]
            cuts = np.searchsorted(where, np.arange(buckets + 1)).astype(np.int32)
            full = np.flatnonzero(np.diff(cuts))
            ends = pa.array(np.concatenate([cuts[full], cuts[-1:]]), pa.int32())
            columns = [pa.array(names, pa.binary()), *[pa.array([c[t] for t in names], pa.int64()) for c in (held[1], held[0])]]
            for c in held:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *[pa.ListArray.from_arrays(ends, c) for c in columns]], names=["bucket", "token", "toxic", "plain"])

        for batch in batches:
            for body, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = set(tokens_of(body))
                held[toxic].update(seen if known is None else seen & known)
                held[toxic][b""] += 1
                if len(held[0]) + len(held[1]) > flush_at:
                    yield flush()
        yield flush()

    def total(group: pa.Table) -> pa.Table:
        flat = pa.table({n: group.column(n).combine_chunks().flatten() for n in ("token", "toxic", "plain")})
        summed = flat.group_by("token").aggregate([("toxic", "sum"), ("plain", "sum")]).rename_columns(["token", "toxic", "plain"])
        return summed.filter(pc.or_(pc.or_(pc.greater_equal(summed["toxic"], least), pc.greater_equal(summed["plain"], least_plain)), pc.equal(summed["token"], b"")))

    packed = map_arrow(df, count, "bucket int, token array<binary>, toxic array<bigint>, plain array<bigint>")
    return apply_arrow(packed, ["bucket"], total, "token binary, toxic bigint, plain bigint")


def log_odds(toxic, plain, n_toxic, n_plain, prior, size):
    """Difference of the classes' log-odds under a Dirichlet prior of ``size`` pseudo-documents, of which ``prior`` hold the token."""
    odds = lambda k, n: np.log(k + prior) - np.log(n + size - k - prior)
    return odds(toxic, n_toxic) - odds(plain, n_plain)


#: Log-odds from which on a token keeps its own, either way.
APART = math.log(4)


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", learn: Column | None = None, least_docs: int = 3, strength: float = 20.0, least_prior: float = 0.5, in_place: int = 1_000_000, handed_out: int = 200_000, max_fit: int = 50_000) -> Model:
    """learn: which ids may be learnt from, an expression over ``id``."""
    rows, marks = learners(docs, labels, doc_id=doc_id, text=text, label=label, learn=learn)
    marked = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = sum(marked.values()) <= in_place
    learnt = rows.join(F.broadcast(marks) if few else marks.hint("merge"), "id")
    buckets = max(16, sum(marked.values()) // 1000)
    # Fewer documents than this can't take a token's log-odds to - ln 4.
    least_plain = max(least_docs, int(1.5 * marked.get(0, 0) * min(1.0, 2 * least_prior) / max(1, marked.get(1, 0))))
    counts = checkpointed(_counted(learnt.select("body", "toxic"), None, least=least_docs, least_plain=least_plain, buckets=buckets))
    whole = counts.where("token = X''").first()
    n_toxic, n_plain = (whole["toxic"], whole["plain"]) if whole else (0, 0)
    if not n_toxic or not n_plain:
        return Model(intercept=-math.inf)
    k, expected = F.col("toxic"), (F.col("toxic") + F.col("plain")) * (n_toxic / (n_toxic + n_plain))
    candidates = counts.where((F.col("token") != F.lit(b"")) & ((k >= least_docs) & (k > expected) | (F.col("plain") >= least_plain) & (k < expected)))
    everything = docs.select(F.col(text).alias("body"), F.lit(0).alias("toxic"))
    known = frozenset(bytes(r["token"]) for r in candidates.select("token").collect()) if candidates.count() <= handed_out else None
    corpus = checkpointed(_counted(everything, known, buckets=buckets).select("token", F.col("plain").alias("all")))
    size = corpus.where("token = X''").first()["all"]
    prior = F.greatest(F.lit(strength / size) * F.coalesce("all", F.lit(0)), F.lit(least_prior))
    odds = lambda n, of: F.log(n + F.col("prior")) - F.log(F.lit(of + strength) - n - F.col("prior"))
    weighed = candidates.join(corpus, "token", "left").withColumn("prior", prior).withColumn("delta", odds(k, n_toxic) - odds(F.col("plain"), n_plain))
    # The odds alone decide which tokens stay; rounding is settled below.
    best = weighed.where(F.abs("delta") >= APART - 1e-6).orderBy("token").collect()
    names = [bytes(r["token"]) for r in best]
    toxic, plain, prior = (np.array([r[c] for r in best], float) for c in ("toxic", "plain", "prior"))
    delta = log_odds(toxic, plain, n_toxic, n_plain, prior, strength)
    weights = {t: float(w) for t, w in zip(names, delta, strict=True) if abs(w) >= APART}
    if not any(w > 0 for w in weights.values()):
        return Model(intercept=-math.inf)
    # What all other tokens share: how much rarer they are as a class in toxic passages, which are taken to hold twenty tokens.
    share = min(0.5, float(toxic[delta >= APART].sum()) / n_toxic / 20)
    model = Model(weights, background=min(-0.05, math.log1p(-share)))
    return calibrate(model, learnt if few else rows, None if few else marks, max_fit)


def calibrate(model: Model, rows: DataFrame, marks: DataFrame | None, max_fit: int) -> Model:
    """K from the documents that are not toxic, then the logistic curve. rows: id, body, and toxic unless marks tells it."""
    told = marks is None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, found = [], []
            for body in batch.column("body").to_pylist():
                tokens = tokens_of(body)
                hits = [(i, w) for i, w in enumerate(map(model.weights.get, tokens)) if w is not None]
                size.append(len(tokens))
                found.append([x[2] for x in segments(hits, len(tokens), model.background)])
            more = [batch.column("toxic")] if told else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size, pa.int64()), pa.array(found, pa.list_(pa.float64())), *more], names=["id", "size", "found", "toxic"][: 3 + told])

    kind = dict(rows.dtypes)["id"]
    seen = map_arrow(rows, scan, f"id {kind}, size bigint, found array<double>" + ", toxic int" * told)
    seen = checkpointed(seen if told else seen.join(marks.hint("merge"), "id"))
    # Segments of S or more are K n e^-S in number; those of APART or more are counted.
    high = F.size(F.filter("found", lambda x: x >= APART))
    plain = seen.where("toxic = 0").agg(F.sum(high).alias("c"), F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    model.log_k = math.log(max(plain["c"] or 0, 0.5)) + APART - math.log(max(plain["n"] or 0, 1))
    total = seen.count()
    cut = min(1 << 20, (max_fit << 20) // max(1, total))
    excess = F.transform("found", lambda x: F.greatest(x - F.log(F.greatest("size", F.lit(1))) - F.lit(model.log_k), F.lit(0.0)))
    evidence = F.aggregate(excess, F.lit(0.0), lambda a, x: a + x)
    fitted = seen.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < cut).select("toxic", evidence.alias("evidence")).toPandas()
    model.slope, model.intercept = logistic(squash(fitted["evidence"].to_numpy(float)), fitted["toxic"].to_numpy(float))
    return model


def squash(evidence):
    """Evidence beyond a few units says little more: four of them say half of all."""
    evidence = np.maximum(evidence, 0)
    return evidence / (evidence + 4)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[float, float]:
    a, b = 0.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((y - p) * x).sum() - ridge * a, (y - p).sum() - ridge * b])
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + ridge]])
        step = np.linalg.solve(h, g)
        a, b = a + float(step[0]), b + float(step[1])
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, a), b


def probability(model: Model, evidence: np.ndarray) -> np.ndarray:
    if model.intercept == -math.inf:
        return np.zeros(len(evidence))
    return 1 / (1 + np.exp(-np.clip(model.slope * squash(evidence) + model.intercept, -30, 30)))


RESULT = [("n_tokens", "bigint"), ("evidence", "double"), ("passages", "array<struct<start:int,end:int,evidence:double>>"), ("score", "double"), ("predicted", "int")]


def score(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with n_tokens, evidence, passages (token ranges), score and predicted."""

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = [passages(t, model) for t in batch.column(text).to_pylist()]
        evidence = np.array([r[1] for r in rows], float)
        value = probability(model, evidence)
        spans = [[{"start": s, "end": e, "evidence": v} for s, e, v in r[2]] for r in rows]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())]))
        return [pa.array([r[0] for r in rows], pa.int64()), pa.array(evidence), pa.array(spans, kind), pa.array(value), pa.array((value >= threshold).astype(np.int32))]

    return arrow_columns(docs, RESULT, lambda: work)


def keep_clean(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with their columns alone, whose score stays below the threshold."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            evidence = np.array([passages(t, model)[1] for t in batch.column(text).to_pylist()], float)
            yield batch.filter(pa.array(probability(model, evidence) < threshold))

    return map_arrow(docs, clean, docs.schema)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1
