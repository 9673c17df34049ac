import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinate.llm import toxicity as t


def all_segments(values):
    """Maximal scoring segments by their definition: take the best (leftmost, shortest), then each side."""
    best, at = 0.0, None
    for i in range(len(values)):
        total = 0.0
        for j in range(i, len(values)):
            total += values[j]
            if total > best + 1e-12:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    i, j = at
    return all_segments(values[:i]) + [(i, j, best)] + [(a + j, b + j, s) for a, b, s in all_segments(values[j:])]


@pytest.mark.parametrize("seed", range(30))
def test_segments_are_all_maximal_ones(seed):
    rng = random.Random(seed)
    n, background = rng.randrange(1, 40), -rng.choice([0.3, 0.7, 1.1])
    hits = sorted((i, rng.choice([0.5, 1.25, 2.6, 4.1, -2.2, -0.9])) for i in rng.sample(range(n), rng.randrange(0, n + 1)))
    values = [background] * n
    for i, w in hits:
        values[i] = w
    got = [(s, e, round(v, 9)) for s, e, v in t.segments(hits, n, background)]
    assert got == [(s, e, round(v, 9)) for s, e, v in all_segments(values)]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    bad = ["zork", "blah!t", "vex", "grmp"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(["sun", "rain", "tree", "hill", "über"]) + rng.choice("abcdefgh") for _ in range(rng.randrange(3, 200))]
        toxic = i % 6 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(bad, k=rng.randrange(2, 6))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(2000, None, "en", "s", 0), (2001, "", "en", "s", 0), (3, rows[3][1], "en", "s", 0), (None, "zork vex zork", "en", "s", 0), (2002, "zork " * 20_000, "en", "s", 0)]
    labels += [(5555, 1, 1), (1, 1, None), (2, 1, 0), (2, 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.repartition(3).cache(), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_documents(labelled):
    docs, labels = labelled
    model = t.fit(docs, labels, learn=~t.held_out(F.col("id")))
    assert set(model.weights) >= {b"zork", b"vex", b"grmp"} and b"t" in model.weights and b"suna" not in model.weights
    out = t.score(docs.withColumn("score", F.lit("mine")), model).withColumn("held", t.held_out(F.col("doc_id")))
    rows = {r["doc_id"]: r for r in out.collect()}
    unseen = [i for i in range(900) if rows[i]["held"]]
    assert 200 < len(unseen) < 400
    assert np.mean([rows[i]["predicted"] == (i % 6 == 0) for i in unseen]) > 0.98
    assert rows[2000]["score"] == rows[2001]["score"] < 0.1 and rows[2000]["predicted"] == 0 and rows[2002]["predicted"] == 1 and rows[None]["predicted"] == 1
    for i in unseen:
        tokens = t.tokens_of(rows[i]["text"]) if "text" in rows[i] else []
        for s in rows[i]["passages"]:
            assert 0 <= s["start"] < s["end"] <= len(tokens) and any(x in model.weights for x in tokens[s["start"] : s["end"]])


def test_labels_of_the_held_out_fold_are_not_used(labelled, spark):
    docs, labels = labelled
    learn = ~t.held_out(F.col("id"))
    turned = labels.withColumn("toxic", F.when(t.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert t.fit(docs, labels, learn=learn) == t.fit(docs, turned, learn=learn)


def test_filter(labelled):
    docs, labels = labelled
    model = t.fit(docs, labels)
    kept = t.keep_clean(docs, model)
    want = sorted(r["doc_id"] or -1 for r in t.score(docs, model).where("predicted = 0").collect())
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == want


def test_nothing_to_learn(labelled, spark):
    docs, labels = labelled
    for some in (labels.limit(0), labels.where("toxic = 0")):
        model = t.fit(docs, some)
        assert model.intercept == -math.inf and {r["score"] for r in t.score(docs, model).collect()} == {0.0}
    assert t.score(docs.limit(0), t.fit(docs, labels)).count() == 0 and t.fit(docs.limit(0), labels).intercept == -math.inf


def test_folds(spark):
    import zlib

    ids = [*range(50), -4, 2**40]
    got = {r["i"]: r["h"] for r in spark.createDataFrame([(i,) for i in ids], "i bigint").select("i", t.held_out(F.col("i")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in ids}


def test_rare_words_stay_and_are_held_down(spark):
    """Words in three toxic documents and no other are learnt, a joined corpus count changes nothing, and common mild words don't take their places."""
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = [f"sun{chr(97 + (i * j) % 26)}" for j in range(1, 9)] + ([f"rare{chr(97 + i // 18 % 26)}{chr(97 + i // 468)}", "vex"] if toxic else ["hill"])
        rows.append((i, " ".join(words + [f"mild{chr(97 + i % 5)}"] * (toxic or i % 3 == 0))))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = t.fit(docs, marks)
    rare = {w: v for w, v in model.weights.items() if w.startswith(b"rare")}
    assert len(rare) == 33 and max(rare.values()) < 6 and not any(w.startswith(b"mild") and v > 0 for w, v in model.weights.items())
    assert t.fit(docs, marks, handed_out=0) == model


def plain_python(docs, labels, learns, least_docs=3, strength=20.0):
    """The whole method over dicts: weights, background, K, curve, and the score of each document."""
    from collections import Counter, defaultdict

    votes = defaultdict(list)
    for i, toxic in labels:
        if i is not None and toxic is not None and learns(i):
            votes[i].append(toxic)
    marks = {i: int(sum(v) / len(v) >= 0.5) for i, v in votes.items()}
    first = {}
    for i, text in docs:
        if i in marks:
            first[text, marks[i]] = min(i, first.get((text, marks[i]), i))
    chosen = [(i, text) for i, text in docs if i in set(first.values())]
    counts, sizes, everywhere = (Counter(), Counter()), [0, 0], Counter()
    for i, text in chosen:
        counts[marks[i]].update(set(t.tokens_of(text)))
        sizes[marks[i]] += 1
    for _, text in docs:
        everywhere.update(set(t.tokens_of(text)))
    weights, hits_in_toxic = {}, 0
    for w in counts[0] | counts[1]:
        prior = max(strength * everywhere[w] / len(docs), 0.5)
        odds = [math.log(counts[c][w] + prior) - math.log(sizes[c] + strength - counts[c][w] - prior) for c in (0, 1)]
        delta = odds[1] - odds[0]
        if delta >= math.log(4) and counts[1][w] >= least_docs or delta <= -math.log(4):
            weights[w] = delta
            hits_in_toxic += counts[1][w] * (delta > 0)
    background = min(-0.05, math.log(1 - min(0.5, hits_in_toxic / sizes[1] / 20)))

    def found(text):
        tokens = t.tokens_of(text)
        return len(tokens), [s for _, _, s in all_segments([weights.get(x, background) for x in tokens])]

    high = length = 0
    for i, text in chosen:
        if not marks[i]:
            n, s = found(text)
            high, length = high + sum(x >= math.log(4) for x in s), length + n
    log_k = math.log(max(high, 0.5) * 4 / length)

    def evidence(text):
        n, s = found(text)
        return sum(max(0.0, x - math.log(n) - log_k) for x in s)

    x = np.array([evidence(text) for _, text in chosen])
    slope, intercept = t.logistic(x / (x + 4), np.array([marks[i] for i, _ in chosen], float))
    e = np.array([evidence(text) for _, text in docs])
    return weights, background, log_k, 1 / (1 + np.exp(-(slope * e / (e + 4) + intercept)))


@pytest.mark.parametrize("in_place", [10**6, 0])
def test_query_against_plain_python(spark, tmp_path, monkeypatch, in_place):
    import functools
    import zlib

    from ordinate.llm import queries

    rng = random.Random(23)
    docs, labels = [], []
    for i in range(260):
        toxic = rng.random() < 0.3
        words = rng.choices([f"w{chr(97 + k)}" for k in range(20)], k=rng.randrange(5, 50)) + rng.choices(["calm", "kind"], k=0 if toxic else 2)
        if toxic or rng.random() < 0.04:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(["zork", "vex", "grmp"], k=rng.randrange(1, 4))
        docs.append((i, " ".join(words)))
        if rng.random() < 0.8:
            labels.append((i, 1, int(toxic)))
    docs += [(300, docs[0][1]), (301, None), (302, "")]
    labels += [(300, 1, 1 - int(labels[0][2])), (999, 1, 1), (5, 1, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(t, "fit", functools.partial(t.fit, in_place=in_place))
    got = {r["doc_id"]: r for r in queries.op7_toxicity(spark, str(tmp_path)).collect()}
    weights, _, _, scores = plain_python(docs, [(i, x) for i, _, x in labels], lambda i: zlib.crc32(str(i).encode()) % 3 != 1)
    assert any(w < 0 for w in weights.values()) and any(w > 0 for w in weights.values())
    for (i, _), want in zip(docs, scores, strict=True):
        assert got[i]["score"] == pytest.approx(want, abs=1e-6) and got[i]["predicted"] == int(want >= 0.7) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_a_null_id_has_no_fold(spark):
    assert spark.createDataFrame([(None,)], "i bigint").select(t.held_out(F.col("i")).alias("h")).first()["h"] is None


def test_long_texts_and_clashing_columns(labelled, spark):
    docs, labels = labelled
    model = t.fit(docs, labels)
    long = spark.createDataFrame([(1, "suna " * 400_000 + "zork vex grmp " * 5, "x", 7, "y")], "doc_id bigint, text string, evidence string, passages int, id string")
    row = t.score(long, model).first()
    assert row["n_tokens"] == 400_015 and row["predicted"] == 1 and row["id"] == "y" and row["passages"][0]["start"] == 400_000
