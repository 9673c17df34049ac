import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ordinate.llm import decontamination as d


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items, window=13):
    patterns = {}
    for item, t in items:
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            patterns.setdefault(tuple(w[i : i + n]), set()).update([str(item)] if item is not None else [])
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(p) for p in patterns}:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in patterns:
                    hit |= set(range(at, at + n))
                    found |= patterns[tuple(w[at : at + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def run(spark, frame, docs, items, **more):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = d.find_hits(frame(docs), bench, **more)
    return sorted([tuple(r) for r in out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()], key=repr)


def case(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "é", "Éa", "x1", "Zz", "a", "b", "c"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "--", "’s"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 5, 13, 14, 40]))) for i in range(12)] + [(3, text(20)), (99, None), (None, text(18)), (100, "!!!")]
    docs = []
    for i in range(120):
        body = text(rng.randrange(0, 90))
        if i % 3 == 0:
            body += " " + (rng.choice(items)[1] or "").upper() + " " + text(5)
        docs.append((i, body))
    return docs + [(200, None), (201, ""), (5, docs[5][1]), (None, items[-2][1])], items


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("block", [1 << 20, 300])
def test_against_brute_force(spark, frame, seed, block):
    docs, items = case(seed)
    assert run(spark, frame, docs, items, block_bytes=block) == brute(docs, items)


def test_long_patterns_only(spark, frame):
    rng = random.Random(8)
    item = [f"w{rng.randrange(500)}" for _ in range(60)]
    docs = [(1, " ".join(item)), (2, "a b c " + " ".join(item[10:22])), (3, "a b c " + " ".join(item[10:23]) + " tail"), (4, " ".join(["q"] * 50_000 + item[5:30]))]
    items = [(7, " ".join(item)), (8, " ".join(item[:20]))]
    got = run(spark, frame, docs, items)
    assert got == brute(docs, items) and [r[2] for r in got] == [60, 0, 13, 25] and got[3][5] is False


def test_empty_sides(spark, frame):
    assert run(spark, frame, [(1, "some words")], []) == brute([(1, "some words")], [])
    assert d.find_hits(frame([]), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")).count() == 0


def test_filter_keeps_columns_and_clean_rows(spark, frame):
    from pyspark.sql import functions as F

    docs, items = case(5)
    df = frame(docs).withColumn("contaminated", F.lit("mine")).withColumn("n_hit", F.lit(-1))
    kept = d.keep_clean(df, spark.createDataFrame(items, "item_id bigint, text string"))
    assert kept.columns == df.columns
    want = sorted([(i, t) for (i, t), r in zip(sorted(docs, key=repr), [next(b for b in brute([x], items)) for x in sorted(docs, key=repr)], strict=True) if not r[5]], key=repr)
    assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=repr) == want


def test_a_very_long_text_and_clashing_columns(spark):
    item = " ".join(f"q{i}" for i in range(20))
    rows = [(1, "fill " * 400_000 + item, "x", 3), (2, item + " fill", "y", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, items string, n_words int").withColumn("item", F.lit(1))
    found = {r["doc_id"]: r for r in d.find_hits(docs, spark.createDataFrame([(7, item)], "item_id int, text string")).collect()}
    assert (found[1]["n_words"], found[1]["n_hit"], found[1]["contaminated"]) == (400_020, 20, False)
    assert (found[2]["n_hit"], found[2]["contaminated"], found[2]["items"]) == (20, True, ["7"])
