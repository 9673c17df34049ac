import random
import re

import pytest

from ordinate.llm import jaccard


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted([(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))], key=repr)


def run(df, **more):
    return sorted([tuple(r) for r in jaccard.near_duplicates(df, **more).select("doc_id", "n_shingles", "component_id").collect()], key=repr)


def corpus(seed, families, size, shared):
    """Families of near copies with growing changes, some with a passage that many documents share."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["on", "the", "x"]) + str(rng.randrange(300))
    passage, rows = [word() for _ in range(25)], []
    for _ in range(families):
        base = [word() for _ in range(rng.randrange(8, 70))]
        for _ in range(rng.randrange(1, size)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(0, 3)] = [word()] * rng.randrange(0, 3)
            if rng.random() < shared:
                w[rng.randrange(len(w) + 1) : 0] = passage
            rows.append((len(rows) + 10, " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "families", "size", "shared", "small"), [(1, 60, 5, 0, 12), (2, 25, 12, 0.5, 4), (3, 4, 60, 0.3, 3), (4, 40, 4, 1, 2)])
def test_against_brute_force(frame, seed, families, size, shared, small):
    rows = corpus(seed, families, size, shared)
    rows += [(1000, None), (1001, ""), (1002, " \t "), (1003, "one two"), (1004, "ONE two"), (1005, "one two three"), (None, rows[0][1]), (rows[3][0], rows[3][1]), (rows[4][0], "other text under the same id now")]
    assert run(frame(rows), small=small) == brute(rows)


@pytest.mark.parametrize("hub_rounds", [0, 1, 3])
def test_long_lists_lose_nothing(frame, hub_rounds):
    rows = corpus(5, 20, 10, 0.5)
    assert run(frame(rows), small=1, hub_rounds=hub_rounds, chunk=3, split=5, local_owners=2, block_shingles=300, one_task=4) == brute(rows)


def test_a_long_text_and_clashing_columns(spark):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(120_000))
    rows = [(1, long), (2, long + " end"), (3, long[: len(long) // 2]), (4, "x " * 300_000), (5, "x x x x x")]
    docs = spark.createDataFrame([(i, t, 1, "c", b"k", 2.0) for i, t in rows], "doc_id bigint, text string, n int, class string, tokens binary, root double")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_chains_join_through_neighbours(frame):
    words = [f"w{i}" for i in range(260)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(40)]
    want = brute(rows)
    assert run(frame(rows)) == want and {r[2] for r in want} == {0}


def test_threshold_is_exact(frame):
    # 12 shingles of 16 in all are shared: just 0.75; one fewer is not.
    base = [f"b{i}" for i in range(18)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:16] + ["y1", "y2"])), (3, " ".join(base[:15] + ["z1", "z2", "z3"]))]
    assert run(frame(rows)) == brute(rows)


def test_many_copies_are_one_class(frame):
    rows = [(i, "the same words again and again in every row of these") for i in range(500)] + [(1000, "quite another text with words of its own here")]
    out = jaccard.near_duplicates(frame(rows)).collect()
    assert len({r["class"] for r in out}) == 2 and {r["component_id"] for r in out} == {0, 1000}


def test_keep_one(frame):
    rows = corpus(6, 20, 6, 0.2) + [(1000, None), (1001, ""), (1002, "a b c"), (1002, "a b c"), (1003, "A b c"), (None, "a b c")]
    df = frame(rows)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    want = {c for _, n, c in brute(rows) if n} | {1000, 1001}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(got) == sorted(want)


def test_no_rows(frame):
    assert run(frame([])) == [] and jaccard.keep_one(frame([])).count() == 0


def test_packing():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(0, 2**40, 1000, dtype=np.uint64))
    assert (jaccard.unpack(jaccard.pack(keys)) == keys).all() and len(jaccard.unpack(jaccard.pack(keys[:0]))) == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 360)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    links = spark.createDataFrame([e for e in edges if e[0] != e[1]], "a bigint, b bigint")
    for one_task in (10**6, 20):
        labels = jaccard.components(links, one_task, jaccard.Workspace(spark, "test"), "labels")
        got = {r["v"]: r["root"] for r in labels.collect()}
        assert got == {v: find(v) for a, b in edges if a != b for v in (a, b)}


def test_a_long_chain_is_one_component(spark):
    links = spark.range(3000).selectExpr("id as a", "id + 1 as b")
    labels = jaccard.components(links, 100, jaccard.Workspace(spark, "test"), "labels")
    assert {tuple(r) for r in labels.select("root").distinct().collect()} == {(0,)} and labels.count() == 3001


def test_needs():
    import numpy as np

    cold = np.full(40, 1, np.uint8)
    assert jaccard.best_need(cold, 10, 40, 12) == 1
    busy = np.concatenate([np.full(12, 9), np.full(28, 2)]).astype(np.uint8)
    assert jaccard.best_need(np.sort(busy), 10, 40, 12) >= 1 and jaccard.best_need(np.full(40, 9, np.uint8), 10, 40, 12) > 1
    assert jaccard.best_need(np.full(40, 13, np.uint8), 10, 40, 12) == 1
