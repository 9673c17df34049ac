import hashlib
import random
from collections import defaultdict

import pytest

from ordinate.llm import substring


def brute(rows, k):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    least = defaultdict(lambda: 2**63)
    for i, w in words:
        if i is not None:
            for at in range(len(w) - k + 1):
                least[tuple(w[at : at + k])] = min(least[tuple(w[at : at + k])], i)
    out = []
    for i, w in words:
        gone = set()
        for at in range(len(w) - k + 1):
            if least[tuple(w[at : at + k])] < (2**63 - 1 if i is None else i):
                gone |= set(range(at, at + k))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode()))
    return sorted(out, key=repr)


def run(df, k, **more):
    out = substring.dedup_substrings(df, k=k, **more)
    return sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in out.collect()], key=repr)


@pytest.mark.parametrize("k", [3, 13])
def test_random_documents(frame, k):
    rng = random.Random(k)
    passages = [" ".join(rng.choice(["a", "b", "é", "dd", "x\0y"]) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 40))) for _ in range(30)]
    rows = [(i, rng.choice([" ", "\n", "\t\v "]).join(rng.choices(passages, k=rng.randrange(0, 8)))) for i in range(150)]
    rows += [(None, rows[3][1]), (5, rows[9][1]), (7, rows[7][1]), (7, rows[7][1]), (200, None), (201, ""), (202, " \n ")]
    df = frame(rows)
    # Small groups and buckets, so that edges meet across them.
    assert run(df, k, group_bytes=2000, bucket_bytes=4000) == brute(rows, k)


def test_long_repeats_are_one_path(frame):
    base = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(base)), (2, "x y z " + " ".join(base[20:120]) + " tail"), (3, " ".join(base[50:80]))]
    out = substring.dedup_substrings(frame(rows), k=13).collect()
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in out}
    assert spans == {1: [], 2: [(3, 100, 1, 20)], 3: [(0, 30, 1, 50)]}
    result = substring.dedup_substrings(frame(rows), k=13)
    found = substring.repeated_paths(result).collect()
    assert {(r["source"], r["source_start"], r["words"], r["copies"]) for r in found} == {(1, 20, 30, 1), (1, 50, 30, 2), (1, 80, 40, 1)}
    assert [r["same"] for r in substring.compared(frame(rows), result).collect()] == [True, True]


def test_paths_and_words_of_random_documents(frame):
    rng = random.Random(31)
    parts = [" ".join(f"p{rng.randrange(500)}" for _ in range(rng.randrange(3, 30))) for _ in range(25)]
    rows = [(i, " ".join(rng.choices(parts, k=rng.randrange(1, 6)))) for i in range(80)]
    result = substring.dedup_substrings(frame(rows), k=5, group_bytes=2000)
    spans = [(r["doc_id"], *s) for r in result.collect() for s in r["spans"]]
    assert spans and all(r["same"] for r in substring.compared(frame(rows), result).collect())
    covered, cuts = defaultdict(int), set()
    for _, _, words, source, at in spans:
        cuts |= {(source, at), (source, at + words)}
        for j in range(at, at + words):
            covered[source, j] += 1
    paths = [tuple(r) for r in substring.repeated_paths(result).collect()]
    assert {(s, j): c for s, at, n, c in paths for j in range(at, at + n)} == covered and sum(n for _, _, n, _ in paths) == len(covered)
    assert all((s, at) in cuts and (s, at + n) in cuts and not any((s, j) in cuts for j in range(at + 1, at + n)) for s, at, n, _ in paths)


def test_edges(frame):
    assert run(frame([]).limit(0), 13) == []
    rows = [(1, "one " * 40), (2, "one " * 13), (3, "one " * 12), (4, "q" * 100_000)]
    assert run(frame(rows), 13) == brute(rows, 13)


def test_many_copies(frame):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(i, text) for i in range(400)]
    out = run(frame(rows), 13)
    assert sum(r[2] for r in out) == 399 * 60 and [r[0] for r in out if r[2] == 0] == [0]


def test_a_very_long_text_and_clashing_columns(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400_000)]
    rows = [(1, " ".join(words[1000:1100])), (2, " ".join(words)), (3, " ".join(words[300_000:300_040]))]
    df = spark.createDataFrame([(i, t, 5, "g", b"k") for i, t in rows], "doc_id bigint, text string, n_words int, g string, kept binary")
    out = {r["doc_id"]: r for r in substring.dedup_substrings(df, k=13, keep_text=False).collect()}
    assert [(out[i]["n_words"], out[i]["n_removed"]) for i in (1, 2, 3)] == [(100, 0), (400_000, 100), (40, 40)]
    assert out[2]["kept_sha256"] == hashlib.sha256(" ".join(words[:1000] + words[1100:]).encode()).hexdigest()


def test_one_id_for_a_third_of_all_rows(frame):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(5, text)] * 100 + [(i, text + f" own{i}") for i in range(100, 300)]
    assert run(frame(rows), 13, group_bytes=2000) == brute(rows, 13)
