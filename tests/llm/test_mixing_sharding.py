from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ordinate.llm import mixing, sharding


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies int")


def filled(sizes):
    """Targets by the stated rule: share by weight, hold to three times the size, share the excess again."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    left = float(total)
    while open_ and left > 1e-9:
        whole = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / whole for s in open_}
        over = {s for s in open_ if share[s] + target[s] >= 3 * sizes[s]}
        if not over:
            for s in open_:
                target[s] += share[s]
            break
        for s in over:
            left -= 3 * sizes[s] - target[s]
            target[s] = 3.0 * sizes[s]
        open_ -= over
        for s in open_:
            target[s] = 0.0
        left = total - sum(target[s] for s in names if s not in open_)
    return target


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for i in range(3000):
        source = ["b", "a", None, "c", "tiny"][0 if i % 3 else i // 3 % 5]
        rows.append((i, " ".join("w" * (1 + i % 90)) if source != "tiny" else "x y", source, i))
    rows += [(5000, None, "a", 1), (5001, "", "empty", 1), (5002, "  ", "empty", 2), (None, "one two", "a", 3)]
    rows += [(7, "same row here", "a", 9)] * 900
    return docs(spark, rows).repartition(4).cache()


def test_targets_and_taken(corpus):
    out = mixing.mix(corpus).collect()
    assert len(out) == corpus.count()
    sizes = Counter()
    for r in out:
        sizes[r["source"]] += r["size"]
    want = filled(sizes)
    taken = Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(200, 0.02 * t)
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(corpus.repartition(7)).collect()))


def test_emission_follows_the_plan(corpus):
    want = Counter()
    for r in mixing.mix(corpus).collect():
        want[(r["doc_id"], r["source"], r["size"])] += r["copies"]
    got = mixing.emit(corpus)
    assert got.columns == corpus.columns
    seen = Counter((r["doc_id"], r["source"], r["n"]) for r in got.select("doc_id", "source", mixing.word_count(F.col("text")).alias("n")).collect())
    assert seen == +want


def test_empty_mix(spark):
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.emit(docs(spark, [])).count() == 0


def brute_shards(rows, limit):
    """rows: (60-bit hash, bytes). Split from one bucket, on the next bit, whatever is too large."""
    out, todo = [], [("", rows)]
    while todo:
        name, held = todo.pop()
        if not held:
            continue
        if sum(b for _, b in held) <= limit or len(held) == 1 or len(name) == 60:
            out.append((name, len(held), sum(b for _, b in held)))
        else:
            for bit in "01":
                todo.append((name + bit, [r for r in held if f"{r[0]:060b}"[len(name)] == bit]))
    return sorted(out)


@pytest.mark.parametrize("limit", [50, 700, 10**9])
def test_shards(spark, limit):
    rows = [(i, "x" * (i % 37), "s", 0) for i in range(900)] + [(None, "null key", "s", 0), (3, None, "s", 0), (4, "y" * 2000, "s", 0)] + [(11, "again", "s", 0)] * 200
    df = docs(spark, rows)
    out = sharding.shard(df, F.octet_length("text"), limit=limit)
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    for name, held in by.items():
        total = sum(r["row_bytes"] for r in held)
        assert {(r["shard_bytes"], r["shard_rows"], r["shard_depth"], r["oversize"]) for r in held} == {(total, len(held), len(name), total > limit)}
        assert total <= limit or len(held) == 1
    names = sorted(by)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    counted = df.groupBy(*df.columns).count().collect()
    hashes = spark.createDataFrame([(r["doc_id"], r["text"], r["source"], r["copies"], j) for r in counted for j in range(1, r["count"] + 1)], "doc_id bigint, text string, source string, copies int, j bigint")
    h = sharding.row_hash([F.col(c) for c in df.columns], F.col("j"))
    slim = [(r["h"], len((r["text"] or "").encode())) for r in hashes.select(h.alias("h"), "text").collect()]
    assert sorted((n, len(h), sum(r["row_bytes"] for r in h)) for n, h in by.items()) == brute_shards(slim, limit)


def test_no_rows_no_shards(spark):
    assert sharding.shard(docs(spark, []), F.octet_length("text")).count() == 0


def test_clashing_names(spark):
    df = docs(spark, [(1, "abc", "s", 0)]).withColumn("shard", F.lit("mine")).withColumn("n", F.lit(1))
    row = sharding.shard(df, F.octet_length("text")).collect()[0]
    assert (row["shard"], row["n"], row["row_bytes"]) == ("", 1, 3)


@pytest.mark.parametrize("handed_out", [100_000, 0])
def test_whole_rows_reach_their_shards(spark, tmp_path, monkeypatch, handed_out):
    """Rows that share id and length keep their own texts; shards are written and read again."""
    rows = [(i % 300, f"{i:04d}" + "x" * (i % 7), "s", i % 5) for i in range(1200)] + [(7, "same", "s", 0)] * 3 + [(None, None, None, 0), (8, "", "s", 0)]
    df = docs(spark, rows)
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", handed_out)
    for limit in (300, 10**9):
        placed = sharding.shard(df, F.octet_length("text"), limit=limit, by=["doc_id"])
        folder = str(tmp_path / str(limit))
        sharding.write_shards(placed, folder)
        got = sharding.read_shards(spark, folder, placed.schema)
        assert got.columns == placed.columns
        got = got.collect()
        assert Counter(r[: len(df.columns)] for r in map(tuple, got)) == Counter(map(tuple, df.collect()))
        by = defaultdict(list)
        for r in got:
            by[r["shard"]].append(len((r["text"] or "").encode()))
        assert {(r["shard"], r["shard_bytes"], r["shard_rows"]) for r in got} == {(s, sum(b), len(b)) for s, b in by.items()}
        assert all(sum(b) <= limit for b in by.values()) and (limit > 300) == (len(by) == 1)
        again = sharding.shard(df.repartition(7), F.octet_length("text"), limit=limit, by=["doc_id"]).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_the_query_deals_out_whole_documents(spark, monkeypatch):
    from ordinate.llm import queries

    data, seen, write = "/root/testdata/sf0.001", [], sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda placed, folder: (seen.append(placed), write(placed, folder)))
    queries.op2_sharding(spark, data)
    table = spark.read.parquet(f"{data}/documents.parquet")
    assert Counter(map(tuple, seen[0].select(*table.columns).collect())) == Counter(map(tuple, table.collect()))


ODD = "doc_id bigint, text string, source string, size int, _mix string, copies int, tags map<string,int>, n binary"


def odd_rows(spark, n):
    rows = [(i, "w " * (i % 5), f"s{i % 2}", 1, "m", 2, {"a": i % 3, "b": 1}, b"x") for i in range(n)]
    return spark.createDataFrame(rows + rows[:5] + rows[:2], ODD)


def test_mixing_with_maps_and_clashing_columns(spark):
    df = odd_rows(spark, 40)
    plan = {(r["doc_id"], r["source"]): 0 for r in df.collect()}
    for r in mixing.mix(df).collect():
        plan[r["doc_id"], r["source"]] += r["copies"]
    out = mixing.emit(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert Counter((r["doc_id"], r["source"]) for r in out.collect()) == Counter({k: v for k, v in plan.items() if v})


def test_mixing_a_very_long_text(spark):
    df = docs(spark, [(1, "word " * 1_000_000, "a", 0), (2, "few words here", "a", 0), (3, "x " * 500, "b", 0)])
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    assert got[1]["size"] == 1_000_000 and got[1]["taken"] <= 3 * got[1]["size"] and sum(r["target"] for r in {r["source"]: r for r in got.values()}.values()) <= 1_000_503 + 1


def test_sharding_with_maps_and_long_payloads(spark, tmp_path):
    df = odd_rows(spark, 30).unionByName(spark.createDataFrame([(99, "y" * 3_000_000, "s", 1, "m", 2, {}, None)], ODD))
    for by in (None, ["doc_id"]):
        placed = sharding.shard(df, F.octet_length("text"), limit=100, by=by)
        got = placed.collect()
        assert len(got) == df.count() and [r["oversize"] for r in got if r["doc_id"] == 99] == [True]
        sharding.write_shards(placed, f"{tmp_path}/{by is None}")
        assert sharding.read_shards(spark, f"{tmp_path}/{by is None}", placed.schema).count() == len(got)


def test_documents_are_shuffled_once(spark, tmp_path):
    """Rows taken once and rows that share a key come from one exchange of the documents."""
    docs(spark, [(i, "word " * i, "s", 0) for i in range(50)]).write.parquet(f"{tmp_path}/d")
    plan = mixing.emit(spark.read.parquet(f"{tmp_path}/d"))._jdf.queryExecution()
    plan.toRdd().count()
    text = plan.executedPlan().toString().partition("== Initial Plan ==")[0]
    assert text.count("ReusedExchange") >= 1
