import base64
import hashlib
import io
import random
from pathlib import Path

import zstandard

from ordinate.llm import warc

SCHEMA = "page_id bigint, url string, html string"


def pages():
    rng = random.Random(4)
    body = lambda: "<html><body><p>" + " ".join(rng.choice(["alpha", "beta", "gamma", "délta"]) + str(rng.randrange(99)) for _ in range(200)) + "</p></body></html>"
    rows = [(i, f"https://h{i % 7}.example.com/p/{i}?q=a b\n", body()) for i in range(300)]
    rows += [(1000 + i, f"u{i}", rows[5][2]) for i in range(40)] + [(2000, None, None), (2001, "x", ""), (2002, "é", "")]
    return rows + [(7, "again", "twice")] * 3 + [(None, "n", "no id"), (None, "n", "no id"), (9, "n", "no id")]


def brute(rows):
    groups = {}
    for i, _, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    out = []
    for body, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0))
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((ids[-1], len(body), digest, "response", None))
        out += [(i, len(body), digest, "revisit", ids[-1]) for i in ids[:-1]]
    return sorted(out, key=repr)


def written(spark, tmp_path, rows, **more):
    path = f"file://{tmp_path}/out"
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), path, **more)
    return path, sorted(Path(f"{tmp_path}/out").glob("*.warc.zst"))


def test_round_trip(spark, tmp_path):
    rows = pages()
    path, files = written(spark, tmp_path, rows, archive_bytes=200_000, sample_bytes=60_000)
    assert len(files) > 1
    got = warc.read_archives(spark, path, payloads=True).collect()
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=repr) == brute(rows)
    bodies = {r["payload_digest"]: bytes(r["payload"]) for r in got if r["record_type"] == "response"}
    for _, _, h in rows:
        body = (h or "").encode()
        assert bodies[base64.b32encode(hashlib.sha1(body).digest()).decode()] == body


def test_files_are_plain_zstandard(spark, tmp_path):
    """Any decoder reads a file whole, given the dictionary in its first frame."""
    _, files = written(spark, tmp_path, pages())
    for f in files:
        raw = f.read_bytes()
        assert raw[:4] == (0x184D2A5D).to_bytes(4, "little")
        size = int.from_bytes(raw[4:8], "little")
        tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
        whole = tool.stream_reader(io.BytesIO(raw[8 + size :]), read_across_frames=True).read()
        assert whole == b"".join(warc.iter_records(raw)) and whole.startswith(b"WARC/1.1\r\n")
        ids = [l for l in whole.split(b"\r\n") if l.startswith(b"WARC-Record-ID")]
        assert len(ids) == len(set(ids))


def test_the_dictionary_pays(spark, tmp_path):
    rows = pages()[:300]
    _, with_it = written(spark, tmp_path / "a", rows)
    _, without = written(spark, tmp_path / "b", rows, dictionary_bytes=1, sample_bytes=1)
    assert sum(f.stat().st_size for f in with_it) < sum(f.stat().st_size for f in without)


def test_small_payloads_can_be_left_single(spark, tmp_path):
    rows = [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long text"), (4, "d", "long text"), (5, "e", "xx"), (5, "e", "xx")]
    path, _ = written(spark, tmp_path, rows, least_bytes=5)
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, path).select("page_id", "record_type", "refers_to").na.fill(0).collect())
    assert got == [(1, "response", 0), (2, "response", 0), (3, "revisit", 4), (4, "response", 0), (5, "response", 0), (5, "response", 0)]


def test_none(spark, tmp_path):
    path, files = written(spark, tmp_path, [])
    assert files == [] and warc.read_archives(spark, path).count() == 0


def test_a_very_long_payload_and_clashing_columns(spark, tmp_path):
    rows = [(1, "https://a.example/", "<p>" + "long é " * 700_000 + "</p>", "x", 1, b"z"), (2, "https://a.example/", "short", "y", 2, b"")]
    df = spark.createDataFrame(rows, SCHEMA + ", payload string, record_type int, refers_to binary")
    warc.write_archives(df, str(tmp_path / "a"))
    got = {r["page_id"]: r for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    for i, _, html, *_ in rows:
        raw = html.encode()
        assert got[i]["payload_bytes"] == len(raw) and got[i]["record_type"] == "response"
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
