"""Extra columns called like the operators' own helper columns come out as they went in."""

import pytest
from pyspark.sql import functions as F

from ordinate.llm import decontamination, html, jaccard, mixing, pii, sharding, toxicity

HELPERS = {
    "pii": ["_mark", "_map", "_words", "_between", "_known", "c0", "e"],
    "html": ["_host", "_split", "_path", "host", "c1"],
    "sharding": ["_bytes", "_copy", "_h", "_leaf", "_n", "_k0", "_row", "_m0", "c0"],
    "emit": ["_key", "_n", "_c", "_before", "_first", "_rate", "_offset", "_times", "_k", "_from", "_odd0", "c2"],
    "decontamination": ["_spans0", "_items0", "_row", "_text", "c1"],
    "jaccard": ["_row", "_key", "mark", "root", "class"],
    "toxicity": ["id", "body", "toxic", "found"],
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "Mr. John Smith came to a@b.org and Smith spoke", "en", "s", 5), (2, "only plain words here", "en", None, 3), (2, "only plain words here", "en", None, 3), (None, None, None, "s", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def check(out, names, rows):
    out = out.collect()
    assert len(out) == rows and all(r[n] == f"{n}!" for r in out for n in names)


def extended(df, kind):
    return df.select("*", *[F.lit(f"{n}!").alias(n) for n in HELPERS[kind]])


def test_pii(docs):
    check(pii.with_surrogates(extended(docs, "pii"), key="k"), HELPERS["pii"], 4)


@pytest.mark.parametrize("limit", [8 << 20, -1])
def test_html(spark, limit):
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>x y</p>"), (2, None, None)], "page_id bigint, url string, html string")
    check(html.extract_main_text(extended(pages, "html"), broadcast_bytes=limit), HELPERS["html"], 2)


@pytest.mark.parametrize("by", [None, ["doc_id"]])
def test_sharding(docs, by):
    check(sharding.shard(extended(docs, "sharding"), F.octet_length("text"), by=by), HELPERS["sharding"], 4)


def test_emit(docs):
    taken = mixing.emit(docs).count()
    check(mixing.emit(extended(docs, "emit")), HELPERS["emit"], taken)


def test_decontamination(docs, spark):
    items = spark.createDataFrame([("a", "some other words"), ("b", "only plain words"), (None, None)], "item_id string, text string")
    found = decontamination.find_hits(extended(docs, "decontamination"), items, block_bytes=20)
    check(found, HELPERS["decontamination"], 4)
    assert sorted(r["n_hit"] for r in found.collect()) == [0, 0, 3, 3]
    check(decontamination.keep_clean(extended(docs, "decontamination"), items), HELPERS["decontamination"], 2)


def test_keep_one(docs):
    check(jaccard.keep_one(extended(docs, "jaccard")), HELPERS["jaccard"], 3)


def test_toxicity(docs, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    more = extended(docs, "toxicity")
    check(toxicity.score(more, toxicity.fit(more, labels)), HELPERS["toxicity"], 4)
