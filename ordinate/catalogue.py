"""Every operator of a collection as a query on the tables of a data folder, with its SQL.

Order-bearing queries return the rank of each row, keys are shown in hex.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .collection import Collection
from .database import open as open_database
from .errors import Error
from .functions import documents as D
from .functions import keys as K
from .functions import models as M
from .operators import relational as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumn("k", K.key_of(df, *columns))


def hexed(df: DataFrame) -> DataFrame:
    return df.withColumn("key_hex", F.hex("k")).drop("k")


_LOADED: dict[tuple[str, str, str], Collection] = {}


def stored(spark, d, table: str) -> Collection:
    """A table as a collection of documents, loaded once for each application: segments sorted by key."""
    at = (spark.sparkContext.applicationId, d, table)
    if at not in _LOADED:
        df = {"orders": orders, "conversations": conversations, "pages": pages_by_url, "lineitem": lineitem_keys, "mixed": mixed}[table](spark, d)
        c = open_database()[table]
        c.put_df(df.select("k", D.document_of(df, *[n for n in df.columns if n != "k"]).alias("doc")))
        _LOADED[at] = c
    return _LOADED[at]


def shown(rows: DataFrame, fields: str) -> DataFrame:
    """Fields of the documents as columns ("name type, ..."), beside k and rank if it is there."""
    pairs = [f.split() for f in fields.split(",")]
    return rows.select("k", *[D.field(F.col("doc"), n, t).alias(n) for n, t in pairs], *[c for c in rows.columns if c == "rank"])


_ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string"
_CONVERSATIONS = "conv_id bigint, turn bigint, role string"
_PAGES = "page_id bigint, url string"
_MIXED_FIELDS = "kind string, name string"


def orders(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return keyed(df, "o_orderkey")


def conversations(spark, d):
    return keyed(read(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


def pages(spark, d):
    return keyed(read(spark, d, "pages").select("page_id", "url"), "url")


def pages_by_url(spark, d):
    """Every page with a url, under its url, its page_id (none: behind the others) and its place: pages may share both."""
    df = read(spark, d, "pages").select("page_id", "url").where("url IS NOT NULL")
    number = F.coalesce(K.int_part(F.col("page_id")), K.bytes_part(F.lit(b"")))
    return df.withColumn("k", K.key(K.str_part(F.col("url")), number, K.int_part(F.monotonically_increasing_id())))


def lineitem_keys(spark, d):
    return keyed(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct(), "l_orderkey", "l_linenumber")


def mixed(spark, d):
    """A collection whose keys are ints, strs and bytes."""
    nation = read(spark, d, "nation").select("n_nationkey", "n_name")
    ints = nation.select(K.int_part(F.col("n_nationkey") - 12).alias("k"), F.lit("int").alias("kind"), F.col("n_name").alias("name"))
    strs = nation.select(K.str_part(F.col("n_name")).alias("k"), F.lit("str").alias("kind"), F.col("n_name").alias("name"))
    raws = nation.select(K.bytes_part(F.encode(F.col("n_name"), "UTF-8")).alias("k"), F.lit("bytes").alias("kind"), F.col("n_name").alias("name"))
    return ints.unionByName(strs).unionByName(raws)


_ORDER = "o_orderkey, o_custkey, o_orderstatus, o_orderpriority"


def int_hex(v: str) -> str:
    return f"('01' || lpad(upper(to_hex(({v}::HUGEINT + 9223372036854775808)::UBIGINT)), 16, '0'))"


def text_hex(v: str, tag: str = "02") -> str:
    return rf"('{tag}' || replace(replace(regexp_replace(hex({v}), '(..)', '\1 ', 'g'), '00 ', '00FF '), ' ', '') || '00')"


_MIXED = f"""(SELECT {int_hex("n_nationkey - 12")} AS key_hex, 'int' AS kind, n_name AS name, 1 AS t, n_nationkey AS i, '' AS s FROM nation
  UNION ALL SELECT {text_hex("n_name")}, 'str', n_name, 2, 0, n_name FROM nation
  UNION ALL SELECT {text_hex("n_name", "03")}, 'bytes', n_name, 3, 0, n_name FROM nation)"""

# Point reads


@query(f"SELECT {_ORDER} FROM orders WHERE o_orderkey = 42")
def point_get(spark, d):
    return shown(stored(spark, d, "orders").get_df(42), _ORDERS).drop("k")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = 20 * c_custkey) AS found FROM customer")
def contains_batch(spark, d):
    probes = read(spark, d, "customer").select("c_custkey", K.int_part(F.col("c_custkey") * 20).alias("k"))
    return R.contains(orders(spark, d), probes).drop("k")


@query("SELECT count(*) AS n FROM orders")
def length(spark, d):
    return R.length(orders(spark, d))


@query("SELECT c_custkey, coalesce(o_orderstatus, 'none') AS status FROM customer LEFT JOIN orders ON o_orderkey = 20 * c_custkey")
def get_default(spark, d):
    probes = read(spark, d, "customer").select("c_custkey", K.int_part(F.col("c_custkey") * 20).alias("k"))
    return R.get_many(orders(spark, d), probes).select("c_custkey", F.coalesce("o_orderstatus", F.lit("none")).alias("status"))


@query("SELECT (SELECT count(*) FROM (SELECT o_orderkey, o_orderstatus FROM orders EXCEPT SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0)) AS differing")
def equality(spark, d):
    """How many entries of one collection the other lacks or holds differently."""
    left = orders(spark, d).select("k", F.col("o_orderstatus").alias("a"))
    right = orders(spark, d).where("o_orderkey % 2 = 0").select("k", F.col("o_orderstatus").alias("b"))
    both = left.join(right, "k", "full")
    return both.agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing"))


# Ordered scans


@query(f"SELECT {int_hex('l_orderkey')} || {int_hex('l_linenumber')} AS key_hex, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS rank FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def iter_keys(spark, d):
    return hexed(stored(spark, d, "lineitem").ranked_df().drop("doc"))


@query(f"SELECT {int_hex('o_orderkey')} AS key_hex, row_number() OVER (ORDER BY o_orderkey DESC) AS rank FROM orders")
def reverse_keys(spark, d):
    return hexed(stored(spark, d, "orders").ranked_df(reverse=True).drop("doc"))


@query(f"SELECT {_ORDER}, row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders")
def values(spark, d):
    return shown(stored(spark, d, "orders").ranked_df(), _ORDERS).drop("k")


@query(f"SELECT {int_hex('conv_id')} || {int_hex('turn')} AS key_hex, conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn) AS rank FROM conversations")
def items(spark, d):
    return hexed(shown(stored(spark, d, "conversations").ranked_df(), _CONVERSATIONS))


@query(f"SELECT {_ORDER}, row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 2000")
def range_int(spark, d):
    return shown(stored(spark, d, "orders").ranked_df(100, 2000), _ORDERS).drop("k")


@query(f"SELECT {_ORDER} FROM orders WHERE o_orderkey >= 5000")
def range_lo(spark, d):
    return shown(stored(spark, d, "orders").df(5000, None), _ORDERS).drop("k")


@query(f"SELECT {_ORDER} FROM orders WHERE o_orderkey < 5000")
def range_hi(spark, d):
    return shown(stored(spark, d, "orders").df(None, 5000), _ORDERS).drop("k")


@query("SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn) AS rank FROM conversations WHERE (conv_id, turn) >= (10, 2) AND conv_id < 40")
def range_tuple(spark, d):
    return shown(stored(spark, d, "conversations").ranked_df((10, 2), (40,)), _CONVERSATIONS).drop("k")


@query(f"SELECT key_hex, kind, name, row_number() OVER (ORDER BY t, i, s) AS rank FROM {_MIXED} WHERE t = 1 OR t = 2 AND s < 'NATION_15'")
def range_cross_type(spark, d):
    return hexed(shown(stored(spark, d, "mixed").ranked_df(None, "NATION_15"), _MIXED_FIELDS))


@query(f"SELECT {_ORDER} FROM orders WHERE false")
def range_reversed(spark, d):
    return shown(stored(spark, d, "orders").df(2000, 100), _ORDERS).drop("k")


@query("SELECT page_id, url, row_number() OVER (ORDER BY url) AS rank FROM pages WHERE starts_with(url, 'https://blog.')")
def prefix_str(spark, d):
    return shown(stored(spark, d, "pages").ranked_df(prefix="https://blog."), _PAGES).drop("k")


@query("SELECT doc_id, source FROM documents WHERE starts_with(source, 'src1')")
def prefix_str_tuple_keys(spark, d):
    return R.prefix(keyed(read(spark, d, "documents").select("source", "doc_id"), "source", "doc_id"), "src1").drop("k")


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'http://')")
def prefix_bytes(spark, d):
    df = read(spark, d, "pages").select("page_id", "url", K.bytes_part(F.encode("url", "UTF-8")).alias("k"))
    return R.prefix(df, b"http://").drop("k")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en'")
def prefix_tuple(spark, d):
    return R.prefix(keyed(read(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id"), ("en",)).drop("k")


@query("SELECT count(*) AS n FROM orders")
def prefix_all(spark, d):
    return R.length(stored(spark, d, "orders").prefix_df(()))


@query("SELECT page_id, url FROM pages ORDER BY url LIMIT 1")
def first(spark, d):
    return shown(stored(spark, d, "pages").end_df(), _PAGES).drop("k")


@query("SELECT page_id, url FROM pages ORDER BY url DESC LIMIT 1")
def last(spark, d):
    return shown(stored(spark, d, "pages").end_df(reverse=True), _PAGES).drop("k")


# Writes

_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag"


def line_changes(spark, d):
    df = read(spark, d, "lineitem")
    seq = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return R.puts(keyed(df.select("*"), "l_orderkey", "l_linenumber"), seq).select("k", "seq", "op", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")


@query(f"SELECT {_LINE} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS r FROM lineitem) WHERE r = 1")
def put_upsert(spark, d):
    return R.latest(line_changes(spark, d)).drop("k")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders")
def update_batch(spark, d):
    base = orders(spark, d)
    return R.upsert(base, base.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X"))).drop("k")


@query(f"SELECT {_ORDER} FROM orders WHERE o_custkey % 7 <> 0")
def delete(spark, d):
    base = shown(stored(spark, d, "orders").df(), _ORDERS)
    return R.delete(base, base.where("o_custkey % 7 = 0")).drop("k")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 21 = 0 THEN 'again' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_custkey % 7 <> 0 OR o_custkey % 21 = 0")
def delete_then_put(spark, d):
    base = orders(spark, d)
    gone = R.deletes(base.where("o_custkey % 7 = 0"), F.lit(1))
    back = R.puts(base.where("o_custkey % 21 = 0").withColumn("o_orderstatus", F.lit("again")), F.lit(2))
    return R.apply(base, back.unionByName(gone, allowMissingColumns=True)).drop("k")


@query(f"SELECT {_ORDER} FROM orders WHERE o_orderkey = 77")
def pop(spark, d):
    """What a pop gives; what it leaves is in pop_rest."""
    return R.pop(orders(spark, d), 77)[0].drop("k")


@query(f"SELECT {_ORDER} FROM orders WHERE o_orderkey <> 77")
def pop_rest(spark, d):
    return R.pop(orders(spark, d), 77)[1].drop("k")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > (SELECT min(o_orderkey) FROM orders)")
def popitem(spark, d):
    return R.pop_first(orders(spark, d))[1].select("o_orderkey")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)")
def setdefault(spark, d):
    base = keyed(read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "id")
    rows = keyed(read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "id")
    return R.setdefault(base, rows).drop("k")


@query("SELECT 0::BIGINT AS n")
def clear(spark, d):
    return R.length(R.clear(orders(spark, d)))


# Catalogue


def small_database(spark, d):
    """A database in memory with a collection for each region, and one for nations."""
    db = open_database()
    for r in read(spark, d, "region").collect():  # five rows by definition of the table
        db[r["r_name"]][r["r_regionkey"]] = {"name": r["r_name"]}
    db["nation"].update({(r["n_regionkey"], r["n_name"]): {"id": r["n_nationkey"]} for r in read(spark, d, "nation").collect()})
    return db


@query("SELECT name, row_number() OVER (ORDER BY name) AS rank FROM (SELECT r_name AS name FROM region UNION ALL SELECT 'nation')")
def names(spark, d):
    with small_database(spark, d) as db:
        return spark.createDataFrame([(n, i + 1) for i, n in enumerate(db)], "name string, rank bigint")


@query("SELECT * FROM (VALUES ('nation', true), ('nowhere', false), ('', false)) AS t(name, found)")
def has(spark, d):
    with small_database(spark, d) as db:
        return spark.createDataFrame([(n, n in db) for n in ("nation", "nowhere", "")], "name string, found boolean")


@query("SELECT r_name AS name FROM region")
def drop(spark, d):
    with small_database(spark, d) as db:
        del db["nation"]
        return db.names_df()


@query("SELECT count(*) + 1 AS n FROM region")
def count_names(spark, d):
    with small_database(spark, d) as db:
        return spark.createDataFrame([(len(db),)], "n bigint")


# Codecs


@query(f"SELECT o_orderkey, {int_hex('o_orderkey * 1000003 - 5000000000')} AS key_hex FROM orders")
def key_encode_int(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.hex(K.int_part(F.col("o_orderkey") * 1000003 - 5000000000)).alias("key_hex"))


@query(f"SELECT page_id, {text_hex('url')} AS key_hex FROM pages")
def key_encode_str(spark, d):
    return pages(spark, d).select("page_id", F.hex("k").alias("key_hex"))


@query(f"SELECT doc_id, {text_hex('source')} || {int_hex('doc_id')} || {text_hex('lang', '03')} AS key_hex FROM documents")
def key_encode_tuple(spark, d):
    df = read(spark, d, "documents").select("doc_id", "source", "lang")
    k = K.key(K.str_part(F.col("source")), K.int_part(F.col("doc_id")), K.bytes_part(F.encode("lang", "UTF-8")))
    return df.select("doc_id", F.hex(k).alias("key_hex"))


@query("SELECT page_id, url AS decoded, -page_id AS number FROM pages")
def key_decode(spark, d):
    df = pages(spark, d).withColumn("i", K.int_part(-F.col("page_id")))
    return df.select("page_id", K.decode_str(F.col("k")).alias("decoded"), K.decode_int(F.col("i")).alias("number"))


@query("SELECT conv_id, turn, conv_id AS part1, turn AS part2, 2::BIGINT AS parts FROM conversations")
def key_decode_tuple(spark, d):
    df = conversations(spark, d)
    # The shape of the keys is known: two ints of nine bytes.
    return df.select("conv_id", "turn", K.decode_int(F.col("k"), 1).alias("part1"), K.decode_int(F.col("k"), 10).alias("part2"), F.floor(F.octet_length("k") / 9).alias("parts"))


@query("SELECT doc_id, 3::BIGINT AS parts, source AS part1, doc_id AS part2, lang AS part3 FROM documents")
def key_decode_any(spark, d):
    """Keys of any shape, component by component."""
    df = read(spark, d, "documents").select("doc_id", "source", "lang")
    k = K.key(K.str_part(F.col("source")), K.int_part(F.col("doc_id")), K.bytes_part(F.encode("lang", "UTF-8")))
    p = F.col("p")
    return df.select("doc_id", K.decode_parts(k).alias("p")).select("doc_id", F.size("p").cast("bigint").alias("parts"), p[0]["s"].alias("part1"), p[1]["i"].alias("part2"), F.decode(p[2]["b"], "UTF-8").alias("part3"))


@query(f"SELECT key_hex, kind, name, row_number() OVER (ORDER BY t, i, s) AS rank FROM {_MIXED}")
def mixed_type_order(spark, d):
    return hexed(shown(stored(spark, d, "mixed").ranked_df(), _MIXED_FIELDS))


def utc_micros(df: DataFrame, column: str) -> Column:
    return F.unix_micros(D.as_utc(df, column))


@query("SELECT event_id, (round(epoch_us(ts) / 1000.0) * 1000)::BIGINT AS micros FROM events")
def ms_round(spark, d):
    df = read(spark, d, "events")
    return df.select("event_id", F.unix_micros(D.round_millis(D.as_utc(df, "ts"))).alias("micros"))


@query("SELECT o_orderkey, CASE WHEN v BETWEEN -128 AND 127 THEN 1 WHEN v BETWEEN -32768 AND 32767 THEN 2 WHEN v BETWEEN -2147483648 AND 2147483647 THEN 4 ELSE 8 END AS bytes, v AS value FROM (SELECT o_orderkey, o_orderkey * 300000 - 1500000 AS v FROM orders)")
def int_narrow(spark, d):
    """How many bytes the encoded document spends on an int, and the int read back."""
    df = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 300000 - 1500000).alias("value"))
    docs = df.select("o_orderkey", F.struct("value").alias("s")).select("o_orderkey", F.to_variant_object("s").alias("doc"))
    # The type that Spark's own schema names is the one stored: all integers read as bigint, so the width is told by what a cast keeps.
    value = D.field(F.col("doc"), "value", "bigint")
    width = F.when(D.field(F.col("doc"), "value", "tinyint").isNotNull(), 1).when(D.field(F.col("doc"), "value", "smallint").isNotNull(), 2).when(D.field(F.col("doc"), "value", "int").isNotNull(), 4).otherwise(8)
    return docs.select("o_orderkey", width.alias("bytes"), value.alias("value"))


@query("SELECT event_id, user_id, event_type, round(value * 1000)::BIGINT AS milli, (round(epoch_us(ts) / 1000.0) * 1000)::BIGINT AS micros FROM events")
def doc_roundtrip(spark, d):
    df = read(spark, d, "events")
    doc = df.select(D.document_of(df, "event_id", "user_id", "event_type", "value", "ts").alias("doc"))
    get = lambda n, t: D.field(F.col("doc"), n, t)
    return doc.select(get("event_id", "bigint").alias("event_id"), get("user_id", "bigint").alias("user_id"), get("event_type", "string").alias("event_type"), F.round(get("value", "double") * 1000).cast("bigint").alias("milli"), F.unix_micros(get("ts", "timestamp")).alias("micros"))


# Versions and models


def documents_of_orders(rows: DataFrame, *fields: str) -> DataFrame:
    return rows.select("k", D.document_of(rows, *fields).alias("doc"))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def snapshot_read(spark, d):
    """All orders of a bulk-loaded collection, as they were before it was cleared, written, compacted and vacuumed."""
    db = open_database()
    c = db["orders"]
    c.put_df(documents_of_orders(orders(spark, d), "o_orderkey", "o_orderstatus"))
    before = c.df()
    c.delete_df(before.where(D.field(F.col("doc"), "o_orderkey", "bigint") % 2 == 0))
    c[1] = {"o_orderkey": -1, "o_orderstatus": "later"}
    c.compact()
    db.vacuum()
    return shown(before, "o_orderkey bigint, o_orderstatus string").drop("k")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'put' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 5 <> 0")
def collection_merge(spark, d):
    """Bulk load, bulk put, bulk delete and compaction of all orders, through the collection."""
    rows = orders(spark, d).select("k", "o_orderkey", F.col("o_orderstatus").alias("status"))
    c = open_database()["orders"]
    c.put_df(documents_of_orders(rows, "o_orderkey", "status"))
    c.put_df(documents_of_orders(rows.where("o_orderkey % 3 = 0").withColumn("status", F.lit("put")), "o_orderkey", "status"))
    c.delete_df(rows.where("o_orderkey % 5 = 0"))
    c.compact()
    return shown(c.df(), "o_orderkey bigint, status string").drop("k")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS round FROM customer")
def stream_upserts(spark, d):
    """Two rounds of upserts as a stream would bring them, and what the collection then holds."""
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).cast("bigint").alias("round"))
    c = open_database()["customers"]
    for part in (rows, rows.where("id % 3 = 0").withColumn("round", F.lit(2).cast("bigint"))):
        c.put_df(documents_of_orders(keyed(part, "id"), "id", "round"))
    return shown(c.df(), "id bigint, round int").drop("k")


@query("SELECT r_name AS name, r_regionkey AS id, true AS reopened FROM region WHERE r_regionkey <> 2")
def durable_reopen(spark, d):
    """A database directory: written, closed, opened again, read."""
    folder = tempfile.mkdtemp(prefix="ordinate-reopen-")
    try:
        with open_database(folder) as db:
            db["region"].update({r["r_name"]: {"id": r["r_regionkey"]} for r in read(spark, d, "region").collect()})  # five rows by definition of the table
            del db["region"][next(k for k, v in db["region"].items() if v["id"] == 2)]
        with open_database(folder, durable=False) as db:
            return spark.createDataFrame([(k, v["id"], True) for k, v in db["region"].items()], "name string, id int, reopened boolean")
    finally:
        shutil.rmtree(folder, ignore_errors=True)


@query("SELECT n_name AS name, n_nationkey AS id FROM nation")
def cursor(spark, d):
    """A scan keeps its version while the collection changes under it."""
    with open_database() as db:
        c = db["nation"]
        c.update({r["n_name"]: {"id": r["n_nationkey"]} for r in read(spark, d, "nation").collect()})  # 25 rows by definition of the table
        pairs = c.items()
        out = [next(pairs)]
        c.clear()
        return spark.createDataFrame([(k, v["id"]) for k, v in [*out, *pairs]], "name string, id int")


@query(f"SELECT {text_hex('n_name')} || {int_hex('n_nationkey - 12')} AS key_hex, n_name AS name, n_nationkey - 12 AS number FROM nation")
def key_from_py(spark, d):
    """Keys encoded and decoded one by one on the driver, as single operations do."""
    rows = []
    for r in read(spark, d, "nation").collect():  # 25 rows by definition of the table
        k = K.encode((r["n_name"], r["n_nationkey"] - 12))
        rows.append((k.hex().upper(), *K.decode(k)))
    return spark.createDataFrame(rows, "key_hex string, name string, number int")


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation")
def model_write(spark, d):
    """Instances of a model, put and read through a bound handle."""
    with open_database() as db:
        nations = db.collection("nations", Nation)
        nations.update({r["n_nationkey"]: Nation(r["n_nationkey"], r["n_name"], r["n_regionkey"]) for r in read(spark, d, "nation").collect()})  # 25 rows by definition of the table
        return spark.createDataFrame([(n.id, n.name, n.region) for n in nations.values()], "id int, name string, region int")


@query("SELECT * FROM (VALUES ('no such collection is empty', true), ('a handle creates nothing', true), ('a bound handle reads instances', true), ('an empty name is refused', true), ('a name is text', true), ('a dropped collection is gone', true), ('a closed database refuses', true), ('one writer at a time', true), ('a failed batch leaves nothing', true), ('an update is one commit', true)) AS t(what, holds)")
def manners(spark, d):
    """What a database promises about handles, names, commits and its end."""

    def refused(error, f):
        try:
            f()
        except error:
            return True
        return False

    folder = tempfile.mkdtemp(prefix="ordinate-manners-")
    try:
        with open_database(folder) as db:
            out = [("no such collection is empty", db.get("none") is not None and len(db["none"]) == 0), ("a handle creates nothing", "none" not in db and len(db) == 0)]
            db.collection("n", Nation)[1] = Nation(1, "x", 0)
            out.append(("a bound handle reads instances", db.collection("n", Nation)[1] == Nation(1, "x", 0)))
            out.append(("an empty name is refused", refused(ValueError, lambda: db[""])))
            out.append(("a name is text", refused(TypeError, lambda: db[1])))
            out.append(("one writer at a time", refused(Error, lambda: open_database(folder))))
            before = db._store.now().number
            db["n"].update({i: {"i": i} for i in range(10)})
            out.append(("an update is one commit", db._store.now().number == before + 1))
            out.append(("a failed batch leaves nothing", refused(TypeError, lambda: db["bad"].update({1: {}, 2: 3})) and "bad" not in db))
            del db["n"]
            out.append(("a dropped collection is gone", "n" not in db and len(db["n"]) == 0))
        out.append(("a closed database refuses", refused(Error, lambda: list(db))))
        return spark.createDataFrame(out, "what string, holds boolean")
    finally:
        shutil.rmtree(folder, ignore_errors=True)


@dataclass
class Nation:
    id: int
    name: str
    region: int


@dataclass
class Customer:
    c_custkey: int
    c_name: str
    c_mktsegment: str


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def model_view(spark, d):
    df = read(spark, d, "customer")
    docs = keyed(df, "c_mktsegment", "c_custkey").select("k", D.document_of(df).alias("doc"))
    return M.typed(docs, Customer).drop("k")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: a key range, in order, from the ordered keys of a collection."""
    df = read(spark, sf_dir, "orders")
    docs = keyed(df, "o_orderkey").select("k", "o_orderkey", D.document_of(df).alias("doc"))
    rows = R.ranked(R.key_range(docs, 100, 200))
    return rows.select("rank", "o_orderkey", D.field(F.col("doc"), "o_orderstatus", "string").alias("o_orderstatus"), D.field(F.col("doc"), "o_totalprice", "double").alias("o_totalprice"))
