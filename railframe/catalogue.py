"""The registered queries of the type engine: each applies types to a whole table, with SQL for the same rows.

The tables hold no nulls and uniform JSON, so queries that need other values derive them from keys, alike in both.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import types as t
from .sources import readers
from .sources.scratch import shared, tasks
from .streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PAID_ORDER = t.Hash(o_orderkey=t.Integer, o_orderstatus=t.String["F", "O"], o_totalprice=t.Float[t.between(50000, 200000)], o_orderpriority=t.String[t.Pattern("^[12]-")])


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus IN ('F','O') AND o_totalprice BETWEEN 50000 AND 200000 AND regexp_matches(o_orderpriority, '^[12]-')")
def record_parse(spark, sf):
    return t.filtered(table(spark, sf, "orders"), t.Stream[PAID_ORDER])


@query("""
    WITH e AS (
        SELECT CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END AS q, CASE WHEN NOT (l_discount >= 0.02) THEN 1 ELSE 0 END AS d,
               CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 1 ELSE 0 END AS r FROM lineitem)
    SELECT 'l_quantity' AS path, 'Must be within 1..40' AS message, CAST(sum(q) AS BIGINT) AS "rows" FROM e HAVING sum(q) > 0
    UNION ALL SELECT 'l_discount', 'Must be within 0.02..', CAST(sum(d) AS BIGINT) FROM e HAVING sum(d) > 0
    UNION ALL SELECT 'l_returnflag', 'Must be included in ["A", "N"]', CAST(sum(r) AS BIGINT) FROM e HAVING sum(r) > 0
""")
def record_errors(spark, sf):
    """All errors of a record, by path and message."""
    line = t.Hash(l_quantity=t.Float[t.between(1, 40)], l_discount=t.Float[t.between(0.02)], l_returnflag=t.String["A", "N"])
    return t.report(table(spark, sf, "lineitem"), line)


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'view' THEN 2 ELSE length(event_type) END AS kind FROM events")
def union_left_bias(spark, sf):
    """Choices try left first, and the right branch on the original value."""
    code = t.Value["purchase"].transform(t.Integer, lambda c: F.lit(1)) | t.Value["view"].transform(t.Integer, lambda c: F.lit(2)) | t.String.transform(t.Integer, lambda c: F.length(c))
    df = table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"))
    return t.filtered(df, t.Hash(event_id=t.Integer, kind=code)).withColumn("kind", F.col("kind").cast("bigint"))


@query("""
    SELECT l_orderkey, l_linenumber,
           CASE l_orderkey % 4 WHEN 0 THEN CAST(trunc(l_extendedprice) AS BIGINT) WHEN 1 THEN CAST(trunc(l_extendedprice) AS BIGINT) WHEN 2 THEN CAST(trunc(l_quantity) AS BIGINT) END AS amount,
           l_orderkey % 4 <> 3 AS ok
    FROM lineitem
""")
def lax_integer(spark, sf):
    """Numbers as text, with and without thousands separators, and text that is none."""
    grouped = F.format_number(F.floor("l_extendedprice"), 0)
    raw = F.when(F.col("l_orderkey") % 4 == 0, grouped).when(F.col("l_orderkey") % 4 == 1, F.floor("l_extendedprice").cast("string")).when(F.col("l_orderkey") % 4 == 2, F.concat(F.floor("l_quantity").cast("string"), F.lit(".7"))).otherwise(F.lit("n/a"))
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("amount"))
    return t.validate(df, t.Hash(l_orderkey=t.Integer, l_linenumber=t.Integer, amount=t.Lax.Integer)).drop("errors").withColumn("amount", F.when(F.col("ok"), F.col("amount")))


@query("SELECT p_partkey, CAST(p_retailprice AS DECIMAL(38,2)) AS price FROM part")
def lax_decimal(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.format_number("p_retailprice", 2).alias("price"))
    out = t.filtered(df, t.Hash(p_partkey=t.Integer, price=t.Lax.Decimal))
    return out.withColumn("price", F.col("price").cast("decimal(38,2)"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_text, p_name AS name_text FROM part")
def lax_string(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("size_text"), F.col("p_name").alias("name_text"))
    return t.filtered(df, t.Hash(p_partkey=t.Integer, size_text=t.Lax.String, name_text=t.Lax.String))


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 AND c_acctbal >= 0 THEN c_acctbal END AS c_acctbal, 'retail' AS channel, 1 AS version,
           NOT (c_custkey % 7 <> 0 AND c_acctbal < 0) AS ok
    FROM customer
""")
def nullable_default_static(spark, sf):
    """Null where it may be, a default for a column that is not there, a constant."""
    df = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    who = t.Hash(c_custkey=t.Integer, c_acctbal=t.Float[t.between(0)].nullable(), channel=t.String.default("retail"), version=t.Integer.static(1))
    return t.validate(df, who).drop("errors").withColumn("version", F.col("version").cast("int"))


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12') AND NOT (p_size BETWEEN 1 AND 10) AND p_size NOT IN (20, 21)")
def not_excluded_options(spark, sf):
    kind = t.Hash(p_partkey=t.Integer, p_brand=t.String.excluded_from(["Brand#11", "Brand#12"]), p_size=t.Integer >> ~t.Integer[t.between(1, 10)] >> t.Integer.excluded_from([20, 21]))
    return t.filtered(table(spark, sf, "part"), kind)


@query("SELECT doc_id, text FROM documents WHERE length(text) BETWEEN 200 AND 900 AND strlen(text) <> length(text) AND length(lang) = 2")
def where_size(spark, sf):
    """Attributes: characters and bytes of a text."""
    wide = t.String.where(size=t.between(0, 900)).where(size=t.between(200, 5000)).check(lambda c: F.octet_length(c) != F.length(c), "must have wide characters")
    df = t.filtered(table(spark, sf, "documents"), t.Hash(doc_id=t.Integer, text=wide, lang=t.String.where(size=2)))
    return df.drop("lang")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 40")
def meet_ranges(spark, sf):
    """Ranges fold into one when the type is built."""
    between = (t.Float[t.between(0, 100)][t.between(10)]) & t.Float[t.between(-5, 40)]
    return t.filtered(table(spark, sf, "lineitem"), t.Hash(l_orderkey=t.Integer, l_linenumber=t.Integer, l_quantity=between))


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE false")
def never_empty(spark, sf):
    """Types without a value in common meet in Never: no row is read."""
    none = t.Float[t.between(0, 10)] & t.Float[t.between(11, 100)]
    return t.filtered(table(spark, sf, "lineitem"), t.Hash(l_orderkey=t.Integer, l_quantity=t.Float >> none)).select("l_orderkey", F.col("l_quantity").cast("double").alias("l_quantity"))


@query("""
    SELECT event_id, event_type, CASE WHEN event_type IN ('purchase', 'signup') THEN value END AS value,
           CASE WHEN event_type IN ('view', 'purchase') THEN user_id END AS user_id,
           CASE WHEN event_type = 'purchase' THEN value >= 10 ELSE event_type IN ('view', 'signup') END AS ok
    FROM events
""")
def tagged_events(spark, sf):
    """A field chooses the record; unknown tags are invalid."""
    event = t.Hash.tagged_by(
        "event_type",
        t.Hash(event_id=t.Integer, event_type="purchase", value=t.Float[t.between(10)], user_id=t.Integer),
        t.Hash(event_id=t.Integer, event_type="view", user_id=t.Integer),
        t.Hash(event_id=t.Integer, event_type="signup", value=t.Float),
    )
    df = table(spark, sf, "events").select("event_id", "event_type", F.struct("event_id", "event_type", "value", "user_id").alias("event"))
    return t.validate(df, event, "event").select("event_id", "event_type", "event.value", "event.user_id", "ok")


@query("SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN text END AS text FROM conversations WHERE role = 'system' OR (role = 'user' AND length(text) >= 50)")
def tagged_conversations(spark, sf):
    turn = t.Hash.tagged_by("role", t.Hash(conv_id=t.Integer, turn=t.Integer, role="user", text=t.String.where(size=t.between(50))), t.Hash(conv_id=t.Integer, turn=t.Integer, role="system"))
    return t.filtered(table(spark, sf, "conversations"), turn)


@query("SELECT vec_id, len(list_filter(embedding, lambda x: NOT (x >= -0.2 AND x <= 0.2))) = 0 AS ok FROM embeddings")
def array_elements(spark, sf):
    return t.validate(table(spark, sf, "embeddings"), t.Hash(vec_id=t.Integer, embedding=t.Array[t.Float[t.between(-0.2, 0.2)]])).select("vec_id", "ok")


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x >= 0)) AS kept, round(coalesce(list_sum(list_transform(list_filter(embedding, lambda x: x >= 0), lambda x: CAST(x AS DOUBLE))), 0), 6) AS total FROM embeddings")
def array_filtered(spark, sf):
    df = t.filtered(table(spark, sf, "embeddings"), t.Hash(vec_id=t.Integer, embedding=t.Array[t.Float[t.between(0)]].filtered()))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return df.select("vec_id", F.size("embedding").cast("bigint").alias("kept"), F.round(total, 6).alias("total"))


@query("SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS words FROM documents WHERE len(string_split(text, ' ')) BETWEEN 10 AND 60")
def array_where_size(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.split("text", " ", -1).alias("words"))
    return t.filtered(df, t.Hash(doc_id=t.Integer, words=t.Array[t.String].where(size=t.between(10, 60)))).withColumn("words", F.size("words").cast("bigint"))


@query("SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS rank, substr(o_orderpriority, 3) AS name FROM orders WHERE o_orderkey % 5 <> 0 AND substr(o_orderpriority, 1, 1) IN ('1', '2', '3')")
def tuple_rows(spark, sf):
    """Lists of two parts; every fifth has a third one and fails."""
    parts = F.split("o_orderpriority", "-", 2)
    df = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.concat(parts, F.array(F.lit("x")))).otherwise(parts).alias("pair"))
    out = t.filtered(df, t.Hash(o_orderkey=t.Integer, pair=t.Tuple[t.String["1", "2", "3"], t.String.where(size=t.between(3))]))
    return out.select("o_orderkey", F.col("pair._0").alias("rank"), F.col("pair._1").alias("name"))


DIRTY = "CASE event_id % 5 WHEN 0 THEN '{\"k\": \"' || user_id || '\"}' WHEN 1 THEN '{\"k\": null}' WHEN 2 THEN '{\"j\": 1}' WHEN 3 THEN '{\"k\": ' || user_id || ', \"x_a\": 1, \"y\": \"s\"}' ELSE '[1]' END"


def dirty_events(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", F.expr(DIRTY).alias("props"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 3 THEN user_id END AS k, event_id % 5 = 3 AS ok FROM events")
def map_props(spark, sf):
    """JSON objects: absent keys, nulls, text and other values than objects are told apart."""
    df = readers.from_json(dirty_events(spark, sf), "props")
    out = t.validate(df, t.Hash(k=t.Integer), "props")
    return out.select("event_id", F.when(F.col("ok"), F.col("props.k")).alias("k"), "ok")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'k: Must be a Integer' WHEN 1 THEN 'k: Must be a Integer' WHEN 2 THEN 'k: Must be a Integer' WHEN 4 THEN ': must be a Hash' ELSE '' END AS said FROM events")
def variant_errors(spark, sf):
    df = readers.from_json(dirty_events(spark, sf), "props")
    out = t.validate(df, t.Hash(k=t.Integer), "props")
    return out.select("event_id", F.array_join(F.transform("errors", lambda e: F.concat(e["path"], F.lit(": "), e["message"])), "; ").alias("said"))


@query("SELECT event_id, CASE event_id % 5 WHEN 3 THEN 2 WHEN 2 THEN 1 WHEN 4 THEN NULL ELSE 0 END AS others, event_id % 5 IN (0, 1, 2) AS ok FROM events")
def catch_all(spark, sf):
    """Undeclared keys through one type: y is text, so it fails where integers are asked for."""
    df = readers.from_json(dirty_events(spark, sf), "props")
    out = t.validate(df, t.Hash({"k?": t.Anything, "_": t.Integer}), "props")
    return out.select("event_id", F.size("props._").alias("others"), "ok")


@query("SELECT event_id, CASE WHEN event_id % 5 = 3 THEN CAST(1 AS BIGINT) END AS x_a, event_id % 5 <> 4 AS ok FROM events")
def typed_keys(spark, sf):
    """Keys by pattern; other keys are dropped."""
    df = readers.from_json(dirty_events(spark, sf), "props")
    out = t.validate(df, t.Hash({re.compile("^x_"): t.Integer}), "props")
    return out.select("event_id", F.try_element_at("props._", F.lit("x_a")).alias("x_a"), "ok")


@query("SELECT event_id, CASE event_id % 5 WHEN 3 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS kept FROM events WHERE event_id % 5 <> 4")
def map_filtered(spark, sf):
    """Entries whose value is an integer."""
    df = readers.from_json(dirty_events(spark, sf), "props")
    out = t.filtered(df, t.Hash[t.String, t.Integer].filtered(), "props")
    return out.select("event_id", F.size("props").alias("kept"))


@query("SELECT doc_id, CAST(CASE WHEN kept = '' THEN 0 ELSE len(string_split_regex(kept, '\\s*,\\s*')) END AS BIGINT) AS parts FROM (SELECT doc_id, regexp_replace(text, '(\\s*,\\s*)+$', '') AS kept FROM documents)")
def split_policy(spark, sf):
    """Split whole texts at commas with the white space around them; empty parts at the end are no parts."""
    out = t.filtered(table(spark, sf, "documents").select("doc_id", F.col("text").alias("parts")), t.Hash(doc_id=t.Integer, parts=t.String.split()))
    return out.withColumn("parts", F.size("parts").cast("bigint"))


@query("SELECT doc_id, CAST(CASE WHEN kept = '' THEN 0 ELSE len(string_split(kept, '. ')) END AS BIGINT) AS parts FROM (SELECT doc_id, regexp_replace(text, '(\\. )+$', '') AS kept FROM documents)")
def split_text(spark, sf):
    """Split whole texts at a literal separator; empty parts at the end are no parts."""
    out = t.filtered(table(spark, sf, "documents").select("doc_id", F.col("text").alias("parts")), t.Hash(doc_id=t.Integer, parts=t.String.split(". ")))
    return out.withColumn("parts", F.size("parts").cast("bigint"))


@query("SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages WHERE regexp_matches(url, '^https?://[^\\s]+$')")
def uri_http(spark, sf):
    df = table(spark, sf, "pages").select("page_id", "url", F.col("url").alias("host"))
    return t.filtered(df, t.Hash(page_id=t.Integer, url=t.HTTPURI, host=t.HTTPURI.invoke("extract", r"^https?://([^/?#]+)", 1)))


@query(r"""
    SELECT page_id, regexp_extract(url, '^([^:/?#]+):', 1) AS scheme, regexp_extract(url, '^[^:/?#]+://([^/?#:@]*)', 1) AS host,
           CAST(page_id % 7 + 8000 AS BIGINT) AS port, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path, 'id=' || page_id AS query
    FROM pages WHERE regexp_matches(url, '^https?://[^\s/?#:@]+(/[^\s?#]*)?$')
""")
def uri_parts(spark, sf):
    """URLs, given a port and a query, as values of their parts; what is no such URI is invalid and gone."""
    url = F.col("url")
    made = F.when(url.rlike(r"^https?://[^\s/?#:@]+(/[^\s?#]*)?$"), F.regexp_replace(url, "^([^:]+://[^/]+)(.*)$", F.concat(F.lit("$1:"), (F.col("page_id") % 7 + 8000).cast("string"), F.lit("$2?id="), F.col("page_id").cast("string"))))
    df = table(spark, sf, "pages").select("page_id", made.alias("url"))
    return t.filtered(df, t.JSON >> t.Hash(page_id=t.Integer, url=t.HTTPParts)).select("page_id", *(f"url.{c}" for c in ("scheme", "host", "port", "path", "query")))


@query("SELECT page_id, 'https://' || lower(url) || '.example:8443/p?q=' || page_id || '#top' AS url FROM (SELECT page_id, regexp_extract(url, '^https?://([A-Za-z0-9-]+)', 1) AS url FROM pages) WHERE url <> ''")
def uri_text(spark, sf):
    """Values of URI parts, written as text; a host that is none (here an empty one's slash) would be read otherwise and is invalid."""
    host = F.regexp_extract("url", "^https?://([A-Za-z0-9-]+)", 1)
    parts = {"scheme": F.lit("https"), "user": F.lit(None).cast("string"), "host": F.when(host == "", F.lit("a/b")).otherwise(F.concat(F.lower(host), F.lit(".example"))), "port": F.lit(8443).cast("bigint"), "path": F.lit("/p"), "query": F.concat(F.lit("q="), F.col("page_id").cast("string")), "fragment": F.lit("top")}
    df = table(spark, sf, "pages").select("page_id", F.struct(*(c.alias(k) for k, c in parts.items())).alias("url"))
    return t.filtered(df, t.JSON.encoder_of(t.Hash(page_id=t.Integer, url=t.URIParts)))


@query("""
    SELECT c_custkey, c_custkey % 3 <> 0 AS email_ok, c_custkey % 4 <> 0 AS uuid_ok FROM customer
""")
def email_uuid(spark, sf):
    key = F.col("c_custkey")
    mail = F.concat(F.lit("c"), key, F.when(key % 3 == 0, F.lit(" at x")).otherwise(F.lit("@example.com")))
    hexes = F.lpad(F.lower(F.hex(key)), 12, "0")
    uuid = F.concat(F.lit("9f5a5b0a-1b3d-4c5e-8f7a-"), F.when(key % 4 == 0, F.lit("zz")).otherwise(hexes))
    df = table(spark, sf, "customer").select("c_custkey", mail.alias("mail"), uuid.alias("uuid"))
    out = t.validate(df, t.Hash(c_custkey=t.Integer, mail=t.Email, uuid=t.UUID4))
    path = lambda p: ~F.exists("errors", lambda e: e["path"] == p)
    return out.select("c_custkey", path("mail").alias("email_ok"), path("uuid").alias("uuid_ok"))


ORDER_FORM = t.Hash(o_orderkey=t.Integer, o_orderdate=t.Date, o_totalprice=t.Float, urgent=t.Boolean)


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS o_orderdate, o_totalprice, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority LIKE '1%' END AS urgent,
           o_orderkey % 6 <> 0 AND o_orderkey % 11 <> 0 AS ok
    FROM orders
""")
def forms_decode(spark, sf):
    """All fields as text, as a form sends them; some dates and flags do not look right."""
    key = F.col("o_orderkey")
    df = table(spark, sf, "orders").select(
        key.cast("string").alias("o_orderkey"),
        F.when(key % 6 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("o_orderdate"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.when(key % 11 == 0, F.lit("yes")).when(F.col("o_orderpriority").startswith("1"), F.lit("1")).otherwise(F.lit("FALSE")).alias("urgent"),
    )
    return t.validate(df, t.FORMS >> ORDER_FORM).drop("errors")  # what cannot be decoded is null


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, CASE WHEN o_orderpriority LIKE '1%' THEN 'true' ELSE 'false' END AS urgent FROM orders")
def forms_encode(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), F.col("o_orderpriority").startswith("1").alias("urgent"))
    return t.filtered(df, t.FORMS.encoder_of(t.Hash(o_orderkey=t.Integer, o_orderdate=t.Date, urgent=t.Boolean)))


@query("""SELECT '{"l_orderkey":' || l_orderkey || ',"l_shipdate":"' || strftime(l_shipdate, '%Y-%m-%d') || '","l_returnflag":"' || l_returnflag || '"}' AS json FROM lineitem""")
def json_encode(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("l_shipdate"), "l_returnflag")
    return readers.to_json(df, t.JSON.encoder_of(t.Hash(l_orderkey=t.Integer, l_shipdate=t.Date, l_returnflag=t.String)))


@query("SELECT l_orderkey, l_linenumber, l_quantity <= 40 AND (l_linenumber % 3 = 0 OR l_quantity + 5 <= 40) AS ok FROM lineitem")
def range_struct(spark, sf):
    """Ranges with ends of one type; a null end is open."""
    end = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity") + 5)
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.struct(F.col("l_quantity").alias("from"), end.alias("to")).alias("span"))
    return t.validate(df, t.Hash(l_orderkey=t.Integer, l_linenumber=t.Integer, span=t.Range[t.Float[t.between(0, 40)]])).select("l_orderkey", "l_linenumber", "ok")


@query("SELECT p_partkey, lower(trim(p_name)) AS name, list_transform(string_split(p_type, ' '), lambda x: lower(x)) AS words FROM part")
def pipeline_fused(spark, sf):
    """Two passes over an array's elements become one."""
    words = t.Array[t.String] >> t.Array[t.String.invoke("strip")] >> t.Array[t.String.invoke("downcase")]
    name = t.Anything.pipeline().step(t.String).step(t.String.invoke("strip")).step(t.String.invoke("downcase"))
    df = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.split("p_type", " ").alias("words"))
    return t.filtered(df, t.Hash(p_partkey=t.Integer, name=name, words=words))


class Customer(t.Struct):
    c_custkey = t.attribute(t.Integer)
    c_name = t.attribute(t.String.present())
    c_acctbal = t.attribute(t.Float[t.between(0)], writer=True)
    c_nickname = t.attribute(t.String, optional=True)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 0")
def struct_parse(spark, sf):
    return t.filtered(table(spark, sf, "customer"), Customer.of())


@query("SELECT c_custkey, c_acctbal - 1000 AS c_acctbal, c_acctbal - 1000 >= 0 AS ok FROM customer")
def struct_with(spark, sf):
    """An attribute set anew is validated anew."""
    out = Customer.set(table(spark, sf, "customer"), "c_acctbal", F.col("c_acctbal") - 1000)
    return out.select("c_custkey", "c_acctbal", "ok")


EVENT = t.Hash(event_id=t.Integer, event_type=t.String["purchase", "click"], value=t.Float[t.between(5)])


def event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return streams.files(spark, sf, schema, "events.parquet*")


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('purchase', 'click') AND value >= 5")
def stream_valid(spark, sf):
    return streams.to_files(streams.valid(event_stream(spark, sf), EVENT))


@query("SELECT event_id, CAST((event_type NOT IN ('purchase', 'click'))::INT + (value < 5)::INT AS INTEGER) AS errors FROM events WHERE NOT (event_type IN ('purchase', 'click') AND value >= 5)")
def stream_invalid(spark, sf):
    judged = streams.judged(event_stream(spark, sf), EVENT).where("NOT ok").select("event_id", F.size("errors").alias("errors"))
    return streams.to_files(judged)


def linked_list():
    return t.Hash(value=t.Integer, next=t.Nil | t.defer(linked_list))


@query("SELECT o_orderkey, o_orderkey % 3 <> 2 AS ok FROM orders")
def recursive_list(spark, sf):
    """A type that holds itself, on JSON made of each row; every third has a text where the second value should be."""
    key = F.col("o_orderkey")
    inner = F.when(key % 3 == 0, F.lit("null")).when(key % 3 == 1, F.concat(F.lit('{"value": '), key, F.lit(', "next": null}'))).otherwise(F.lit('{"value": "x", "next": null}'))
    df = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit('{"value": 1, "next": '), inner, F.lit("}")).alias("list"))
    return t.validate(readers.from_json(df, "list"), t.defer(linked_list), "list").select("o_orderkey", "ok")


@query("SELECT p_partkey, p_size, p_size % 2 = 0 AND p_size >= 10 AS ok FROM part")
def checks_and_meet(spark, sf):
    even = t.Integer.check(lambda c: c % 2 == 0, "must be even")
    return t.validate(table(spark, sf, "part"), t.Hash(p_partkey=t.Integer, p_size=even & t.Integer[t.between(10)])).drop("errors")


@query("SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS s_acctbal, s_name FROM supplier")
def record_filtered(spark, sf):
    """Fields that are not valid are left out."""
    return t.filtered(table(spark, sf, "supplier"), t.Hash(s_suppkey=t.Integer, s_acctbal=t.Float[t.between(0)], s_name=t.String).filtered())


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size BETWEEN 5 AND 35 AND length(p_name) <= 11")
def record_meet(spark, sf):
    """Keys of both records with what both ask."""
    both = t.Hash(p_partkey=t.Integer, p_size=t.Integer[t.between(5)], p_name=t.String) & t.Hash(p_partkey=t.Integer, p_size=t.Integer[t.between(0, 35)], p_name=t.String.where(size=t.between(0, 11)))
    return t.filtered(table(spark, sf, "part"), both).select("p_partkey", "p_name", "p_size")


@query("SELECT c_custkey, upper(c_mktsegment) AS c_mktsegment, CAST(length(c_name) AS INTEGER) AS size FROM customer")
def methods(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_name").alias("size"))
    return t.filtered(df, t.Hash(c_custkey=t.Integer, c_mktsegment=t.String.invoke(["downcase", "strip", "upcase"]), size=t.String.invoke("size")))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value ELSE user_id END AS value FROM events WHERE event_id % 3 <> 2")
def json_numbers(spark, sf):
    """Integers or fractions out of JSON, and text that is neither."""
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"v": '), F.col("value").cast("string"), F.lit("}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"v": '), F.col("user_id"), F.lit("}"))).otherwise(F.lit('{"v": "x"}'))
    df = readers.from_json(table(spark, sf, "events").select("event_id", raw.alias("props")), "props")
    return t.filtered(df, t.Hash(v=t.Numeric), "props").select("event_id", F.col("props.v").cast("double").alias("value"))


@query("SELECT c_custkey, 'seg_' || lower(c_mktsegment) AS segment FROM customer WHERE c_mktsegment NOT IN ('BUILDING')")
def environment_map(spark, sf):
    """A configuration map's entries by prefix, then a record on them."""
    env = F.create_map(F.lit("APP_SEGMENT"), F.col("c_mktsegment"), F.lit("PATH"), F.lit("/bin"))
    df = readers.environment(table(spark, sf, "customer").select("c_custkey", env.alias("env")), "APP_", "env")
    segment = t.String.excluded_from(["BUILDING"]).invoke("downcase").transform(t.String, lambda c: F.concat(F.lit("seg_"), c))
    return t.filtered(df, t.Hash(segment=segment), "env").select("c_custkey", F.col("env.segment").alias("segment"))


@query("SELECT vec_id, place, CAST(element AS DOUBLE) AS element FROM (SELECT vec_id, unnest(range(len(embedding))) AS place, unnest(embedding) AS element FROM embeddings) WHERE element >= 0.3")
def array_stream(spark, sf):
    """An array's elements as rows."""
    df = t.exploded(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", t.Float[t.between(0.3)])
    return df.where("ok").select("vec_id", F.col("place").cast("bigint").alias("place"), F.col("element").cast("double").alias("element"))


@query("SELECT p_partkey, CAST(p_size + 20 AS BIGINT) AS size FROM part")
def chain_of_twenty(spark, sf):
    """Twenty conversions and checks after one another: their plan grows with their number, and no faster."""
    size = t.Lax.Integer
    for _ in range(20):
        size = size.transform(t.Integer, lambda c: c + 1).check(lambda c: c > 0, "must be positive")
    return t.filtered(table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("size")), t.Hash(p_partkey=t.Integer, size=size))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderkey AS BIGINT) END AS n, o_orderkey % 10 <> 0 AS ok FROM orders")
def arrays_four_deep(spark, sf):
    """Elements are judged once at each depth."""
    text = F.when(F.col("o_orderkey") % 10 == 0, F.lit("x")).otherwise(F.col("o_orderkey").cast("string"))
    df = table(spark, sf, "orders").select("o_orderkey", F.array(F.array(F.array(F.array(text)))).alias("n"))
    out = t.validate(df, t.Hash(o_orderkey=t.Integer, n=t.Array[t.Array[t.Array[t.Array[t.Lax.Integer]]]]))
    return out.select("o_orderkey", F.when(F.col("ok"), F.col("n")[0][0][0][0]).alias("n"), "ok")


@query("SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN 1000000 + o_orderkey % 1000000 WHEN 1 THEN (12000 + o_orderkey % 1000) * 1000 + 345 END AS BIGINT) AS amount, o_orderkey % 4 < 2 AS ok FROM orders")
def lax_mixed_separators(spark, sf):
    """A thousands separator may stand before each three digits, or not."""
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("1,"), F.lpad((k % 1000000).cast("string"), 6, "0"))).when(k % 4 == 1, F.concat(F.lit("12"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(",345"))).when(k % 4 == 2, F.lit("1,23")).otherwise(F.lit("1,2345"))
    out = t.validate(table(spark, sf, "orders").select("o_orderkey", raw.alias("amount")), t.Hash(o_orderkey=t.Integer, amount=t.Lax.Integer))
    return out.select("o_orderkey", F.when(F.col("ok"), F.col("amount")).alias("amount"), "ok")


@query("SELECT c_custkey, c_custkey % 6 IN (0, 1, 2) AS ok FROM customer")
def email_edges(spark, sf):
    forms = F.array(F.concat(F.lit("c"), F.col("c_custkey"), F.lit("@example.com")), F.lit("a@x"), F.lit("a.b+c@x-y.z"), F.lit("a@-b..c"), F.lit('a"b@x'), F.lit("a b@x.y"))
    df = table(spark, sf, "customer").select("c_custkey", forms[(F.col("c_custkey") % 6).cast("int")].alias("mail"))
    return t.validate(df, t.Hash(c_custkey=t.Integer, mail=t.Email)).select("c_custkey", "ok")


@query("""
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 20:15:00'
           WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 20:15:23' END AS said, o_orderkey % 4 <> 3 AS ok
    FROM orders
""")
def json_times(spark, sf):
    """Times without a zone, without seconds, and days alone."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, day).when(k == 1, F.concat(day, F.lit(" 20:15"))).when(k == 2, F.concat(day, F.lit("T20:15:23"))).otherwise(F.concat(day, F.lit("T20")))
    out = t.validate(table(spark, sf, "orders").select("o_orderkey", raw.alias("said")), t.JSON >> t.Hash(o_orderkey=t.Integer, said=t.Time))
    return out.select("o_orderkey", F.date_format(F.when(F.col("ok"), F.col("said")), "yyyy-MM-dd HH:mm:ss").alias("said"), "ok")


@query("SELECT s_suppkey, CAST(CASE s_suppkey % 4 WHEN 0 THEN 0.00001 WHEN 1 THEN 2500.0 WHEN 2 THEN -100.0 END AS DOUBLE) AS n, s_suppkey % 4 <> 3 AS ok FROM supplier")
def decimal_scientific(spark, sf):
    forms = F.array(F.lit("1.0e-05"), F.lit("2.5E3"), F.lit("-1e2"), F.lit("1e"))
    df = table(spark, sf, "supplier").select("s_suppkey", forms[(F.col("s_suppkey") % 4).cast("int")].alias("n"))
    out = t.validate(df, t.JSON >> t.Hash(s_suppkey=t.Integer, n=t.Decimal))
    return out.select("s_suppkey", F.when(F.col("ok"), F.col("n").cast("double")).alias("n"), "ok")


@query("SELECT p_partkey, p_size, p_brand FROM part WHERE p_size >= 10 AND regexp_matches(p_brand, '[135]$')")
def record_merge(spark, sf):
    """Fields of two records, the right one's where both have them."""
    both = t.Hash(p_partkey=t.Integer, p_size=t.String, p_brand=t.String) + t.Hash(p_size=t.Integer[t.between(10)], p_brand=t.String[t.Pattern("[135]$")])
    return t.filtered(table(spark, sf, "part"), both)


@query("SELECT event_id, event_id % 4 IN (1, 2) AS ok FROM events")
def interface_json(spark, sf):
    """Values of unlike kinds that answer a method."""
    forms = F.array(F.lit('{"v": 5}'), F.lit('{"v": "five"}'), F.lit('{"v": [5]}'), F.lit('{"v": true}'))
    df = table(spark, sf, "events").select("event_id", forms[(F.col("event_id") % 4).cast("int")].alias("props"))
    return t.validate(readers.from_json(df, "props"), t.Hash(v=t.Interface["size"]), "props").select("event_id", "ok")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND month(o_orderdate) IN (1, 2, 3)")
def date_attributes(spark, sf):
    first_quarters = t.Time.where(year=t.between(1996, 1998)).where(month=(1, 2, 3))
    return t.filtered(table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")), t.Hash(o_orderkey=t.Integer, o_orderdate=first_quarters)).select("o_orderkey")


@query("SELECT event_id, event_id % 5 <> 0 AND event_id % 7 <> 0 AS ok FROM events")
def map_parse(spark, sf):
    """A map's keys and values, each of a type; one that fails makes the row invalid."""
    key = F.when(F.col("event_id") % 5 == 0, F.lit("1x")).otherwise(F.lit("x1"))
    number = F.when(F.col("event_id") % 7 == 0, F.lit(-1)).otherwise(F.lit(1))
    df = table(spark, sf, "events").select("event_id", F.create_map(F.lit("a"), F.lit(3), key, number).alias("m"))
    return t.validate(df, t.Hash(event_id=t.Integer, m=t.Hash[t.String[t.Pattern("^[a-z]")], t.Integer[t.between(0)]])).select("event_id", "ok")


@query("SELECT p_partkey, list_sort(list_distinct(string_split(p_name, ' '))) AS words FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND NOT list_contains(string_split(p_name, ' '), 'small')")
def policies_on_arrays(spark, sf):
    """Options of text, words that an array must not have, and methods of arrays."""
    words = t.Array[t.String].excluded_from(["small"]).policy(respond_to="uniq").invoke(["uniq", "sort"])
    df = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("words"), "p_type")
    return t.filtered(df, t.Hash(p_partkey=t.Integer, words=words, p_type=t.String.options(["ECONOMY", "PROMO"]))).drop("p_type")


@query("SELECT c_custkey, upper(c_mktsegment) || '!!' AS segment FROM customer WHERE c_mktsegment <> 'BUILDING'")
def pipeline_around(spark, sf):
    """Middleware around the steps that come after it."""
    loud = lambda step: step >> t.String.transform(t.String, lambda c: F.concat(c, F.lit("!")))
    steps = t.String.excluded_from(["BUILDING"]).pipeline().around(loud).step(t.String.invoke("upcase")).step_checked(t.String)
    df = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return t.filtered(df, t.Hash(c_custkey=t.Integer, segment=steps))


@query()
def generated_ids(spark, sf):
    """A value made for each row, and a step in Python behind a guard: their rows are tested, not compared."""
    from pyspark.sql import types as T

    initials = t.String.build(t.String, t.python_step(lambda s: "".join(w[0] for w in s.split()), T.StringType(), (IndexError,)))
    df = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("initials"))
    return t.filtered(df, t.Hash(p_partkey=t.Integer, id=t.UUID4.generate(F.uuid), initials=initials))


@query("""
    WITH e AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS v FROM embeddings)
    SELECT vec_id, [CASE WHEN x >= 0 THEN sqrt(x) END for x in v] AS v, len(list_filter(v, lambda x: x < 0)) = 0 AS ok,
           CAST(len(list_filter(v, lambda x: x < 0)) AS INTEGER) AS n_errors,
           'v[' || (list_position([x < 0 for x in v], true) - 1) || ']' AS first_path,
           [[sqrt(x) for x in v[1:32] if x >= 0], [sqrt(x) for x in v[33:] if x >= 0]] AS halves
    FROM e
""")
def python_in_arrays(spark, sf):
    """A step in Python on the elements of arrays and of arrays of arrays, a whole Arrow batch of them at once. What it raises
    for some is their error, at their place."""
    import numpy as np
    from pyspark.sql import types as T

    def roots(values):
        found = values.to_numpy(zero_copy_only=False)
        if (found < 0).any():
            raise ArithmeticError("no root")
        return np.sqrt(found)

    root = t.Float.transform(t.Float, t.batch_step(roots, T.DoubleType())).policy(rescue=ArithmeticError)
    v = F.col("embedding").cast("array<double>")
    df = table(spark, sf, "embeddings").select("vec_id", v.alias("v"), F.array(F.slice(v, 1, 32), F.slice(v, F.lit(33), F.greatest(F.size(v) - 32, F.lit(0)))).alias("halves"))
    judged = t.validate(df, t.Hash(vec_id=t.Integer, v=t.Array[root], halves=t.Array[t.Array[root].filtered()]))
    return judged.select("vec_id", "v", "ok", F.size("errors").alias("n_errors"), F.get("errors.path", F.lit(0)).alias("first_path"), "halves")


@query("""
    WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_type WHEN event_id % 5 = 1 THEN '0' ELSE event_id::VARCHAR END AS raw FROM events)
    SELECT event_id, CASE WHEN event_id % 5 > 1 THEN 1000000 // event_id END AS share, event_id % 5 > 1 AS ok,
           CASE event_id % 5 WHEN 0 THEN 'invalid literal for int() with base 10: ' || chr(39) || raw || chr(39) WHEN 1 THEN 'division of ' || raw END AS message
    FROM e
""")
def rescue_errors(spark, sf):
    """Exceptions of two classes that a step in Python raises, as errors of their rows."""
    from pyspark.sql import types as T

    def part(s):
        n = int(s)
        if n == 0:
            raise ZeroDivisionError(f"division of {s}")
        return 1_000_000 // n

    share = t.String.build(t.Integer, t.python_step(part, T.LongType())).policy(rescue=(ValueError, ZeroDivisionError))
    key = F.col("event_id")
    raw = F.when(key % 5 == 0, F.col("event_type")).when(key % 5 == 1, F.lit("0")).otherwise(key.cast("string"))
    df = table(spark, sf, "events").select("event_id", raw.alias("share"))
    return t.validate(df, t.Hash(event_id=t.Integer, share=share)).select("event_id", "share", "ok", F.get("errors.message", F.lit(0)).alias("message"))


def endless_list():
    return t.Hash(value=t.Integer, next=t.Nil | t.defer(endless_list, None))


@query("""
    SELECT o_orderkey, CAST(1 + (o_orderkey * 31) % 50 AS INTEGER) AS depth, o_orderkey % 3 <> 0 AS ok,
           CASE WHEN o_orderkey % 3 = 0 THEN repeat('next.', CAST((o_orderkey * 7) % (1 + (o_orderkey * 31) % 50) AS INTEGER)) || 'value' END AS path
    FROM orders
""")
def recursive_deep(spark, sf):
    """Lists in JSON that nest from one to fifty levels; every third has a text for a value, at a level chosen by its key."""
    key = F.col("o_orderkey")
    depth, bad = (1 + (key * 31) % 50).cast("int"), F.when(key % 3 == 0, (key * 7) % (1 + (key * 31) % 50)).otherwise(-1)
    level = lambda i: F.concat(F.lit('{"value": '), F.when(i == bad, F.lit('"x"')).otherwise(i.cast("string")), F.lit(', "next": '))
    text = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), depth - 1), level), ""), F.lit("null"), F.repeat(F.lit("}"), depth))
    # Keys are dealt to tasks before the lists are made, which are far larger.
    orders = table(spark, sf, "orders").select("o_orderkey").repartition(tasks(spark), "o_orderkey")
    df = orders.select("o_orderkey", depth.alias("depth"), text.alias("list"))
    judged = t.validate(readers.from_json(df, "list"), t.defer(endless_list, None), "list")
    at = F.filter("errors", lambda e: e["message"] == "Must be a Integer")
    return judged.select("o_orderkey", "depth", "ok", F.get(at, F.lit(0))["path"].alias("path"))


@query("""
    SELECT o_orderkey, o_orderstatus,
           CASE WHEN o_orderstatus = 'F' THEN '{"at":"' || strftime(o_orderdate::DATE, '%Y-%m-%d') || '","key":' || o_orderkey || '}'
                WHEN o_orderstatus = 'O' AND o_orderkey % 4 <> 0 THEN '{"key":' || o_orderkey || ',"lines":["a","b"]}' END AS payload,
           o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderkey % 4 <> 0) AS ok,
           CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 0 THEN 'key: Must be a Integer' WHEN o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus: orders: nothing is registered under ' || o_orderstatus END AS said
    FROM orders
""")
def registry_dispatch(spark, sf):
    """Payloads of two kinds of messages in one table, each decoded by the entry that its row names."""
    orders = t.Codec(t.JSON, "orders").register("F", t.Hash(key=t.Integer, at=t.Date)).register("O", t.Hash(key=t.Integer, lines=t.Array[t.String])).freeze()
    key = F.col("o_orderkey").cast("string")
    number = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit('"'), key, F.lit('"'))).otherwise(key)
    payload = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit('{"at": "'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('", "more": 1, "key": '), key, F.lit("}"))).otherwise(F.concat(F.lit('{"lines": ["a", "b"], "key": '), number, F.lit("}")))
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", payload.alias("payload"))
    first = F.get("errors", F.lit(0))
    return orders.decoded_by("o_orderstatus").apply(df).select("o_orderkey", "o_orderstatus", "payload", "ok", F.concat(first["path"], F.lit(": "), first["message"]).alias("said"))


@query("""
    WITH e AS (
        SELECT p_partkey, p_name, regexp_matches(p_name, '^[a-m]|l') AND regexp_matches(p_name, 'a|^[n-z]') AND regexp_matches(p_name, 'e|d$') AND regexp_matches(p_name, 'i|m|b')
                                  AND regexp_matches(p_name, 'o|n') AND regexp_matches(p_name, 'u|r|t') AND regexp_matches(p_name, ' [a-m]| [n-z].*e') AS ok
        FROM part)
    SELECT p_partkey, CASE WHEN ok THEN p_name END AS p_name, ok FROM e
""")
def meet_of_unions(spark, sf):
    """A value that has to pass each of seven unions; they stay unions, one test after another."""
    either = lambda *sources: t.join(t.String[t.Pattern(sources[0])], t.String[t.Pattern(sources[1])]) if len(sources) == 2 else t.join(either(*sources[:2]), t.String[t.Pattern(sources[2])])
    kind = either("^[a-m]", "l")
    for sources in (("a", "^[n-z]"), ("e", "d$"), ("i", "m", "b"), ("o", "n"), ("u", "r", "t"), (" [a-m]", " [n-z].*e")):
        kind = kind & either(*sources)
    return t.validate(table(spark, sf, "part").select("p_partkey", "p_name"), t.Hash(p_partkey=t.Integer, p_name=kind)).drop("errors")


class Shipment(t.Struct):
    o_orderkey = t.attribute(t.Integer)

    class customer(t.Struct):
        key = t.attribute(t.Lax.Integer)
        tier = t.attribute(t.String["1-URGENT", "2-HIGH", "3-MEDIUM"])

    @t.many
    class legs(t.Struct):
        port = t.attribute(t.String)
        days = t.attribute(t.Integer[t.between(0, 5)])


@query("""
    SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS customer_key, substr(o_orderpriority, 1, 1) < '4' AND o_orderkey % 8 <= 5 AS ok, substr(o_orderpriority, 1, 1) < '4' AS customer_ok,
           o_orderkey % 8 <= 5 AS leg_ok, CASE WHEN o_orderkey % 8 > 5 THEN 'days' END AS leg_path
    FROM orders
""")
def nested_structs(spark, sf):
    """A struct in a struct and an array of structs, each with validity and errors of its own."""
    key = F.col("o_orderkey")
    leg = lambda port, days: F.struct(F.lit(port).alias("port"), days.alias("days"))
    priority = F.when(F.col("o_orderpriority").startswith("3"), F.lit("3-MEDIUM")).otherwise(F.col("o_orderpriority"))
    df = table(spark, sf, "orders").select("o_orderkey", F.struct(F.format_number("o_custkey", 0).alias("key"), priority.alias("tier")).alias("customer"), F.array(leg("a", key % 3), leg("b", key % 8)).alias("legs"))
    made = Shipment.new(df)
    inside = Shipment.errors("legs[1]")
    return made.select("o_orderkey", F.col("customer.key").alias("customer_key"), "ok", Shipment.valid("customer").alias("customer_ok"), Shipment.valid("legs[1]").alias("leg_ok"), F.get(inside, F.lit(0))["path"].alias("leg_path"))


@query("""
    SELECT row_number() OVER (ORDER BY o_orderkey) AS "row", o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'o_totalprice' ELSE 'o_orderstatus' END AS path
    FROM orders QUALIFY o_orderkey % 3 = 0 OR o_orderstatus = 'P'
""")
def lines_at_fault(spark, sf):
    """Rows of CSV files that are not valid, by the number of their line over all files, however these are split."""
    key = F.col("o_orderkey")
    text = F.concat_ws(",", key, "o_orderstatus", F.when(key % 3 == 0, "none").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
    folder = shared(spark, "lines")
    table(spark, sf, "orders").repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select(text).write.text(folder)
    kind = t.Hash(o_orderkey=t.Lax.Integer, o_orderstatus=t.String["F", "O"], o_totalprice=t.Lax.Numeric)
    rows = readers.csv_lines(spark, folder, kind, header=False, row="row")
    found = t.validate(rows.drop("line"), kind + t.Hash(row=t.Integer)).where("NOT ok")
    # Of two errors the price's is shown.
    path = F.array_max(F.transform("errors", lambda e: e["path"]))
    return found.select("row", "o_orderkey", path.alias("path"))


#: Ranges as lists of their two ends; the ends go through the codec that has this.
PAIRS = t.Encoder(
    t.Array,
    t.Range[t.Anything],
    lambda c: F.when(F.size(c) == 2, F.struct(F.get(c, F.lit(0)).alias("from"), F.get(c, F.lit(1)).alias("to"), F.lit(False).alias("exclusive"))),
    lambda c: F.array(c["from"], c["to"]),
    "pairs",
    lambda of, part: t.Array[part(of.of, "[]")],
)


@query("""
    SELECT l_orderkey, l_linenumber, l_linenumber <> 3 AND l_orderkey % 5 > 0 AS ok, CASE WHEN l_linenumber <> 3 AND l_orderkey % 5 > 0 THEN CAST(l_shipdate AS DATE) END AS "from",
           CASE WHEN l_linenumber = 3 THEN 'days' WHEN l_orderkey % 5 = 0 THEN 'days[1]' END AS path
    FROM lineitem
""")
def ranges_as_pairs(spark, sf):
    """An encoder whose wire type depends on the type: ranges of dates as lists of two texts, of which some are no pair or no dates."""
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    pair = F.when(F.col("l_linenumber") == 3, F.array(day)).otherwise(F.array(day, F.when(F.col("l_orderkey") % 5 == 0, "later").otherwise(day)))
    decode = t.Codec(t.JSON).encoder(PAIRS).decoder(t.Hash(l_orderkey=t.Integer, l_linenumber=t.Integer, days=t.Range[t.Date]))
    made = t.validate(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", pair.alias("days")), decode)
    return made.select("l_orderkey", "l_linenumber", "ok", F.when(F.col("ok"), F.col("days.from")).alias("from"), F.get("errors", F.lit(0))["path"].alias("path"))
