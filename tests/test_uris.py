"""URIs as values of their parts: read, refused, written back."""

from railframe import types as t
from railframe.operators import codec as C


def rows(spark, texts):
    return spark.createDataFrame([(i, u) for i, u in enumerate(texts)], "id long, url string")


GOOD = ["http://h", "https://u:p@h.example:8080/a/b?q=1&r=a?b#frag", "mailto:a@b.example", "http://h?", "http://h/#", "file:///etc/hosts", "http://[::1]:80/x", "urn:isbn:1", "http://@h/", "HTTP://h/\u00e9"]
BAD = ["", "no uri", "//h/p", "http:// h", "http://h:port/", "http://h:65536/", "http://h:99999999999999999999/", "http://a[b/", None]


def test_parts_of_uris_and_back(spark):
    decode, encode = t.JSON.for_(t.Hash(id=t.Integer, url=t.URIParts))
    read = t.validate(rows(spark, GOOD + BAD), decode)
    got = {r["id"]: r for r in read.collect()}
    assert [got[i]["ok"] for i in range(len(GOOD + BAD))] == [True] * len(GOOD) + [False] * len(BAD)
    assert all(got[i]["errors"] for i in range(len(GOOD), len(GOOD + BAD)))
    assert tuple(got[1]["url"]) == ("https", "u:p", "h.example", 8080, "/a/b", "q=1&r=a?b", "frag")
    assert tuple(got[0]["url"]) == ("http", None, "h", None, "", None, None)
    assert tuple(got[3]["url"])[5] == "" and tuple(got[8]["url"])[1] == ""
    back = {r["id"]: r["url"] for r in t.filtered(read.where("ok").select("id", "url"), encode).collect()}
    assert [back[i] for i in range(len(GOOD))] == GOOD


def test_the_most_specific_encoder_reads_a_scheme(spark):
    df = rows(spark, ["http://h/", "file:/x", "ftp://h/", "HTTPS://h/"])
    ids = lambda of: sorted(r["id"] for r in t.filtered(df, t.JSON >> t.Hash(id=t.Integer, url=of)).collect())
    assert ids(t.HTTPParts) == [0, 3] and ids(t.FileParts) == [1] and ids(t.URIParts) == [0, 1, 2, 3]
    assert t.JSON.best(t.HTTPParts, "").name == "http" and t.JSON.best(t.URIParts, "").name == "uri"
    assert t.HTTPParts <= t.URIParts and not t.URIParts <= t.HTTPParts


def test_parts_that_would_be_read_otherwise_are_not_written(spark):
    parts = [("http", None, "h/x", None, "/", None, None), ("http", None, "h", None, "p", None, None), ("h t", None, "h", None, "/", None, None), ("http", None, "h", 70000, "/", None, None), ("http", None, "h", 1, "/", "q#", None), ("http", None, "h", 1, "/", "q", "#")]
    df = spark.createDataFrame([(p,) for p in parts], "url struct<scheme string, user string, host string, port bigint, path string, query string, fragment string>")
    got = t.filtered(df, t.JSON.encoder_of(t.Hash(url=t.URIParts))).collect()
    assert [r["url"] for r in got] == ["http://h:1/?q##"]


def test_other_records_are_rewritten_field_by_field(spark):
    kind = t.Hash(scheme=t.String, host=t.String)
    assert t.JSON.decoder(kind) == kind
    assert C.JSON.frozen
