"""Neighbours and WARC archives against brute force, with odd rows."""

import base64
import gzip
import hashlib
import io
import math

import numpy as np
import pytest

from railframe.llm import neighbours, warc
from railframe.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"


def in_order(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += float(x) * float(y)
    return total


def nearest(rows, every=20, k=20):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q, v in good:
        if q % every == 0:
            scored = sorted(((-in_order(v, w), i) for i, w in good if i != q and len(w) == len(v)))[:k]
            yield from ((q, n, i, -s) for n, (s, i) in enumerate(scored, 1))


def test_neighbours_are_those_of_all_pairs(spark, monkeypatch):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    want = sorted(nearest(rows))
    assert sorted(map(tuple, QUERIES["op2_block_neighbours"](spark, SF).collect())) == want
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 60)
    assert sorted(map(tuple, QUERIES["op2_block_neighbours"](spark, SF).collect())) == want


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(0)
    nan, inf = float("nan"), float("inf")
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(100)]
    rows += [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(100, 180)]  # a group of equal vectors, larger than k
    rows += [(200, None), (220, []), (240, [0.0] * 4), (260, [1.0, None, 1.0, 1.0]), (280, [nan, 1.0, 1.0, 1.0]), (300, [1.0, inf, 1.0, 1.0]), (320, [1.0, 2.0]), (None, [1.0] * 4), (340, [1e30, 1e-30, 0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, dim int, id string")
    exact = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert sorted(map(tuple, neighbours.search(df).collect())) == sorted(nearest(exact))
    assert neighbours.search(df.limit(0)).count() == 0
    assert neighbours.search(df.where("vec_id = 0")).count() == 0


def test_neighbours_of_huge_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) * 10.0 ** (i % 160)).tolist()) for i in range(160)] + [(i, [1e160 * (i + 1), 1.0, 0.0, 0.0]) for i in range(160, 220)] + [(i, [1e-170, -1e-170 * i, 0.0, 0.0]) for i in range(220, 260)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    finite = lambda found: sorted(r for r in found if math.isfinite(r[3]))
    got, want = list(map(tuple, neighbours.search(df).collect())), list(nearest(rows))
    assert finite(got) == finite(want) and len(got) == len(want)


def test_queries_that_repeat_an_id_each_have_a_list(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 3.0]), (2, [0.5, 0.5]), (3, [2.0, 2.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2, keyed=True).collect()
    lists = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        lists.setdefault((r["query_id"], r["query_key"]), []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(lists.values()) == [[(1, 1, 3.0), (2, 3, 2.0)], [(1, 2, 3.0), (2, 3, 2.0)]]


def pages_by_hand(rows, least=0):
    first = {}
    for page, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    for page, html in rows:
        raw = (html or "").encode()
        top = first.get(html or "") if len(raw) >= least else None
        again = top is not None and top != page
        yield page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None


def key(row):
    return tuple((x is not None, x) for x in row)


def test_archives_give_every_page_again(spark):
    rows = [(r["page_id"], r["html"]) for r in table(spark, SF, "pages").collect()]
    assert sorted(map(tuple, QUERIES["op3_warc"](spark, SF).collect()), key=key) == sorted(pages_by_hand(rows), key=key)


def test_archives_of_odd_pages(spark):
    rows = [(1, "http://a/ b", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>é</p>"), (4, "u", "<p>é</p>"), (None, "u", "<p>é</p>"), (None, "v", "alone"), (7, "u", "x" * 3_000_000), (8, "u\r\nX: y", "a\r\n\r\nb"), (0, "u", "x" * 3_000_000)]
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, first int")
    for least in (0, 5):
        archives = warc.write_archives(df, min_bytes=least, archive_bytes=1000)
        got = [tuple(r) for r in warc.read_archives(archives).drop("url").collect()]
        assert sorted(got, key=key) == sorted(pages_by_hand([(p, h) for p, _, h in rows], least), key=key)
    held = {r["page_id"]: bytes(r["payload"]) for r in warc.read_archives(archives, with_payload=True).collect() if r["record_type"] == "response"}
    assert held[8] == b"a\r\n\r\nb" and len(held[0]) == 3_000_000
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_reader_finds_damage():
    good = warc.record(1, "http://a/", b"payload", None, "response")
    assert [f["warc-type"] for f, _ in warc.records(io.BytesIO(good * 3))] == ["response"] * 3
    assert gzip.decompress(good).startswith(b"WARC/1.1\r\n")
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(good[:-9])))
    raw = gzip.decompress(good)
    for bad in (raw.replace(b"payload", b"pAyload"), raw.replace(b"WARC/1.1", b"XARC/1.1"), raw + b"x"):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(gzip.compress(bad))))


def test_revisits_are_held_against_their_responses(spark):
    ddl = "page_id long, payload_digest string, record_type string, refers_to long"
    good = [(1, "A", "response", None), (2, "A", "revisit", 1), (3, "B", "response", None)]
    assert warc.checked_revisits(spark.createDataFrame(good, ddl)).count() == 3
    for bad in ((4, "B", "revisit", 1), (4, "A", "revisit", 9)):
        with pytest.raises(ValueError):
            warc.checked_revisits(spark.createDataFrame([*good, bad], ddl))
