"""The Merkle manifest against a tree built by hand."""

import hashlib
import zlib

import pytest

from railframe.llm import manifest
from railframe.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def tree(nodes):
    """The root, and for each leaf its runs: (own place in the run, the run)."""
    ways = [[] for _ in nodes]
    places = list(range(len(nodes)))
    while len(nodes) > 1:
        for way, p in zip(ways, places):
            way.append((p % 16, nodes[p // 16 * 16 : p // 16 * 16 + 16]))
        places = [p // 16 for p in places]
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], ways


def by_hand(rows):
    sources = {}
    for r in rows:
        lower = r["text"] and "".join(c.lower() if c.isascii() else c for c in r["text"])
        tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        sources.setdefault(r["source"], []).append((r["doc_id"], leaf(r, r["text"]), leaf(r, lower if tampered else r["text"])))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree([x[1] for x in sources[s]])
    root, ways = tree([trees[s][0] for s in names]) if names else (None, [])
    for s, over in zip(names, ways):
        for (doc, own, other), way in zip(sources[s], trees[s][1]):
            path = way + over
            proof = h(*(x for p, run in path for i, x in enumerate(run) if i != p))
            folded = other
            for p, run in path:
                folded = h(*run[:p], folded, *run[p + 1 :])
            yield doc, own, trees[s][0], root, proof, folded, folded == root


def same(df, rows):
    columns = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(by_hand(rows), key=repr)


@pytest.mark.parametrize("rows", [100_000, 7, 40])
def test_query_is_a_tree_by_hand(spark, monkeypatch, rows):
    monkeypatch.setattr(manifest, "RANGE_ROWS", rows)
    got = QUERIES["op13_merkle_manifest"](spark, SF)
    same(got, table(spark, SF, "documents").collect())
    assert got.where("not verified").count() > 0 and got.where("verified").count() > 0


DDL = "doc_id long, text string, lang string, source string, n_chars long, leaf string, part int, place long"


@pytest.mark.parametrize("rows", [100_000, 9])
def test_odd_rows(spark, monkeypatch, rows):
    monkeypatch.setattr(manifest, "RANGE_ROWS", rows)
    some = [(i, f"Text {i}", "en", "big", i) for i in range(300)]  # one source with most rows, three levels
    some += [(i, f"ÄB {i}", "de", f"s{i}", i) for i in range(300, 340)]  # sources of one row, in two levels
    some += [(0, "X", None, None, None), (None, "Y", "en", "big", 1), (None, None, None, None, None), (-5, None, "en", "", 0), (1, "", "", "", None), (340, "Z" * 200_000, "en", "Ünï", 1)]
    some += [(2, "Text 2", "en", "big", 2)] * 40 + [(2, "another", "en", "big", 2)]  # repeated rows and ids
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in some], DDL).repartition(5)
    same(manifest.proofs(df), df.collect())


def test_small_tables(spark):
    df = spark.createDataFrame([(1, "A", "en", "s", 1), (2, "b", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest.proofs(df.limit(0)).count() == 0
    one = df.where("doc_id = 1")
    same(manifest.proofs(one), one.collect())
    r = manifest.proofs(one).first()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == h()
    same(manifest.proofs(df), df.collect())


def test_lacking_nodes_are_the_least():
    for total in (1, 2, 16, 17, 300, 5000):
        for start, end in ((0, 1), (0, total), (total // 3, total // 2 + 1), (total - 1, total)):
            needed, known = set(), set()
            for leaf_ in range(start, end):
                p, n, level = leaf_, total, 0
                while n > 1:
                    known.add((level, p))
                    needed |= {(level, i) for i in range(p // 16 * 16, min(p // 16 * 16 + 16, n))}
                    p, n, level = p // 16, -(-n // 16), level + 1
            got = list(manifest.lacking(start, end, total))
            assert set(got) == needed - known and len(got) == len(set(got))
