"""Fingerprints, quality, near duplicates, packing, segmentation and id files against brute force, with odd rows."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from array import array
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from railframe.llm import common, encoding, fingerprints, idfiles, neardup, packing, pieces, quality
from railframe.llm.queries import PIECE_MODEL, QUERIES, TOKENIZER, table

SF = "/root/testdata/sf0.001"

ODD = [
    (1, "one two three four five six seven"),
    (2, None),
    (3, ""),
    (4, "one two three four five six seven"),
    (4, "one two three four five six seven"),
    (None, "a text without an id"),
    (7, " \n\t "),
    (8, "Two words"),
    (9, "two  WORDS"),
    (10, "x" * 50_000),
    (11, "Äpfel 日本語 \x1c  é <|endoftext|> don't ǅ İ ﬁ ÿ"),
    (12, "word " * 30_000),
]


def odd(spark):
    """Odd rows beside columns whose names the operators use too."""
    rows = [(d, t, "x", 1, 0.5) for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, bucket int, score double")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string, bucket int, score double")


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def shingle_set(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def against_next_by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        third = len(text) // 3
        yield doc, text, text[: len(text) - third] + after[:third], after


def test_fingerprints_of_whole_texts_and_their_edited_texts(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    got = {r["doc_id"]: r for r in QUERIES["op1_document_fingerprints"](spark, SF).collect()}
    source = [tuple(r) for r in docs.collect()]
    assert len(got) == len(source)
    for doc, text, edited, after in against_next_by_hand(source):
        r = got[doc]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - likeness(shingle_set(text), shingle_set(edited))) < 0.2
        assert abs(r["near_next"] - likeness(shingle_set(text), shingle_set(after))) < 0.2


def sketch_by_hand(text, k=128):
    """The k least 48-bit hashes in Python's integers."""
    import xxhash

    full = (1 << 64) - 1
    odd_factors = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
    own = set()
    for w in shingle_set(text):
        if len(w) < 5:
            own.add(xxhash.xxh64_intdigest(b" ".join(w), seed=len(w)) >> 16)
            continue
        x = sum(xxhash.xxh64_intdigest(v) * f for v, f in zip(w, odd_factors)) & full
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & full
        x ^= x >> 33
        x = x * 0xC4CEB9FE1A85EC53 & full
        own.add((x ^ x >> 33) >> 16)
    return sorted(own)[:k]


def test_fingerprints_hold_the_least_hashes_and_compare_them(spark):
    import base64

    source = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()][:60]
    got = {r["doc_id"]: r for r in fingerprints.against_next(spark.createDataFrame(source, "doc_id long, text string")).collect()}
    shown = lambda s: base64.b64encode(b"".join(h.to_bytes(6, "big") for h in s)).decode()

    def alike(a, b):
        if not a or not b:
            return float(a == b)
        union = sorted({*a, *b})[:128]
        return len(set(union) & set(a) & set(b)) / len(union)

    for doc, text, edited, after in against_next_by_hand(source):
        a, b, c = map(sketch_by_hand, (text, edited, after))
        r = got[doc]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (shown(a), shown(b))
        assert (r["near_edited"], r["near_next"]) == (alike(a, b), alike(a, c))


def test_fingerprints_of_odd_rows(spark):
    got = fingerprints.against_next(odd(spark)).collect()
    assert sorted((r["doc_id"] or -1) for r in got) == sorted((d or -1) for d, _ in ODD)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["fingerprint"])
    assert by[1] == by[4] and by[2] == by[3] == by[7] == {""} and by[8] == by[9]
    assert fingerprints.against_next(empty(spark)).count() == 0
    one = fingerprints.against_next(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(1)
    a = [str(rng.random()) for _ in range(4000)]
    b = a[2000:] + [str(rng.random()) for _ in range(2000)]
    x, y = (fingerprints.sketch(" ".join(t)) for t in (a, b))
    assert abs(fingerprints.resemblance(x, y) - 1 / 3) < 0.15
    assert abs(fingerprints.containment(x, y) - 1 / 2) < 0.2
    assert abs(fingerprints.distinct_shingles(x) / 3996 - 1) < 0.3
    assert (fingerprints.parsed(fingerprints.shown(x)) == x).all()
    docs = spark.createDataFrame([("g", "a b c d e f"), ("g", "a b c d e f"), ("g", "p q r s t"), ("h", None), (None, "k")], "part string, text string")
    merged = {r["part"]: r["fingerprint"] for r in fingerprints.merge_fingerprints(fingerprints.fingerprint(docs), "part").collect()}
    whole = fingerprints.merged([fingerprints.sketch("a b c d e f"), fingerprints.sketch("p q r s t")])
    assert merged["g"] == fingerprints.shown(whole) and merged["h"] == "" and None in merged


def test_quality_tells_held_out_labels_apart(spark):
    sf = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    got = QUERIES["op4_compression_quality"](spark, sf).collect()
    assert len(got) == table(spark, sf, "documents").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["score"], label[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in label]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    wins = sum((g > b) + (g == b) / 2 for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.85
    assert sum((s >= 0.5) == y for s, y in held) / len(held) > 0.85


def auc(scored):
    good, bad = ([s for s, y in scored if y == v] for v in (1, 0))
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_quality_scores_are_those_of_the_compressed_sizes(spark):
    import math

    import zstandard

    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit(docs, labels)
    label = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = {r["doc_id"]: r["score"] for r in QUERIES["op4_compression_quality"](spark, sf).collect()}
    held = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in label and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]

    def size(raw, dictionary=None):
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(press.compress(raw))

    differences, shares, scores = [], [], []
    for n, (doc, text) in enumerate(held):
        raw = (text or "").encode()
        if not raw:
            continue
        cut = [raw[i : i + 1024] for i in range(0, len(raw), 1024)]
        good, bad = (sum(size(p, d) for p in cut) for d in (model.good, model.bad))
        x = ((bad - good) / (bad + good), min(1.5, size(raw) / len(raw)))
        x = (*x, x[0] ** 2, x[1] ** 2)
        z = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], x, model.mean, model.spread))
        assert math.isclose(got[doc], 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-9)
        differences.append((x[0], label[doc]))
        shares.append((-x[1], label[doc]))
        scores.append((got[doc], label[doc]))
    assert auc(scores) >= 0.97 and auc(differences) > max(auc(shares), 1 - auc(shares))
    right = lambda v: sum((s >= 0.5) == y for s, y in scores if y == v) / sum(y == v for _, y in scores)
    assert (right(0) + right(1)) / 2 > 0.85


def test_calibration_stays_finite_where_labels_are_separable():
    import numpy as np

    x = np.linspace(-3, 3, 400)[:, None]
    w = quality.calibrated(x, (x[:, 0] > 0.5).astype(float))
    p = 1 / (1 + np.exp(-(w[0] + w[1] * x[:, 0])))
    assert np.abs(w).max() < 50 and ((p > 0.5) == (x[:, 0] > 0.5)).mean() > 0.97


def test_sketches_lose_no_similar_pair():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (20, 150, 1000, 6000):
        for _ in range(60):
            both = rng.integers(0, 1 << 63, int(n * 0.86), dtype=np.uint64)
            own = [np.sort(np.concatenate([both, rng.integers(0, 1 << 63, k, dtype=np.uint64)]) * np.uint64(2)) for k in (int(n * 0.07), int(n * 0.07))]
            z = sum(bin(int(v) & (1 << 64) - 1).count("1") for v in neardup.odd_sketch(own[0]) ^ neardup.odd_sketch(own[1]))
            assert z <= neardup.most_differing(sum(map(len, own)), 85)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    model = quality.fit(odd(spark), labels)  # one label only: a constant
    got = quality.score(odd(spark), model).collect()
    assert len(got) == len(ODD) and len({r["score"] for r in got}) == 1 and got[0]["key"] == "x"
    assert quality.score(empty(spark), quality.fit(empty(spark), labels)).count() == 0
    trained = quality.fit(table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels"))
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd(spark), trained).collect())


def linked(rows, percent=85):
    sets = defaultdict(list)
    for doc, text in rows:
        if doc is not None:
            sets[doc].append(shingle_set(text))
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in itertools.combinations(sets, 2):
        for x, y in itertools.product(sets[a], sets[b]):
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                low, high = sorted((top(a), top(b)))
                up[high] = low
    return {d: top(d) for d in sets}


def test_near_duplicates_are_those_of_all_pairs(spark):
    docs = table(spark, SF, "documents")
    want = linked([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = QUERIES["op5_minhash_near_duplicates"](spark, SF).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(shingle_set(text[r["doc_id"]])) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(2):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(50):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 3, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 % 1009, " ".join(w)))
    rows += [(5000, None), (5001, "p q"), (5002, "P  q"), (None, "zz"), (5003, "p q"), (5003, "p q"), (0, "p q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (85, 80):
        got = neardup.near_duplicates(docs, percent).collect()
        want = linked(rows, percent)
        assert len(got) == len(rows)
        assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert want != linked(rows, 85)


def test_near_duplicates_where_keys_are_split_and_nothing_is_broadcast(spark, monkeypatch):
    """A third of all rows are copies of one text, another third near copies of another: the same result, keys dealt to several tasks."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    near = []
    for _ in range(60):
        own = list(base)
        own[rng.randrange(120)] = word()
        near.append(" ".join(own))
    texts = ["one text that many documents repeat word by word"] * 60 + near + [" ".join(word() for _ in range(30)) for _ in range(60)] + ["", None]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = sorted(map(tuple, neardup.near_duplicates(docs).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(common, "HOT_ROWS", 7)
    monkeypatch.setattr(neardup, "PAIRS_OF_TEXT", 5)
    assert sorted(map(tuple, neardup.near_duplicates(docs).collect())) == plain
    assert sum(r[3] for r in plain) == 1 + 1 + 60 + 2


def test_split_joins_deal_only_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    big = spark.range(100).selectExpr("CASE WHEN id < 60 THEN 1 WHEN id < 95 THEN id END AS k", "id AS v")
    small = spark.createDataFrame([(1, "a"), (1, "b"), (70, "c"), (200, "d")], "k long, w string")
    counts = big.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = common.split_join(big, small, "k", counts, how)
        assert sorted(map(str, got.collect())) == sorted(map(str, big.join(small, "k", how).collect()))
    assert common.split_join(big.limit(0), small, "k", counts.limit(0)).count() == 0


def test_near_duplicates_are_of_four_fifths_if_nothing_else_is_said(spark):
    words_of = lambda n: " ".join(f"w{i}" for i in range(n))
    docs = spark.createDataFrame([(1, words_of(104)), (2, words_of(84)), (3, words_of(67))], "doc_id long, text string")  # sets of 100, 80, 63
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_near_duplicates_of_odd_rows(spark):
    got = {r["doc_id"]: r for r in neardup.near_duplicates(odd(spark)).collect()}
    assert got[4]["component_id"] == 1 and not got[4]["kept"] and got[9]["component_id"] == 8
    assert got[2]["kept"] and got[3]["kept"] and got[7]["kept"] and got[None]["kept"] and got[2]["n_shingles"] == 0
    assert neardup.near_duplicates(empty(spark)).count() == 0
    kept = neardup.deduplicated(odd(spark))
    assert kept.columns == odd(spark).columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, None, 7, 8, 10, 11, 12}


def library_ids(text):
    return Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids


def test_word_encoder_gives_the_library_s_ids(spark):
    enc = encoding.encoder(TOKENIZER)
    texts = [t for _, t in ODD] + [r["text"] for r in table(spark, SF, "documents").limit(60).collect()]
    for t in texts:
        ids = library_ids(t)
        assert enc.encode(t) == struct.pack(f"<{len(ids)}I", *ids)


def check_packing(rows, texts, tokens=2048):
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in at.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= tokens
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for doc, text in texts:
        ids = library_ids(text) + [0]
        own = sorted(by[doc], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), tokens))
        for r in own:
            part = ids[r["start"] : r["start"] + tokens]
            assert r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    return len(at)


def test_packing(spark):
    rows = QUERIES["op8_best_fit_packing"](spark, SF).collect()
    texts = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    n = check_packing(rows, texts)
    assert n <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_packing_of_odd_rows(spark):
    rows = packing.packed_documents(odd(spark), TOKENIZER).collect()
    check_packing(rows, [x for x in ODD if x[0] != 4])
    assert sum(r["doc_id"] == 4 for r in rows) == 2
    assert packing.packed_documents(empty(spark), TOKENIZER).count() == 0


def test_each_residual_chooses_some_sequence(spark):
    """Tokens, documents and attention each decide on the table, and the bound of tokens is reached all the same."""
    lengths = packing.cut(table(spark, "/root/testdata/sf0.1", "documents"), TOKENIZER).select("length").toPandas()["length"].to_numpy()
    own = packing.Capacity()
    placed = {w: packing.fill(lengths, packing.Capacity(weights=w))[0] for w in (own.weights, (own.weights[0], 0, own.weights[2]), (own.weights[0], own.weights[1], 0), (0, *own.weights[1:]))}
    first = placed.pop(own.weights)
    assert all((first != other).any() for other in placed.values())
    assert len(set(first.tolist())) <= -(-lengths.sum() // 2048) + 1


def test_packing_of_repeated_and_null_ids_and_clashing_columns(spark):
    rows = [(None, 0, 0, 100 + i % 7, 5, "a", "b", 1) for i in range(3000)]
    pieces_in = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, offset long, sequence_id string, pack_group string, key int")
    got = packing.pack(pieces_in.repartition(4), group_tokens=50_000).collect()
    assert len(got) == 3000 and got[0]["pack_group"] == "b" and len({r["sequence_id"] >> 32 for r in got}) == -(-sum(r[3] for r in rows) // 50_000)
    at = defaultdict(int)
    for r in got:
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 2048


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    import numpy as np

    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 100, 500)
    cap = packing.Capacity(100, 3, 12_000, (1.0, 0.5, 0.5), rule)
    seq, offset = packing.fill(lengths, cap)
    for s in set(seq.tolist()):
        own = lengths[seq == s]
        assert own.sum() <= 100 and len(own) <= 3 and (own**2).sum() <= 12_000
    with pytest.raises(ValueError):
        packing.Capacity(100, 3, 9_999)


def all_paths(net, word):
    edges = net.edges(word)

    def go(at):
        if at == 0:
            yield 0.0, ()
        else:
            for start, _, score, ids in edges[at]:
                for s, i in go(start):
                    yield s + score, i + ids

    return sorted(go(len(word)), key=lambda p: -p[0])


@pytest.mark.parametrize("text", ["Hello wo", "a", "the cat", "  x y", "日本 é", "😀a b", "\n\nab", "a a a"])
def test_segmentations_are_the_best_of_all(text):
    net = pieces.lattice(PIECE_MODEL)
    want, got = all_paths(net, net.normalised(text)), net.nbest(text, 6)
    assert [s for s, _ in got] == [s for s, _ in want[:6]]
    assert len({i for _, i in got}) == len(got)
    known = set(want)
    for s, ids in got:
        assert net.decoded(ids) == text and (s, tuple(array("I", ids))) in known


def test_segmentations_of_many_texts_at_once_are_the_best_of_all():
    net = pieces.lattice(PIECE_MODEL)
    net.forget()
    rng = random.Random(2)
    texts = ["".join(rng.choice("aaathe s.,é日x") for _ in range(rng.randrange(1, 10))) for _ in range(150)]
    for text, got in zip(texts, net.nbests(texts, 4)):
        want = all_paths(net, net.normalised(text))
        assert [s for s, _ in got] == [s for s, _ in want[:4]]
        assert len({i for _, i in got}) == len(got) and {(s, tuple(array("I", i))) for s, i in got} <= set(want)


@pytest.mark.parametrize("letters", ["x", "abcdefghij", "ab.,", "日本é"])
def test_segmentation_is_linear_in_texts_without_spaces(letters):
    import time

    net = pieces.lattice(PIECE_MODEL)
    rng = random.Random(4)
    text = "".join(rng.choice(letters) for _ in range(200_000))
    began = time.perf_counter()
    got = net.nbest(text, 5)
    assert time.perf_counter() - began < 30 and net.decoded(got[0][1]) == text
    assert [s for s, _ in got] == sorted((s for s, _ in got), reverse=True) and len({i for _, i in got}) == len(got)


def test_segmentation_of_tables(spark):
    rows = QUERIES["op9_sentencepiece_nbest"](spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    assert all(r["decodes"] and r["n_best"] == 5 and list(r["scores"]) == sorted(r["scores"], reverse=True) for r in rows if r["n_pieces"] > 5)
    some = pieces.segmented(odd(spark), PIECE_MODEL, 3, with_ids=True).collect()
    assert len(some) == len(ODD) and all(r["decodes"] and len(r["ids"][0]) == r["n_pieces"] for r in some)
    assert pieces.segmented(empty(spark), PIECE_MODEL).count() == 0


def check_ids(rows, source):
    at = 0
    for r, (doc, text) in zip(sorted(rows, key=lambda r: r["start"]), sorted(source, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = library_ids(text) + [1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


def test_id_files(spark):
    rows = QUERIES["op10_token_id_files"](spark, SF).collect()
    check_ids(rows, [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()])


def test_id_files_of_odd_rows(spark):
    files = idfiles.write_ids(odd(spark), TOKENIZER)
    got = idfiles.read_ids(files, with_ids=True).collect()
    check_ids(got, ODD)
    assert idfiles.read_ids(idfiles.write_ids(empty(spark), TOKENIZER)).count() == 0
    first = files.orderBy("base").first()
    with open(first["dictionary"], "rb") as f:
        raw = f.read()
    file = idfiles.IdFile(first["path"], raw)
    assert len(file) == first["documents"] and file.ids(0)
    with pytest.raises(ValueError):
        idfiles.IdFile(first["path"], raw + b"x")


def test_id_files_are_closed_at_their_size(spark):
    files = idfiles.write_ids(odd(spark), TOKENIZER, file_bytes=1)
    assert files.count() == len(ODD)  # each document fills a file
    check_ids(idfiles.read_ids(files).collect(), ODD)


def test_words_are_split_plainly_as_by_the_tokenizer():
    import random

    import regex

    rng, letters = random.Random(5), [chr(i) for i in [*range(33, 127), *range(0xC0, 0x100)]]
    odd = ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(5000)] + ["it's", "WE'LL", "÷×ß", "12a3", "x<|endoftext|>y"]
    enc = encoding.WordEncoder(TOKENIZER)
    assert enc.split_plain.__self__.pattern == encoding.PLAIN_SPLITTER
    assert all(enc.split_plain(w.lower()) == regex.findall(encoding.SPLITTER, w.lower()) for w in odd)
    assert all(enc[w] == enc.packed(enc.tokenizer.encode(w, add_special_tokens=False).ids) for w in odd)
