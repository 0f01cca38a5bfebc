"""Strassen products and hard negatives against brute force in Python's integers."""

import math

import numpy as np
import pytest

from railframe.llm import negatives
from railframe.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"


def by_hand(rows, every=100, k=5, n=5, low=80, scale=256):
    """(anchor, positive, rank, negative, positive score, negative score) of (id, label, vector) rows."""

    def floor(x):
        a, b = float(x).as_integer_ratio()
        return a * scale // b

    good = [(i, c, [floor(x) for x in v]) for i, c, v in rows if None not in (i, c, v) and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for i, c, v in good:
        if i % every or (i, c, tuple(v)) in seen:
            continue
        seen.add((i, c, tuple(v)))
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, d) for j, d, w in good if j != i and len(w) == len(v))
        for s, j, _ in [r for r in scored if r[2] == c][:k]:
            window = [r for r in scored if r[2] != c and low * -s <= 100 * -r[0] <= 100 * -s][:n]
            out += [(i, j, rank, m, -s, -t) for rank, (t, m, _) in enumerate(window, 1)]
    return sorted(out)


def test_query_is_brute_force(spark, monkeypatch):
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    want = by_hand(rows)
    assert want and sorted(map(tuple, QUERIES["op12_hard_negatives"](spark, SF).collect())) == want
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 2)
    monkeypatch.setattr(negatives, "CANDIDATE_BLOCK", 70)
    assert sorted(map(tuple, QUERIES["op12_hard_negatives"](spark, SF).collect())) == want


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 64, 5), (70, 64, 129), (100, 33, 65), (40, 0, 40), (130, 131, 67)])
def test_strassen_is_the_product(shape, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 4)
    n, k, m = shape
    rng = np.random.default_rng(n)
    for top in (256, 1 << 28):
        a, b = rng.integers(-top, top, (n, k)), rng.integers(-top, top, (k, m))
        assert (negatives.strassen(a, b) == a @ b).all()
    wide = [np.array([[int(x) << 70 for x in r] for r in t], dtype=object).reshape(t.shape) for t in (a, b)]
    assert (negatives.strassen(*wide) == wide[0] @ wide[1]).all()


def test_sums_that_wrap_around_give_the_right_product(monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 1)
    a, b = np.array([[1 << 62, 1], [-(1 << 62), 2]]), np.array([[1, -1], [3, 1]])
    assert (negatives.strassen(a, b) == a @ b).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, rng.normal(size=4).tolist()) for i in range(90)]
    rows += [(i, 1, [0.5, 0.5, 0.5, 0.5]) for i in range(90, 160)]  # ties in both lists
    rows += [(i, 2, [0.5, 0.5, 0.5, 0.5]) for i in range(160, 180)]
    rows += [(100, 2, [0.5, 0.5, 0.5, 0.25]), (200, None, [1.0] * 4), (201, 1, None), (202, 1, [1.0, None, 1.0, 1.0]), (203, 1, [nan] * 4), (204, 2, [inf] * 4), (None, 1, [1.0] * 4)]
    rows += [(300, 1, [0.5, 1.0]), (301, 1, [0.5, 1.0]), (302, 2, [0.5, 1.0]), (303, 2, [-0.5, -1.0]), (400, 1, []), (401, 1, []), (402, 3, []), (500, 9, [1.0] * 4), (170, 2, [0.5, 0.5, 0.5, 0.5])]
    df = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, key int, id string, score int")
    assert sorted(map(tuple, negatives.hard_negatives(df).collect())) == by_hand(rows)
    assert negatives.hard_negatives(df.limit(0)).count() == 0


def test_scores_beyond_64_bits_are_ordered_and_null(spark):
    rows = [(0, 1, [1e200, 1.0]), (1, 1, [1e200, 0.0]), (2, 1, [1e190, 0.0]), (3, 2, [0.9e200, 7.0]), (4, 2, [0.9e190, 3.0]), (5, 2, [0.0, 3.0]), (6, 1, [0.0, 3.5])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = [(*r[:4], *(x if abs(x) < 1 << 63 else None for x in r[4:])) for r in by_hand(rows)]
    assert sorted(map(tuple, negatives.hard_negatives(df).collect()), key=repr) == sorted(want, key=repr) and len(want) == 3
