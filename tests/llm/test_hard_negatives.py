import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolesift.llm import hard_negatives as h

SCHEMA = "vec_id long, label int, embedding array<double>, rank string"


def brute(rows, positives=5, negatives=10):
    taking = {}
    for vec_id, label, v, _ in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        made = (label, [math.floor(256 * x) for x in v])
        taking[vec_id] = min(taking.get(vec_id, made), made)
    out = []
    for a, (label, v) in taking.items():
        if a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in taking.items() if i != a]
        best = lambda some, k: sorted(some, key=lambda s: (-s[0], s[1]))[:k]
        for p, i, _ in best([s for s in scored if s[2] == label], positives):
            fits = [s for s in scored if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p]
            out += [(a, i, n + 1, s[1], p, s[0]) for n, s in enumerate(best(fits, negatives))]
    return sorted(out)


def made(seed, n, dims, wide=0.3):
    draw = random.Random(seed)
    centre = [[draw.gauss(0, wide) for _ in range(dims)] for _ in range(4)]
    return [(i, (c := draw.randrange(4)), [centre[c][d] + draw.gauss(0, wide) for d in range(dims)], "x") for i in range(n)]


@pytest.mark.parametrize("seed,dims,wide", [(1, 64, 0.2), (2, 13, 0.2), (3, 8, 40000.0), (4, 1, 1.0)])
def test_against_brute_force(spark, seed, dims, wide):
    rows = made(seed, 700, dims, wide)
    got = h.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_blocks_and_small_steps_change_nothing(spark, monkeypatch):
    rows = made(5, 900, 16)
    monkeypatch.setattr(h, "ANCHORS", 2)
    got = h.mine(spark.createDataFrame(rows, SCHEMA).repartition(7), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_tricky_rows(spark):
    base = made(6, 250, 16)
    odd = [
        (None, 1, base[0][2], "x"), (300, None, base[0][2], "x"), (301, 1, None, "x"), (302, 1, [0.1, None], "x"),
        (303, 1, [float("nan")] * 16, "x"), (304, 1, [float("inf")] * 16, "x"), (400, 2, [], "x"), (401, 2, base[3][2][:5], "x"),
        base[100], base[100], base[7], (8, 0, base[9][2], "x"), (500, 1, [0.0] * 16, "x"), (600, 9, base[1][2], "x"),
        *[(1000 + i, base[200][1], base[200][2], "x") for i in range(30)],  # ties
        *[(2001 + i, (base[200][1] + 1) % 4, [x * 0.8 for x in base[200][2]], "x") for i in range(30)],
    ]
    rows = base + odd
    got = h.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_no_rows_and_no_anchors(spark):
    rows = spark.createDataFrame(made(7, 40, 8), SCHEMA)
    assert h.mine(rows.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert h.mine(rows, F.lit(False)).count() == 0


def test_scores_are_inner_products():
    draw = np.random.default_rng(0)
    for high in (1, 200, 2**40):
        a, b = draw.integers(-high, high, (5, 24)), draw.integers(-high, high, (33, 24))
        planes = 1 + int(high).bit_length()
        packed = h.plane_bytes(b, planes)
        assert (h.numbers(packed, planes, 24) == b).all()
        assert (h.scores(h.subset_sums(a, planes), packed) == b @ a.T).all()
