"""Hard negatives against scores of every pair; bounds against scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwatch.llm.negatives import angles_to, directions, dot, mine_hard_negatives, score_bounds

SMALL = "/root/testdata/sf0.001"


def plain(rows, positives=5, negatives=10):
    """Scores of every pair, in Python's whole numbers."""
    good = {}
    for key, label, vector in rows:
        if None in (key, label, vector) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        good.setdefault((key, label, tuple(math.floor(256 * x) for x in vector)), None)
    out = []
    for key, label, vector in good:
        if key % 100:
            continue
        score = lambda v: sum(a * b for a, b in zip(vector, v, strict=True))  # noqa: E731, B023
        near = {(-score(v), k) for k, at, v in good if at == label and k != key and len(v) == len(vector)}
        other = {(-score(v), k) for k, at, v in good if at != label and len(v) == len(vector)}
        for p, positive in sorted(near)[:positives]:
            found = sorted((n, k) for n, k in other if 30 * -p <= 100 * -n <= 90 * -p)[:negatives]
            out += [(key, positive, i, k, -p, -n) for i, (n, k) in enumerate(found, 1)]
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in mine_hard_negatives(df, **options).collect())


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SMALL}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", "embedding")


def test_whole_table(vectors):
    rows = [tuple(r) for r in vectors.collect()]
    want = plain(rows)
    assert len(want) > 100 and got(vectors) == want
    # Several packs of anchors, several tasks.
    assert got(vectors.repartition(5), pack=200) == want


def test_edge_cases(spark):
    rng = random.Random(5)
    some = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    shared = some(8)
    rows = [
        (None, 1, some(8)), (100, None, some(8)), (200, 1, None), (300, 1, [None, *some(7)]), (1, 1, [math.nan, *some(7)]), (2, 1, [math.inf, *some(7)]),
        (400, 1, [0.0] * 8), (500, 2, []), (501, 2, []), (502, 3, []), (600, 1, some(5)), (601, 1, some(5)), (602, 2, some(5)),
        (700, 3, shared), (700, 3, shared), (701, 3, shared), (702, 3, [x * 1.5 for x in shared]), (703, 4, [x * 0.5 for x in shared]), (704, 4, [x * 0.5 for x in shared]),
        (703, 4, [x * 0.5 for x in shared]), (800, 5, [60_000.0, *some(7)]), (801, 5, [50_000.0, *some(7)]), (802, 6, [30_000.0, *some(7)]),
        *[(1000 + i, i % 3, [x * 10 ** rng.randint(-3, 2) for x in some(8)]) for i in range(300)],
    ]
    df = spark.createDataFrame(rows, "id long, label int, embedding array<double>")
    want = plain(rows)
    assert {700, 800, 1000} <= {r[0] for r in want}
    assert got(df.repartition(3)) == want
    assert got(df.coalesce(1), pack=60) == want
    assert got(df.limit(0)) == []
    assert got(df.filter("id % 100 <> 0")) == []


def test_clustered_rows_and_ties(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    rows = [(i, i % 6, [float(x) for x in np.round(centres[i % 6] + rng.normal(size=12) / 8, 1)]) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, label int, embedding array<float>")
    kept = [tuple(r) for r in df.collect()]
    assert got(df, positives=3, negatives=4) == plain(kept, 3, 4)


def test_scores_stay_within_bounds():
    rng = np.random.default_rng(7)
    for scale in (1, 30, 5000):
        vectors, anchors = np.floor(scale * rng.normal(size=(400, 16))), np.floor(scale * rng.normal(size=(50, 16)))
        anchors[0], anchors[1], vectors[0] = vectors[1], -vectors[2], 0
        towards = directions(16, vectors)
        norms, own = np.sqrt((vectors**2).sum(1)), np.sqrt((anchors**2).sum(1))
        theta = angles_to(vectors, norms, towards).astype(np.float32).astype(np.float64)
        phi = angles_to(anchors, own, towards).astype(np.float32).astype(np.float64)
        scores = dot(anchors, vectors)
        for row in range(400):
            t, n = theta[row : row + 1], norms[row]
            lower, upper = score_bounds(phi, own, t.min(0), t.max(0), n, n)
            assert (lower <= scores[:, row]).all() and (scores[:, row] <= upper).all()
        lower, upper = score_bounds(phi, own, theta.min(0), theta.max(0), norms.min(), norms.max())
        assert (lower[:, None] <= scores).all() and (scores <= upper[:, None]).all()


def test_large_numbers_are_exact():
    a = np.array([[2.0**24 - 1] * 64, [3.0] * 64])
    assert dot(a, a).tolist() == [[64 * (2**24 - 1) ** 2, 64 * 3 * (2**24 - 1)], [64 * 3 * (2**24 - 1), 576]]
