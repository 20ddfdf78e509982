"""Hard negatives against all pairs, and what the certified end of a walk saves."""

import math

import numpy as np
import pytest

from worktrail.llm import hardneg

VECTORS = "vec_id bigint, embedding array<float>, label int"


def plain(rows):
    def fine(x):
        return x is not None and math.isfinite(x)

    own = [(i, int(lab), [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in rows
           if i is not None and lab is not None and v is not None and all(map(fine, v))]
    own = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in own]
    out = []
    for i, lab, v in own:
        if i % 100:
            continue
        near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other == lab)
                      for j, other, w in own if j != i)
        for p, j, _ in [x for x in near if x[2]][:5]:
            fits = [x for x in near if not x[2] and 30 * -p <= 100 * -x[0] <= 90 * -p][:10]
            out += [(i, j, r + 1, k, -p, -q) for r, (q, k, _) in enumerate(fits)]
    return sorted(out)


def mixed(n, dim=8, seed=3, crowd=0.3):
    """Random vectors, a crowd of near copies, and whole repeats."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) / math.sqrt(dim)
    near = rng.random(n) < crowd
    x[near] = x[0] + 0.02 * rng.standard_normal((near.sum(), dim))
    x[5::50] = x[5]
    labels = rng.integers(0, 10, n)
    return [(i, [float(a) for a in x[i]], int(labels[i])) for i in range(n)]


def told(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id",
                                       "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("shard,block", [(4096, 1024), (150, 3)])
def test_equal_to_all_pairs(spark, monkeypatch, shard, block):
    monkeypatch.setattr(hardneg, "SHARD", shard)
    monkeypatch.setattr(hardneg, "BLOCK", block)
    rows = mixed(1300)
    rows += [(None, rows[0][1], 1), (5000, None, 1), (5001, rows[0][1], None), (6000, [None] * 8, 1),
             (6100, [float("nan")] * 8, 1), (6200, [float("inf")] * 8, 2), (6300, [0.0] * 8, 3)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as score", "2 as rank", "3 as row", "4 as dim")
    got = told(hardneg.digest(df))
    assert got == plain(rows) and len(got) > 100


def test_few_rows_and_none(spark):
    assert told(hardneg.digest(spark.createDataFrame([], VECTORS))) == []
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (3, [0.5, 0.1], 2), (4, [0.9], 2)]
    got = told(hardneg.digest(spark.createDataFrame(rows, VECTORS)))
    assert got == [(0, 1, 1, 2, 65536, 32768), (0, 1, 2, 3, 65536, 32768)]


def test_too_long_vectors_are_refused(spark):
    rows = [(0, [1e30, 0.0], 0), (1, [1.0, 0.0], 0)]
    with pytest.raises(ValueError, match="too long"):
        hardneg.digest(spark.createDataFrame(rows, VECTORS))


def test_walk_ends_early_where_vectors_cluster():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 32))
    rows = np.floor(256 * (np.repeat(centres, 100, 0) + 0.05 * rng.standard_normal((4000, 32))))
    ids, labels = np.arange(4000), rng.integers(0, 10, 4000)
    walk = hardneg.Walk(ids, labels, rows, ids[::20], labels[::20], rows[::20])
    best = walk.positives(5)
    assert walk.walked < 0.5 * 4000 * 200
    scores = rows[::20] @ rows.T
    for i in range(200):
        ok = (labels == labels[20 * i]) & (ids != 20 * i)
        order = sorted(np.flatnonzero(ok), key=lambda j: (-scores[i, j], j))[:5]
        _, at = walk.read(np.sort(best[i])[::-1])
        assert at.tolist() == order
