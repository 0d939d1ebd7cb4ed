"""Hard negatives: brute force on small tables, bounds of the approximation file, edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from svloom.llm import hard_negatives

VECTORS = "vec_id long, embedding array<double>, label int"


def brute(rows, positives=5, negatives=3, every=50, shift=7, labels=10):
    seen = {}
    for i, e, y in rows:
        if i is None or y is None or not e or any(x is None or not math.isfinite(x) for x in e):
            continue
        y = int(math.fmod(y + 1, labels)) if i % shift == 0 else y
        q = [math.floor(256 * x) for x in e]
        seen[i] = min(seen.get(i, (y, q)), (y, q))
    out = set()
    for a, (y, q) in seen.items():
        if a % every:
            continue
        scored = sorted((-sum(u * w for u, w in zip(q, r, strict=True)), i, z) for i, (z, r) in seen.items() if i != a and len(r) == len(q))
        for p, i, z in [x for x in scored if x[2] == y][:positives]:
            fit = [x for x in scored if x[2] != y and 50 * -p <= 100 * -x[0] <= 95 * -p][:negatives]
            out |= {(a, i, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(fit)}
    return out


def found(df, **more):
    rows = hard_negatives.hard_negatives(df, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_equal_to_brute_force_with_odd_rows(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0.1, 0.2) for _ in range(8)], rnd.randrange(3)) for i in range(260)]
    # ties by the hundred, another length, nulls of every kind, repeated ids, large components
    rows += [(1000 + i, rows[3][1], 1) for i in range(120)] + [(2000 + i, [0.5, 0.5], i % 2) for i in range(40)]
    rows += [(None, rows[0][1], 1), (3001, None, 1), (3002, rows[0][1], None), (3003, [], 1), (3004, [None] * 8, 1), (3005, [float("nan")] * 8, 1), (3006, [float("inf")] * 8, 1), (3007, [0.0] * 8, 1)]
    rows += [rows[7], (50, rows[9][1], 0), (50, rows[8][1], 0), (4000, [1e6] * 8, 2), (4050, [-1e6] * 8, 2), (-50, rows[11][1], -3), (-7, rows[12][1], -5)]
    df = spark.createDataFrame(rows, VECTORS).repartition(7).withColumn("dim", F.lit("clash")).withColumn("salt", F.lit(1)).withColumn("score", F.lit(None).cast("string"))
    want = brute(rows)
    assert want and found(df) == want


def test_small_blocks_and_few_cells_give_the_same(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 0.3) + (i % 4 == d) for d in range(6)], i % 4) for i in range(300)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    want = brute(rows, every=20)
    assert len(want) > 100
    for cells, size, anchors, held in ((2, 16, 3, 1), (256, 64, 128, 16)):
        monkeypatch.setattr(hard_negatives.cell_marks, "__defaults__", (cells,))
        monkeypatch.setattr(hard_negatives.approximation_file, "__defaults__", (size,))
        monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", anchors)
        monkeypatch.setattr(hard_negatives, "HELD", held)
        assert found(df, every=20) == want


def test_bounds_hold_and_prune(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    v = hard_negatives.usable(df, 7, 10, "vec_id", "embedding", "label")
    marks = hard_negatives.cell_marks(v)
    scored = [0, 0]
    for r in hard_negatives.approximation_file(v, marks).collect():
        block = hard_negatives.Block(r.asDict())
        every = np.arange(len(block.ids))
        for q in block.parts[:5]:
            lower, upper = (block.bound(t, every) for t in block.tables(q))
            exact = block.parts @ q
            assert (lower <= exact).all() and (exact <= upper).all()
            state = {5: hard_negatives.Places(3), int(exact.max() // 2): hard_negatives.Places(3)}
            scored[0] += hard_negatives._windows(block, every, q, block.tables(q), state, 3)
            scored[1] += len(every)
    assert 0 < scored[0] < scored[1] / 2


def test_empty_and_overflow(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
    big = spark.createDataFrame([(0, [1e8] * 4, 1), (50, [1e8] * 4, 1), (3, [1e8] * 4, 2)], VECTORS)
    with pytest.raises(Exception, match="64-bit"):
        hard_negatives.hard_negatives(big).collect()
    with pytest.raises(Exception, match="64-bit"):
        hard_negatives.hard_negatives(spark.createDataFrame([(0, [1e30], 1), (1, [1.0], 1)], VECTORS)).collect()
