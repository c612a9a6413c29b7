import numpy as np
from pyspark.sql import functions as F

from larder.llm.neighbours import hilbert_keys, search

SCHEMA = "vec_id long, embedding array<float>, rank int, score double"


def _exact(rows, asks, k):
    usable = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q in usable:
        if asks(q):
            near = [(-float(v @ usable[q] / np.linalg.norm(v) / np.linalg.norm(usable[q])), i) for i, v in usable.items() if i != q and len(v) == len(usable[q])]
            out[q] = [(i, -s) for s, i in sorted((round(s, 9), i) for s, i in near)[:k]]
    return out


def _run(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, 1.0) for r in rows], SCHEMA).repartition(3)
    found = {}
    for r in search(frame, F.col("vec_id") % 10 == 0, **options).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    return found


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(300)]
    rows += [(i, [1.0] + [0.0] * 5) for i in range(300, 360)]
    rows += [(400, None), (410, []), (420, [0.0] * 6), (430, [None, 1.0] + [0.0] * 4), (440, [float("nan")] * 6), (450, [float("inf")] * 6), (None, [1.0] * 6), (460, [1.0, 2.0]), (461, [2.0, 4.1]), (470, [1.0, 2.0, 3.0])]
    rows += rows[:5]
    found, exact = _run(spark, rows), _exact(rows, lambda q: q % 10 == 0, 5)
    assert set(found) == {q for q, near in exact.items() if near}
    for q, near in found.items():
        assert [i for i, _ in near] == [i for i, _ in exact[q]], q
        assert np.allclose([s for _, s in near], [s for _, s in exact[q]], atol=1e-9)


def test_recall_with_narrow_windows(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 24)) * 2
    rows = [(i, (centres[i % 40] + rng.standard_normal(24)).tolist()) for i in range(4000)]
    found, exact = _run(spark, rows, least_window=64), _exact(rows, lambda q: q % 10 == 0, 5)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in exact[q]}) for q in exact)
    assert hits >= 0.9 * 5 * len(exact)


def test_curve_steps_to_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_empty_table(spark):
    assert search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0
