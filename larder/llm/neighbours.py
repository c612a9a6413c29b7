"""Approximate nearest neighbours by shifted Hilbert curves.

Vectors are projected to a few random axes, once per curve with other axes and another shift, and
get their place on a Hilbert curve. Spark range-partitions each curve, which gives every vector a
rank; a query meets the blocks of ranks around its own on every curve, and what the curves find is
merged and reranked by exact cosine in double precision.

Equal vectors share one entry with their smallest ids, so no group of copies fills a window. The
window is a share of the vectors: in data without low-dimensional structure a fixed window would
lose recall as the data grow.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import written

CURVES = 12
AXES = 8
BITS = 6
#: Ranks to either side of a query on each curve, as a share of all vectors, and at least.
WINDOW = 0.06
LEAST_WINDOW = 1024
#: Vectors that are compared at once.
BLOCK = 4096
#: Ranks whose queries go together to a block.
CHUNK = 50 * BLOCK
#: Vectors from which the spread of the axes is taken (expected number).
SAMPLE = 8192

_VALID = "vec_id long, dim int, raw binary"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of (rows, axes) cell numbers below 2**bits."""
    x = cells.astype(np.uint64).T.copy()
    axes, one, zero = len(x), np.uint64(1), np.uint64(0)
    tops = [one << np.uint64(b) for b in range(bits - 1, 0, -1)]
    for top in tops:  # undo the turns of each level, from the coarsest on
        low = top - one
        for i in range(axes):
            turned = (x[i] & top) != 0
            swap = np.where(turned, zero, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
    for i in range(1, axes):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for top in tops:
        flip ^= np.where((x[-1] & top) != 0, top - one, zero)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << one | x[i] >> np.uint64(b) & one
    return key


def curve_keys(vectors: np.ndarray, curve: int, spread: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Keys of unit vectors on one curve: its own axes, and its own shift of the grid."""
    dim = vectors.shape[1]
    rng = np.random.default_rng((dim, curve))
    axes, shift = rng.standard_normal((dim, AXES)), rng.random(AXES)
    mean, cov = spread if spread else (np.zeros(dim), np.eye(dim) / dim)
    scale = np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", axes, cov, axes), 1e-18))
    at = ((vectors - mean) @ axes) / scale
    cells = (at + 4 + shift) / 9 * (1 << BITS)
    return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def _valid(batches):
    import pyarrow as pa

    for batch in batches:
        rows = []
        for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
            if vec_id is None or not vector.is_valid or vector.values.null_count or not len(vector.values):
                continue
            values = vector.values.to_numpy(zero_copy_only=False)
            if np.isfinite(values).all() and values.any():
                rows.append((vec_id, len(values), values.tobytes()))
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["vec_id", "dim", "raw"])


def _matrix(raws: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raws), np.float32 if len(raws[0]) == 4 * dim else np.float64).reshape(-1, dim).astype(np.float64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


_KEYED = "dim int, curve int, place long, digest string, raw binary, ids array<long>, asks boolean"


def _keyed(spreads: dict, curves: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            dims = np.array(batch.column(1).to_pylist())
            for dim in np.unique(dims):
                some = batch.take(pa.array(np.flatnonzero(dims == dim)))
                vectors = _unit(_matrix(some.column(2).to_pylist(), int(dim)))
                for curve in range(curves):
                    keys = curve_keys(vectors, curve, spreads.get(int(dim))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [some.column(1), pa.array([curve] * len(keys), pa.int32()), pa.array(keys), some.column(0), some.column(2), some.column(3), some.column(4)],
                        ["dim", "curve", "place", "digest", "raw", "ids", "asks"],
                    )

    return run


def _numbered(batches):
    """Adds the partition and the number of each row among the rows of its curve there."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        nth = []
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            nth.append(seen.get(key, 0))
            seen[key] = nth[-1] + 1
        kept = [0, 1, 3, 4, 5, 6]
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array([part] * len(nth), pa.int32()), pa.array(nth, pa.int64())], [*[batch.schema.names[k] for k in kept], "part", "nth"])


def _nearest(k: int):
    def run(key, candidates, queries):
        import pyarrow as pa

        out = []
        if candidates.num_rows and queries.num_rows:
            dim = key[0].as_py()
            vectors, ids = _matrix(candidates["raw"].to_pylist(), dim), candidates["ids"].to_pylist()
            smallest = np.array([i[0] for i in ids])
            unit, digests, raws = _unit(vectors), queries["digest"].to_pylist(), queries["raw"].to_pylist()
            for at in range(0, len(digests), 256):
                asked = _unit(_matrix(raws[at : at + 256], dim))
                near = asked @ unit.T
                for row, scores in enumerate(near):
                    best = np.arange(len(scores))
                    if len(scores) > k:
                        best = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[-k] - 1e-12)
                    exact = np.einsum("ij,j->i", unit[best], asked[row])
                    order = np.lexsort((smallest[best], -exact))[:k]
                    out += [(digests[at + row], i, float(exact[o])) for o in order for i in ids[best[o]]]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table({"digest": pa.array(columns[0], pa.string()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return run


def _spreads(entries: DataFrame, sample: int) -> dict:
    """Mean and covariance of unit vectors, per dimension, from a bounded sample by digest."""
    n = entries.count()
    share = min(1.0, sample / max(1, n))
    rows = entries.filter(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") < int(share * (1 << 32)) + 1).select("dim", "raw").collect()
    by_dim: dict[int, list[bytes]] = {}
    for r in rows:
        by_dim.setdefault(r["dim"], []).append(bytes(r["raw"]))
    found = {}
    for dim, raws in by_dim.items():
        if len(raws) > 2:
            unit = _unit(_matrix(raws, dim))
            found[dim] = unit.mean(axis=0), np.cov(unit.T).reshape(dim, dim)
    return found


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, window: float = WINDOW, least_window: int = LEAST_WINDOW
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest other rows found for every row with `is_query`.

    Nearness is cosine; ties go to the smaller id. Rows without an id, and vectors that are null,
    empty, zero or hold null or non-finite components, take no part; vectors of different lengths do
    not meet. Rows that repeat id and vector count once. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), is_query.alias("asks"))
    valid = rows.select("vec_id", "vector").mapInArrow(_valid, _VALID).withColumn("digest", F.sha2("raw", 256))
    valid = written(valid, "vectors")
    asked = rows.filter("asks").select("vec_id").distinct()
    queries = valid.join(asked, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "digest").distinct()
    smallest = F.row_number().over(Window.partitionBy("digest").orderBy("vec_id"))
    # the limit is applied before the shuffle too, so a group of copies sends a few rows of each task
    distinct = valid.dropDuplicates(["digest", "vec_id"]).withColumn("_n", smallest).filter(F.col("_n") <= k + 1)
    distinct = distinct.groupBy("digest").agg(F.first("dim").alias("dim"), F.first("raw").alias("raw"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asks = queries.select("digest").distinct().withColumn("asks", F.lit(True))
    entries = distinct.join(asks, "digest", "left").select("digest", "dim", "raw", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))
    entries = written(entries, "entries")
    keyed = entries.mapInArrow(_keyed(_spreads(entries, SAMPLE), curves), _KEYED)
    n_parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["dim", "curve", "place", "digest"]
    numbered = keyed.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    numbered = written(numbered.mapInArrow(_numbered, "dim int, curve int, digest string, raw binary, ids array<long>, asks boolean, part int, nth long"), "curves")
    counts = numbered.groupBy("dim", "curve", "part").agg(F.count("*").alias("_rows"))
    by_curve = Window.partitionBy("dim", "curve")
    before = F.coalesce(F.sum("_rows").over(by_curve.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("dim", "curve", "part", before.alias("_before"), F.sum("_rows").over(by_curve).alias("n"))
    ranked = numbered.join(counts, ["dim", "curve", "part"]).withColumn("place", F.col("_before") + F.col("nth"))
    half = F.greatest(F.lit(least_window), F.ceil(F.col("n") * window)).cast("long")

    def steps(low: Column, high: Column, size: int) -> Column:
        last = F.floor((F.col("n") - 1) / size)
        return F.explode(F.sequence(F.greatest(F.lit(0), F.floor(low / size)).cast("long"), F.least(last, F.floor(high / size)).cast("long")))

    block = F.floor(F.col("place") / BLOCK).cast("long")
    keys = ["dim", "curve", "chunk", "block"]
    candidates = ranked.withColumn("block", block).select("dim", "curve", "block", "raw", "ids", steps(F.col("block") * BLOCK - half, (F.col("block") + 1) * BLOCK - 1 + half, CHUNK).alias("chunk"))
    own = [F.col(c).alias(c) for c in ("dim", "curve", "digest", "raw")]  # columns of their own, for the join with themselves
    around = ranked.filter("asks").select(*own, F.floor(F.col("place") / CHUNK).cast("long").alias("chunk"), steps(F.col("place") - half, F.col("place") + half, BLOCK).alias("block"))
    found = candidates.groupBy(*keys).cogroup(around.groupBy(*keys)).applyInArrow(_nearest(k + 1), "digest string, vec_id long, score double")
    found = found.groupBy("digest", "vec_id").agg(F.max("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("digest").orderBy(F.desc("score"), "vec_id"))
    found = written(found.withColumn("_n", best).filter(F.col("_n") <= k + 1).drop("_n"), "found")
    answers = queries.join(found, "digest").filter(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
