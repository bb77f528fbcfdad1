"""Exact top-k inner products by pivot-table elimination.

Vectors are integers, so scores are exact (products are summed as doubles, which
is exact below 2 ** 53; larger squares are refused).  For pivots p_1..p_m the table of
distances |x - p_j| is computed once per candidate.  For a query q the triangle
inequality gives |q - x| >= max_j | |q - p_j| - |x - p_j| |, the maximum lower
bound of the row; with 2 <q, x> = |q|^2 + |x|^2 - |q - x|^2 it is an upper
bound on the score.  Candidates are evaluated in order of that bound and the
evaluation stops exactly when the next bound is below the k-th score so far.

Queries are dealt in blocks of a fixed size.  A block is broadcast, each
partition of the written pivot table returns k rows a query, and these are
written before the next block begins, so neither plan nor memory grows with the
number of queries; one window merges them.  Within a partition the k best so far go on from chunk to chunk,
so later chunks are eliminated faster.

Edge cases: vectors that are null, hold a null or non-finite
component or are empty take no part; each length of vectors is searched by
itself, as products need equal lengths; ties go to the smaller id; rows that share an id count each (a query's own id never),
and each row of a query's id, repeated ones too, is a query with results of its own; fewer than k candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import materialize, shared_dir

K, EVERY, SCALE = 5, 50, 256.0
PIVOTS = 32
#: Queries broadcast at once, about; at most that many bytes of them.
QUERY_BLOCK, QUERY_BYTES = 16_384, 32 << 20
#: Candidates eliminated at once, and evaluated between two looks at the bound.
CHUNK, STEP = 4096, 512
MATCH = "query long, query_id long, vec_id long, score long"


def integers(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component, of the rows that take part."""
    x = F.transform("embedding", lambda x: x.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(good)
    return rows.select("vec_id", F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _table_batches(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds the pivot distances of each candidate."""
    dim = pivots.shape[1]
    for batch in batches:
        x = _matrix(batch.column("v"), dim)
        if (x * x).sum(1).max(initial=0) >= 2**53:
            raise ValueError("vectors are too long for exact scores")
        far = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots.T), 0))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(far.ravel()), len(pivots)).cast(pa.list_(pa.float64()))], [*batch.schema.names, "far"])


class QueryBlock:
    def __init__(self, numbers: np.ndarray, ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, k: int):
        self.numbers, self.ids, self.q, self.k = numbers, ids, q, k
        self.square = (q * q).sum(1)
        self.far = np.sqrt(np.maximum(self.square[:, None] + (pivots * pivots).sum(1) - 2 * (q @ pivots.T), 0))


def eliminate(block: QueryBlock, i: int, ids: np.ndarray, x: np.ndarray, square: np.ndarray, far: np.ndarray, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of query i among ``best`` and the candidates given."""
    low = np.abs(far - block.far[i]).max(1)
    bound = (block.square[i] + square - low * low) / 2 + 1e-3 * (1 + low)  # the slack covers rounding
    score, ident = best
    floor = score[-1] if len(score) == block.k else -np.inf
    open_ = np.flatnonzero(bound >= floor)
    open_ = open_[np.argsort(-bound[open_], kind="stable")]
    for at in range(0, len(open_), STEP):
        part = open_[at : at + STEP]
        if bound[part[0]] < floor:
            break
        part = part[ids[part] != block.ids[i]]
        score, ident = np.r_[score, x[part] @ block.q[i]], np.r_[ident, ids[part]]
        keep = np.lexsort((ident, -score))[: block.k]
        score, ident = score[keep], ident[keep]
        floor = score[-1] if len(score) == block.k else -np.inf
    return score, ident


def _search_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    block: QueryBlock = shared.value
    dim, m = block.q.shape[1], block.far.shape[1]
    best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in block.ids]
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            ids, x = np.asarray(part.column("vec_id")), _matrix(part.column("v"), dim)
            square, far = (x * x).sum(1), _matrix(part.column("far"), m)
            best = [eliminate(block, i, ids, x, square, far, best[i]) for i in range(len(best))]
    rows = [len(s) for s, _ in best]
    if sum(rows):
        columns = [np.repeat(block.numbers, rows), np.repeat(block.ids, rows), np.concatenate([i for _, i in best]), np.concatenate([s for s, _ in best]).astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: float = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query, among those of its length."""
    spark = vectors.sparkSession
    rows = integers(vectors, scale)
    lengths = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect()
    parts = [p for r in lengths if r["count"] > 1 and (p := _top_k(rows.where(F.size("v") == r.dim), r.dim, k, every, pivots)) is not None]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    merged = parts[0]
    for more in parts[1:]:
        merged = merged.unionByName(more)
    best = Window.partitionBy("query", "dim").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _top_k(rows: DataFrame, dim: int, k: int, every: int, pivots: int) -> DataFrame | None:
    """Candidates of the vectors of one length, k a query and partition at most; None without any query."""
    spark = rows.sparkSession
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    points = np.array([r.v for r in first], np.float64)
    schema = "vec_id long, v array<bigint>, far array<double>"
    candidates = materialize(rows.mapInArrow(lambda it: _table_batches(it, points), schema), "pivot-table")
    queries = candidates.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v", F.monotonically_increasing_id().alias("query"))
    blocks = -(-queries.count() // max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * (dim + len(points))))))
    queries = materialize(queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(max(blocks, 1)))), "queries")
    folder = f"{shared_dir(spark)}/matches-{uuid.uuid4().hex[:12]}"
    for b in range(blocks):
        own = queries.where(F.col("block") == b).select("query", "vec_id", "v").orderBy("vec_id").collect()
        block = spark.sparkContext.broadcast(QueryBlock(np.array([r.query for r in own], np.int64), np.array([r.vec_id for r in own], np.int64), np.array([r.v for r in own], np.float64).reshape(-1, dim), points, k))
        candidates.mapInArrow(lambda it, block=block: _search_batches(it, block), MATCH).write.parquet(f"{folder}/block={b}")
        block.unpersist()
    if not blocks:
        return None
    return spark.read.schema(MATCH).parquet(*[f"{folder}/block={b}" for b in range(blocks)]).withColumn("dim", F.lit(dim))
