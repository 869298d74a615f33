"""Exact top-k by inner product from an impact-ordered index, score at a time.

Vectors are integer components floor(1024 * x). A block of vectors has, for each dimension, its postings in segments of
one sign and one quantised impact (components shifted right), from high to low. For a query, segments of all dimensions
are processed in rounds by descending impact (|query component| * segment's impact) and added up; what a vector can still
gain or lose is bounded by the dimensions' next segments and the quantisation. A round ends the search only if the proof
stands: no vector outside of a small set can reach the k-th best lower bound any more. The members of that set (ties
included) are then scored exactly.

Every vector is in one block, whose index is built once; all queries stream past it, in batches, so that what a task holds
is a block. Only queries are copied, once for each block. The blocks' best k are merged per query.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part, as query or candidate; of
vectors of unequal length the missing components count as 0; ties go to the smaller id; null ids take no part. Rows that
repeat an id are rows of their own: each is a query with a result of its own, whose candidates are all other rows, also
those of its id. Scores must fit 64 bits (else the query fails); components may be as large as that allows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SCALE = 1024
SHIFT = 4
ROUNDS = 10
#: Vectors of a block.
BLOCK = 16384


class ImpactIndex:
    """The index of one block."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, vectors: np.ndarray):
        """marks: what tells rows of one id apart, a hash of the vector."""
        order = np.argsort(ids, kind="stable")
        self.ids, self.marks, self.vectors = ids[order], marks[order], np.ascontiguousarray(vectors[order])
        size = np.abs(self.vectors)
        self.order = np.ascontiguousarray(np.argsort(-size, axis=0, kind="stable").T.astype(np.int32))  # per dimension, descending
        ranked = np.take_along_axis(self.vectors.T, self.order.astype(np.int64), axis=1)
        self.level = (np.abs(ranked) >> SHIFT).astype(np.int64)  # quantised impacts of the postings
        self.signed = np.sign(ranked) * (self.level << SHIFT)
        self.negative = np.ascontiguousarray(-self.level)

    def exact(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        some = self.vectors[rows]
        if not len(rows) or int(np.abs(some).max(initial=0)) * int(np.abs(query).max(initial=0)) * len(query) < 1 << 63:
            return some @ query
        return (some.astype(object) @ query.astype(object)).astype(np.int64)  # raises where a score is too large

    def top(self, query: np.ndarray, query_id: int, mark: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best but for one row of this id and mark, by descending score, then id."""
        n, dims = self.vectors.shape
        weight = np.abs(query)
        acc, done = np.zeros(n), np.zeros(dims, np.int64)
        highest = weight * (self.level[:, 0] + 1)
        blur = np.zeros(dims)  # what quantisation hides in the dimensions begun
        threshold = float(highest.max(initial=0))
        chosen = np.arange(n)
        for step in range(1, ROUNDS + 1):
            threshold = threshold * 0.72 if step < ROUNDS else 0.0
            rest = np.zeros(dims)
            for d in np.flatnonzero(weight):
                lowest = int(threshold // weight[d]) if threshold else 0  # segments of this impact or higher
                to = n if lowest == 0 else int(np.searchsorted(self.negative[d], -lowest, side="right"))
                lo = done[d]
                if to > lo:
                    acc[self.order[d, lo:to]] += query[d] * self.signed[d, lo:to]
                    done[d] = to
                    blur[d] = weight[d] * ((1 << SHIFT) - 1)
                if done[d] < n:
                    rest[d] = weight[d] * ((self.level[d, done[d]] << SHIFT) + (1 << SHIFT) - 1)
            # A posting is either processed (off by less than a level) or below the next segment's bound.
            slack = float(np.maximum(blur, rest).sum())
            slack += 1e-9 * (slack + float(np.abs(acc).max(initial=0)))  # rounding of large sums
            if n <= k + 1:
                break
            floor = np.partition(acc, n - k - 1)[n - k - 1] - slack  # k + 1, as the query itself may be among them
            chosen = np.flatnonzero(acc + slack >= floor)
            if len(chosen) <= max(4 * k, n >> 6):
                break
        own = np.flatnonzero((self.ids[chosen] == query_id) & (self.marks[chosen] == mark))[:1]
        chosen = np.delete(chosen, own)
        exact, ids = self.exact(chosen, query), self.ids[chosen]
        best = np.lexsort((ids, -exact))[:k]
        return ids[best], exact[best]


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def _matrix(rows: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    arr = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    sizes = np.asarray(arr.value_lengths(), np.int64)
    flat = np.asarray(arr.flatten(), np.int64)
    out = np.zeros((len(sizes), dims), np.int64)
    row, column = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    some = column < dims  # what the other side lacks counts as 0
    out[row[some], column[some]] = flat[some]
    return out


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k other candidates with the highest inner product."""

    def ready(df: DataFrame) -> DataFrame:
        ok = df.filter(F.col(id_col).isNotNull() & _usable(F.col(vector_col)))
        rows = ok.select(F.col(id_col).alias("id"), F.transform(F.col(vector_col), lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("long")).alias("v"))
        return rows.withColumn("mark", F.xxhash64("v"))

    # Rows that are the same throughout are one query, answered as often as there are of them.
    cands, asks = ready(candidates), ready(queries).groupBy("id", "mark").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("times"))
    blocks = max(1, -(-cands.count() // BLOCK))
    one = cands.select(F.pmod(F.xxhash64("id", "mark"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "id", "mark", "v")
    two = asks.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "id", "mark", "v")

    def search(batches):
        held: list[pa.RecordBatch] = []
        index, block = None, None
        for batch in batches:
            edges = np.flatnonzero(np.diff(np.asarray(batch.column("block")) * 2 + np.asarray(batch.column("asks").cast(pa.int32())), prepend=-1))
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows], strict=True):
                part = batch.slice(lo, hi - lo)
                if part.column("block")[0].as_py() != block:
                    index, block, held = None, part.column("block")[0].as_py(), []
                if not part.column("asks")[0].as_py():
                    held.append(part)
                elif held:
                    if index is None:
                        t = pa.Table.from_batches(held)
                        dims = int(np.asarray(t.column("v").combine_chunks().value_lengths()).max())
                        index = ImpactIndex(np.asarray(t.column("id"), np.int64), np.asarray(t.column("mark"), np.int64), _matrix(t.column("v"), dims))
                    yield answers(index, part)

    def answers(index: ImpactIndex, part: pa.RecordBatch) -> pa.RecordBatch:
        asked, out = _matrix(part.column("v"), index.vectors.shape[1]), []
        for qid, mark, q in zip(part.column("id").to_pylist(), part.column("mark").to_pylist(), asked, strict=True):
            ids, scores = index.top(q, qid, mark, k)
            out.append((np.full(len(ids), qid), np.full(len(ids), mark), ids, scores))
        return pa.record_batch([pa.array(np.concatenate([o[i] for o in out]).astype(np.int64)) for i in range(4)], names=["query_id", "mark", "vec_id", "score"])

    dealt = one.union(two).repartition(blocks, "block").sortWithinPartitions("block", "asks")
    found = dealt.mapInArrow(search, "query_id long, mark long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    times = asks.select(F.col("id").alias("query_id"), "mark", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return best.join(times, ["query_id", "mark"]).select("query_id", "rank", "vec_id", "score")


def op4_exact_top_k(spark, sf_dir):
    """The ten nearest vectors of every hundredth vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.filter("vec_id % 100 = 0"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
