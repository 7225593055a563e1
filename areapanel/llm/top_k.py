"""Exact top-k inner products by MaxScore over blocks of vectors.

Components are the terms: a block holds, per component, the values of its vectors (its postings), and the largest and
smallest of them. For a query, a component's bound is the most it can add in this block. Components are taken by
falling bound; the first ones, up to where all that is left could not lift a vector without them past the k-th best
score so far, are essential and traversed for all vectors; the rest are probed, some at a time, only for
vectors that are still competitive. Each task carries its queries' k best from block to block; the shards' lists
are merged by one ranking at the end.

Blocks of vectors meet blocks of queries by a key join, so neither side is ever held whole. Vectors that are null, or hold
a null or non-finite component, take no part; shorter vectors count as filled up with zeros. Products are
exact: where they could pass 62 bits, a block is searched with unbounded integers. A component or a score that a long cannot hold raises.
Ties go to the smaller vec_id. Rows with equal vec_id and equal score are one candidate each.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areapanel.llm.tables import query, stage, table

TOP = 5
SCALE = 256
BLOCK_ROWS = 8192
QUERY_ROWS = 1024
PROBE = 8
# Sums below this cannot wrap, the rounding of the estimate included.
SAFE = float(1 << 62)
BLOCKS = "part int, number int, n int, width int, ids binary, terms binary"


def _pack(rows_per_block: int):
    """Rows (vec_id, values array<long>) to blocks: ids, and one row of values for each component."""
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, values = [], []

        def flush():
            width = max(map(len, values))
            table_ = np.zeros((width, len(values)), np.int64)
            for i, v in enumerate(values):
                table_[:len(v), i] = v
            order = np.argsort(ids, kind="stable")
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([width], pa.int32()),
                pa.array([np.array(ids, np.int64)[order].tobytes()], pa.binary()),
                pa.array([np.ascontiguousarray(table_[:, order]).tobytes()], pa.binary())], ["part", "number", "n", "width", "ids", "terms"])
        for batch in batches:
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(vec_id)
                values.append(v.values.to_numpy())
                if len(ids) >= rows_per_block:
                    yield flush()
                    ids, values, number = [], [], number + 1
        if ids:
            yield flush()
    return run


class Postings:
    """A block: values[d] are the vectors' values of component d."""

    def __init__(self, n: int, width: int, ids: bytes, terms: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.values = np.frombuffer(terms, np.int64).reshape(width, n)
        self.low, self.high = self.values.min(1), self.values.max(1)

    def unbounded(self) -> Postings:
        """The same with integers of any size."""
        wide = copy.copy(self)
        wide.values, wide.low, wide.high = (v.astype(object) for v in (self.values, self.low, self.high))
        return wide


def max_score(block: Postings, vector: np.ndarray, own_id: int, best: tuple[np.ndarray, np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
    """The best (scores, ids) so far, with those of this block; sorted by falling score, then id."""
    width = min(len(vector), len(block.values))
    query_ = vector[:width]
    most = np.maximum(np.abs(block.low[:width].astype(float)), np.abs(block.high[:width].astype(float)))
    if (np.abs(query_.astype(float)) * most).sum() >= SAFE:
        block, query_ = block.unbounded(), query_.astype(object)
    bound = np.maximum(query_ * block.low[:width], query_ * block.high[:width])
    terms = np.flatnonzero(query_)
    terms = terms[np.argsort(-np.abs(query_[terms] * (block.high[terms] - block.low[terms])), kind="stable")]
    left = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)  # the most that terms i, i+1, ... can add
    full = len(best[0]) >= top
    goal = best[0][-1] if full else None
    # essential: the fewest leading terms whose absence leaves less than the k-th best score
    enough = np.flatnonzero(left < goal) if full else np.zeros(0, np.int64)
    taken = max(1, int(enough[0])) if len(enough) else len(terms)
    partial = np.zeros(block.values.shape[1], block.values.dtype)
    for d in terms[:taken]:
        partial += query_[d] * block.values[d]
    alive = np.arange(len(partial))
    for at in range(taken, len(terms) + PROBE, PROBE):
        if full:
            keep = partial + left[min(at, len(terms))] >= goal
            if not keep.all():
                alive, partial = alive[keep], partial[keep]
        if at >= len(terms) or not len(alive):
            break
        for d in terms[at:at + PROBE]:
            partial = partial + query_[d] * block.values[d, alive]
    other = block.ids[alive] != own_id
    scores, ids = np.concatenate([best[0], partial[other]]), np.concatenate([best[1], block.ids[alive][other]])
    if len(scores) > 8 * top:  # far fewer before sorting; all that tie with the last stay
        least = np.sort(scores)[-top] if scores.dtype == object else np.partition(scores, len(scores) - top)[len(scores) - top]
        scores, ids = scores[scores >= least], ids[scores >= least]
    order = np.lexsort((ids, -scores))[:top]
    return scores[order], ids[order]


def _search(top: int):
    def run(batches):
        number, best = None, {}

        def results():
            rows = [(q, int(v), int(s)) for (q, _), (scores, ids) in best.items() for s, v in zip(scores, ids)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                queries = Postings(*row[1:5])
                if row[0] != number:
                    if best:
                        yield results()
                    number, best = row[0], {}
                block = Postings(*row[5:9])
                for i, vec_id in enumerate(queries.ids.tolist()):
                    key = (vec_id, i)
                    best[key] = max_score(block, queries.values[:, i], vec_id, best.get(key, (np.zeros(0, np.int64),) * 2), top)
        if best:
            yield results()
    return run


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and floor(scale * component) of vectors without null or non-finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(finite)

    def scaled(x):
        value = x.cast("double") * scale
        return F.when(F.abs(value) < float(1 << 63), F.floor(value).cast("long")).otherwise(
            F.raise_error(F.lit("a scaled component passes 64 bits")).cast("long"))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", scaled).alias("values"))


def top_k(vectors: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` best of `vectors` for each row of `queries`, never itself (both: vec_id, values)."""
    blocks = stage(vectors.mapInArrow(_pack(BLOCK_ROWS), BLOCKS), "vectors")
    asked = queries.repartitionByRange("vec_id").mapInArrow(_pack(QUERY_ROWS), BLOCKS)
    asked = stage(asked, "queries").withColumn("q", F.row_number().over(Window.orderBy("part", "number")) - 1)  # a row per block
    count = asked.count()
    if not count:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    many = blocks.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    q = asked.select("q", *[F.col(c).alias(f"q_{c}") for c in ("n", "width", "ids", "terms")])
    both = many.join(q, "q").select("q", "q_n", "q_width", "q_ids", "q_terms", "n", "width", "ids", "terms")
    tasks = max(1, min(1024, blocks.count()))
    both = both.repartition(tasks, "q", F.pmod(F.xxhash64("ids"), F.lit(max(1, tasks // count)))).sortWithinPartitions("q")
    found = both.mapInArrow(_search(top), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query("op8_maxscore_top_k", OP8_SQL)
def op8(spark, folder):
    vectors = whole_vectors(table(spark, folder, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))
