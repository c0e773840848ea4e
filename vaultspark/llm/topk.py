"""Exact top-k search by aggregation without random access.

Each block of candidates keeps, for every dimension, its vectors in order of that dimension's
value: a sorted list that a query reads from the top where its weight is positive and from the
bottom where it is negative. The lists are read in step, each stage some way further. A candidate's
lower bound is what was read of it plus the least that its other dimensions can hold, its upper bound
the same with the values now at the lists' heads. A query stops reading when few candidates' upper
bounds reach its k-th lower bound, and those candidates' scores are then resolved. Queries and
candidates meet block by block, and a block's winners, k to a query, in a last top-k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, tune

#: Bounds: candidates and queries of one block.
BLOCK_ROWS = 4096
QUERY_ROWS = 2048
#: Shares of the lists that are read before the bounds are looked at again.
STAGES = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0)
#: Candidates of a query, as a multiple of k, few enough to resolve.
FEW = 8


class Lists:
    """Sorted lists of one block of candidates, by dimension. Candidates stand in order of their id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.by_value = np.argsort(self.vectors, axis=0, kind="stable")
        self.value = np.take_along_axis(self.vectors, self.by_value, axis=0)

    def read(self, seen: np.ndarray, upto: int, depth: int, top: bool) -> None:
        """Marks in `seen` the entries from `upto` to `depth` of each list, from its top or its bottom."""
        n = len(self.ids)
        rows = self.by_value[n - depth : n - upto] if top else self.by_value[upto:depth]
        np.put_along_axis(seen, rows, True, axis=0)

    def bounds(self, depth: int, seen: tuple[np.ndarray, np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds [query, candidate] once `depth` entries of each list are read.

        What was read of a candidate counts as it is; of the rest the lists' heads are the most, and
        their last entries the least.
        """
        n, x = len(self.ids), self.vectors
        high, low = self.value[n - 1 - min(depth, n - 1)], self.value[min(depth, n - 1)]  # the heads, read from either end
        most = np.concatenate([np.where(seen[0], x, high), np.where(seen[1], x, low)], axis=1).astype(weights.dtype)
        least = np.concatenate([np.where(seen[0], x, self.value[0]), np.where(seen[1], x, self.value[-1])], axis=1).astype(weights.dtype)
        return weights @ least.T, weights @ most.T

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query rows, ids, scores, and the share of the lists read, of the k best candidates of each query but its own.

        Ties go to the smaller id.
        """
        n, width = self.vectors.shape
        largest = width * float(np.abs(self.vectors).max(initial=0)) * float(np.abs(queries).max(initial=0))
        kind = np.float32 if largest < 1 << 24 else np.float64  # sums of whole numbers, exact
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        active, upto = np.arange(len(queries)), 0
        seen = np.zeros((n, width), bool), np.zeros((n, width), bool)
        for share in STAGES:
            if not len(active):
                break
            depth = min(n, int(np.ceil(share * n)))
            for side, top in zip(seen, (True, False)):
                self.read(side, upto, depth, top)
            upto = depth
            q = queries[active]
            least, most = self.bounds(depth, seen, np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1).astype(kind))
            first, last = np.searchsorted(self.ids, own[active], "left"), np.searchsorted(self.ids, own[active], "right")
            for j in np.flatnonzero(last > first):
                least[j, first[j] : last[j]] = -np.inf
                most[j, first[j] : last[j]] = -np.inf
            bound = np.partition(least, n - k, axis=1)[:, n - k] if n >= k else np.full(len(active), -np.inf)
            rivals = most >= np.maximum(bound, np.finfo(kind).min)[:, None]
            settled = (np.count_nonzero(rivals, axis=1) <= FEW * k) | (depth == n)
            for j in np.flatnonzero(settled):
                who = np.flatnonzero(rivals[j])
                score = most[j, who].astype(np.int64) if depth == n else self.vectors[who] @ queries[active[j]]
                best = np.argsort(-score, kind="stable")[:k]
                out.append((np.full(len(best), active[j]), self.ids[who[best]], score[best], np.full(len(best), depth / n)))
            active = active[~settled]
        return tuple(np.concatenate(x) for x in zip(*out))


def quantized(vectors: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x); rows that are null or hold null or no finite number go."""
    x = F.col(vector)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale))))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(finite).select("vec_id", whole.alias("v"))


def _matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column; shorter rows are filled with zeros, longer ones cut where `width` is given."""
    lengths = np.diff(lists.offsets.to_numpy())
    width = int(lengths.max(initial=0)) if width is None else width
    out = np.zeros((len(lists), width), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), lengths)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    good = col < width
    out[row[good], col[good]] = flat[good]
    return out


def _blocks(rows: DataFrame) -> DataFrame:
    """(block, ids, vectors, width): rows (vec_id, v) in blocks of at most BLOCK_ROWS, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        made = TaskContext.get().partitionId() << 32

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            own = _matrix(t.column(1).combine_chunks())
            packed = [pa.array([x.tobytes()], pa.binary()) for x in (t.column(0).to_numpy(), own)]
            return pa.RecordBatch.from_arrays([pa.array([made]), *packed, pa.array([own.shape[1]])], ["block", "ids", "vectors", "width"])

        for batch in batches:
            while batch.num_rows:
                take = min(batch.num_rows, BLOCK_ROWS - sum(b.num_rows for b in held))
                held.append(batch.slice(0, take))
                batch = batch.slice(take)
                if sum(b.num_rows for b in held) == BLOCK_ROWS:
                    yield done()
                    held, made = [], made + 1
        if held:
            yield done()

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(run, "block long, ids binary, vectors binary, width long")


def search(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score, depth): the k largest integer inner products of each query.

    Both tables are (vec_id, v array<long>). A candidate with the query's vec_id is its own and
    left out; ties go to the smaller vec_id; dimensions that a vector lacks count as zero; repeated
    query rows count once, repeated candidate rows each. Empty tables give no rows. `depth` is the
    share of its lists that was read in the block where the candidate stands. The queries are a table
    of blocks too; every block of candidates is sent to each of them, dealt over as many tasks as the
    session has cores, and nothing but the number of queries comes to the driver.
    """
    spark = candidates.sparkSession
    tune(spark)
    each = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "v").distinct()
    blocks, salts = int(each.count() // QUERY_ROWS) + 1, max(1, spark.sparkContext.defaultParallelism)
    asked = each.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("asked")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("queries"))
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    sent = _blocks(candidates).withColumns({"asked": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))), "salt": F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids, own = (np.frombuffer(row.column(c)[0].as_py(), np.int64) for c in ("ids", "vectors"))
                own = own.reshape(len(ids), row.column("width")[0].as_py())
                asking = row.column("queries").flatten()
                owners, weights = asking.field("vec_id").to_numpy(), _matrix(asking.field("v"))
                q = np.zeros((len(owners), own.shape[1]), np.int64)
                q[:, : weights.shape[1]] = weights[:, : own.shape[1]]
                where, best, score, depth = Lists(ids, own).top(q, owners, k)
                yield pa.RecordBatch.from_arrays([pa.array(owners[where]), pa.array(best), pa.array(score), pa.array(depth)], ["query_id", "vec_id", "score", "depth"])

    met = sent.join(asked, ["asked", "salt"]).select("ids", "vectors", "width", "queries")
    found = met.mapInArrow(run, "query_id long, vec_id long, score long, depth double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "depth")


def op6(spark, sf_dir: str) -> DataFrame:
    """The five best of every query."""
    vectors = quantized(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5).drop("depth")


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
