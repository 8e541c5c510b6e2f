"""Exact top-k inner products by the threshold algorithm.

Vectors are cut into blocks of bounded size.  A block of candidates holds, for
each dimension, its rows sorted by that component.  A query walks down all
lists of components that are not zero at once, from the end that its own
component favours; rows met for the first time are scored in full, and the walk
stops when the sum of the best that each list can still give is below the k-th
best score found, with a tie still open.  Each query walks by itself, down the
lists that lower that sum most, ``STEP`` times as deep with each step on a list.

How much a walk saves depends on the vectors: where few components make up most
of a score it ends early; of many components alike, as in random vectors of 64
dimensions, nearly all rows are met before the bound falls below the k-th score.

Query blocks are sent to every candidate block (a stated set of queries against
all rows), as broadcasts of at most ``SENT_BYTES`` (or one block) at a time;
what a broadcast finds is written to the shared folder before the next.  A pair
of blocks gives k rows for each query, which are reduced by partial aggregation,
so what is shuffled after scoring is bounded by a broadcast's queries times
blocks times k.

Vectors that are null, or hold a null or a component that is not finite, take
no part; so do rows with a null id.  Only vectors of the same length meet.
Repeated rows are candidates of their own; a query leaves out all rows with its
own id.  Scores beyond 64 bits are an error.  Ties go to the smaller id.  Empty vectors score zero.  An empty table
gives an empty result, and other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserql.llm.common import checkpointed, map_arrow, written

#: Most rows of a candidate block, fewest of one, and most of a query block.
CANDIDATES = 32768
LEAST = 1024
QUERIES = 1024
#: Most bytes of query blocks that are broadcast at once.
SENT_BYTES = 16 << 20
#: First depth of the walk, in rows of each list, and the factor of the next.
DEPTH = 16
STEP = 4


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def blocks(df: DataFrame, size: int) -> DataFrame:
    """Rows ``(id, v array<double>)`` as blocks ``(block, dim, n, ids, values)``
    of bounded size: a key, and int64 ids and float64 rows as bytes.

    Blocks are cut within partitions, so nothing is shuffled.
    """
    schema = pa.schema(
        [("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("values", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def cut(dim: int, least: int) -> Iterator[pa.RecordBatch]:
            nonlocal key
            ids = np.concatenate([i for i, _ in held[dim]])
            rows = np.concatenate([r for _, r in held[dim]])
            at = 0
            while len(ids) - at >= least:
                i, r = ids[at : at + size], rows[at : at + size]
                block = {"block": [key], "dim": [dim], "n": [len(i)], "ids": [i.tobytes()], "values": [r.tobytes()]}
                yield pa.RecordBatch.from_pydict(block, schema=schema)
                key += 1
                at += len(i)
            held[dim] = [(ids[at:], rows[at:])]

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)
            lengths = np.diff(ends)
            for dim in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dim)
                rows = values[ends[own][:, None] + np.arange(dim)] if dim else np.zeros((len(own), 0))
                held.setdefault(dim, []).append((ids[own].astype(np.int64), np.ascontiguousarray(rows, np.float64)))
                if sum(len(i) for i, _ in held[dim]) >= 2 * size:
                    yield from cut(dim, size)
        for dim in list(held):
            yield from cut(dim, 1)

    return map_arrow(df, run, "block long, dim int, n int, ids binary, values binary")


class Lists:
    """A block of candidates with its sorted lists."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")  # ties: smaller ids come first
        self.ids, self.rows = ids[order], rows[order]
        # each list in one piece of memory
        self.rising = np.asfortranarray(np.argsort(self.rows, axis=0, kind="stable"))
        self.sorted = np.take_along_axis(self.rows, self.rising, axis=0)
        self.largest = np.abs(self.rows).max(initial=0)

    def products(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact integer inner products, by floats where these are exact."""
        dim = max(1, rows.shape[1])
        largest = np.abs(queries).max(initial=0) * self.largest * dim
        if largest < 2.0**53:
            return (queries @ rows.T).astype(np.int64)
        if largest < 2.0**62:
            return queries.astype(np.int64) @ rows.astype(np.int64).T
        exact = [[sum(int(a) * int(b) for a, b in zip(q, r)) for r in rows] for q in queries]
        return np.array(exact, object).reshape(len(queries), len(rows))

    def walk(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best candidates' ids and scores, and how many were scored.

        The lists that a step goes down are those that lower the bound most, for
        as many rows; half as much as the first of them is enough.
        """
        n, lists = len(self.ids), np.flatnonzero(query)
        weights, falls = query[lists], query[lists] < 0
        depth = np.minimum(np.full(len(lists), DEPTH), n)
        last = np.zeros(len(lists), np.int64)
        met = self.ids == query_id  # never scored
        found, scores, kth = np.empty(0, np.int64), np.empty(0, np.int64), None
        while True:
            new = np.zeros(n, bool)
            for d in np.flatnonzero(depth > last):
                a, b = last[d], depth[d]
                new[self.rising[a:b, lists[d]] if falls[d] else self.rising[n - b : n - a, lists[d]]] = True
            new &= ~met
            met |= new
            rows = np.flatnonzero(new)
            if not len(lists) or met.all():  # all components are zero, or the last rows are met
                rows = np.flatnonzero(new | ~met)
                met[:] = True
            found = np.concatenate([found, rows])
            scores = np.concatenate([scores, self.products(query[None, :], self.rows[rows])[0]])
            if met.all():
                break
            edges = weights * self.sorted[np.where(falls, depth - 1, n - depth), lists]
            if len(scores) >= k:
                kth = np.sort(scores)[-k] if scores.dtype == object else np.partition(scores, len(scores) - k)[len(scores) - k]
                # sums of large numbers may be a hair's breadth off
                if edges.sum() + np.abs(edges).sum() * 1e-12 < kth:
                    break
            last, deeper = depth, np.minimum(n, depth * STEP)
            gain = (edges - weights * self.sorted[np.where(falls, deeper - 1, n - deeper), lists]) / np.maximum(deeper - depth, 1)
            gain[depth == n] = -1
            depth = np.where((gain >= gain.max() / 2) & (depth < n), deeper, depth)
        if len(found) > k:
            kth = np.sort(scores)[-k] if scores.dtype == object else np.partition(scores, len(scores) - k)[len(scores) - k]
        best = sorted(np.flatnonzero(scores >= kth) if len(found) > k else range(len(found)), key=lambda c: (-int(scores[c]), self.ids[found[c]]))[:k]
        return self.ids[found[best]], scores[best], len(found)

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query: its row, and the best candidates' ids and scores."""
        for i, (query_id, query) in enumerate(zip(query_ids, queries)):
            ids, scores, _ = self.walk(query_id, query, k)
            yield i, ids, scores


def unpacked(block: dict, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids, values = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["values"], np.float64)
    return ids, values.reshape(block["n"], dim)


def spans(asked: DataFrame) -> list[tuple[int, int]]:
    """First and last key of each run of query blocks that is broadcast at once."""
    out, held = [], 0
    for block, dim, n in sorted(map(tuple, asked.select("block", "dim", "n").collect())):
        size = 8 * n * (dim + 1)
        if not out or held + size > SENT_BYTES:
            out.append((block, block))
            held = 0
        out[-1] = (out[-1][0], block)
        held += size
    return out


def top_k(
    candidates: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float | None = None,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best candidates.

    With ``scale`` every component becomes ``floor(scale * x)`` first; without
    it components must be integers already.
    """
    spark = candidates.sparkSession

    def prepared(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        kept = df.where(F.col(id_col).isNotNull() & usable(v))
        values = F.transform(v, lambda x: F.floor(x * scale).cast("double")) if scale is not None else v
        return kept.select(F.col(id_col).cast("long").alias("id"), values.alias("v"))

    every = prepared(candidates)
    n = every.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    size = min(CANDIDATES, max(LEAST, -(-n // parts)))
    lists = checkpointed(blocks(every, size))
    asked = checkpointed(blocks(prepared(queries), QUERIES))
    kept = lists.select("dim", F.struct("n", "ids", "values", "block").alias("c"))
    sent = asked.select("dim", "block", F.struct("n", "ids", "values", "block").alias("q"))
    names = ["query_block", "query_row", "query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, Lists] | None = None
        for batch in batches:
            for at in range(batch.num_rows):
                dim, c, q = (column[at].as_py() for column in batch.columns)
                if last is None or last[0] != c["block"]:
                    last = (c["block"], Lists(*unpacked(c, dim)))
                query_ids, vectors = unpacked(q, dim)
                found: list[list[int]] = [[], [], [], [], []]
                for row, ids, scores in last[1].top(query_ids, vectors, k):
                    for i, s in zip(ids, scores):
                        if not -(1 << 63) <= s < 1 << 63:
                            raise OverflowError(f"the score of {i} for {query_ids[row]} does not fit a long")
                        s = int(s)
                        for column, value in zip(found, (q["block"], row, int(query_ids[row]), int(i), s)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names)

    def best(some: DataFrame) -> DataFrame:
        pairs = kept.join(F.broadcast(some.select("dim", "q")), "dim").select("dim", "c", "q")
        found = map_arrow(pairs, run, ", ".join(f"{x} long" for x in names))
        order = Window.partitionBy("query_block", "query_row").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "vec_id", "score")

    turns = spans(asked)
    if len(turns) < 2:
        return best(sent)
    each = [written(best(sent.where(F.col("block").between(*turn)))) for turn in turns]
    return spark.read.schema(each[0][0].schema).parquet(*[path for _, path in each])
