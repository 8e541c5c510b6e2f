"""Best-fit packing of documents into bins, with conflicts.

Items are documents, or capacity-sized pieces and a rest of longer ones.  Two
items conflict if they have the same source or the same duplicate cluster; a bin
never holds conflicting items.  Items of a shard go in by falling size.  A
shard's bins stand ordered by residual room; a binary search finds the first
that has room, and its successors are tried until one has neither the item's
source bit nor its cluster bit set.  That is the tightest compatible bin; if
there is none, a bin is opened.

Shards are hashes of ids, as many as the number of items asks for, and each is
packed by itself; more than ``2 * SHARD`` items of one hash are cut into several
shards, so a task holds a bounded number of items.  Only ids, sizes, sources and
cluster hashes are shuffled.

Null sources and null clusters conflict with nothing.  Null sizes count as 0;
items of size 0 are packed like others.  Null ids and repeated rows are items of
their own.  An empty table gives an empty result; columns other than those named
are neither read nor returned.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserql.llm.common import map_arrow

#: Items that a shard has about.
SHARD = 4096


def bits_of(values: list) -> list[int]:
    """A bit for each value that occurs more than once; 0 conflicts with nothing."""
    seen: dict = {}
    for v in values:
        if v is not None:
            seen[v] = seen.get(v, 0) + 1
    shared = {v: 1 << k for k, v in enumerate(v for v, n in seen.items() if n > 1)}
    return [shared.get(v, 0) for v in values]


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """Bin of each item; items must come by falling size."""
    source_bits, cluster_bits = bits_of(sources), bits_of(clusters)
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    held_sources: list[int] = []
    held_clusters: list[int] = []
    out = []
    for size, s, c in zip(sizes, source_bits, cluster_bits):
        at = bisect.bisect_left(order, (size, -1))
        n = len(order)
        while at < n:
            b = order[at][1]
            if not (held_sources[b] & s or held_clusters[b] & c):
                break
            at += 1
        if at < n:
            residual, b = order.pop(at)
            held_sources[b] |= s
            held_clusters[b] |= c
        else:
            residual, b = capacity, len(held_sources)
            held_sources.append(s)
            held_clusters.append(c)
        bisect.insort(order, (residual - size, b))
        out.append(b)
    return out


def pieces(size: Column, capacity: int) -> Column:
    """``(piece, start, length)`` of a document: full ones, then the rest."""
    full = F.floor(size / F.lit(capacity)).cast("int")
    rest = size - full * capacity
    count = full + F.when((rest > 0) | (full == 0), 1).otherwise(0)
    return F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda k: F.struct(
            k.alias("piece"),
            (k.cast("long") * capacity).alias("start"),
            F.least(F.lit(capacity).cast("long"), size - k.cast("long") * capacity).alias("length"),
        ),
    )


def pack(
    df: DataFrame,
    capacity: int,
    size: Column,
    id_col: str = "doc_id",
    source: Column | None = None,
    cluster: Column | None = None,
) -> DataFrame:
    """``(doc_id, piece, start, length, bin_id)``; sizes, starts and lengths are
    in units of ``size``."""
    none = F.lit(None).cast("long")
    of_source = none if source is None else F.when(source.isNotNull(), F.xxhash64(source))
    of_cluster = none if cluster is None else F.when(cluster.isNotNull(), F.xxhash64(cluster))
    items = (
        df.select(
            F.col(id_col).alias("doc_id"),
            F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("size"),
            of_source.alias("source"),
            of_cluster.alias("cluster"),
        )
        .withColumn("p", F.explode(pieces(F.col("size"), capacity)))
        .select("doc_id", "source", "cluster", "p.piece", "p.start", "p.length", F.xxhash64("doc_id", "p.piece", "cluster").alias("h"))
    )
    total = df.select(F.greatest(F.lit(1), F.ceil(F.coalesce(size.cast("long"), F.lit(0)) / capacity)).alias("n")).agg(F.sum("n")).first()[0]
    shards = max(1, -(-(total or 0) // SHARD))
    tasks = min(shards, 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    sharded = (
        items.withColumn("shard", F.pmod("h", F.lit(shards)))
        .repartition(tasks, "shard")
        .sortWithinPartitions("shard", "h", "doc_id", "piece")
        .select("doc_id", "piece", "start", "length", "source", "cluster", "shard")
    )
    kind = sharded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard, cut, n = None, 0, 0

        def packed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            size, piece = rows.column("length").to_pylist(), rows.column("piece").to_pylist()
            by_size = sorted(range(len(size)), key=lambda i: -size[i])
            rows = rows.take(pa.array(by_size))
            bins = best_fit(
                [size[i] for i in by_size], rows.column("source").to_pylist(), rows.column("cluster").to_pylist(), capacity
            )
            assert len(piece) == len(bins)
            names = [f"{shard}-{cut}-{b}" for b in bins]
            return pa.RecordBatch.from_arrays(
                [*(rows.column(k).combine_chunks() for k in range(4)), pa.array(names, pa.string())],
                ["doc_id", "piece", "start", "length", "bin_id"],
            )

        for batch in batches:
            of = batch.column(6).to_pylist()
            at = 0
            while at < len(of):
                end = bisect.bisect_right(of, of[at])  # sorted by shard
                if held and (of[at] != shard or n >= 2 * SHARD):
                    yield packed()
                    cut = cut + 1 if of[at] == shard else 0
                    held, n = [], 0
                elif not held:
                    cut = 0
                shard = of[at]
                end = min(end, at + 2 * SHARD - n)
                held.append(batch.slice(at, end - at))
                n += end - at
                at = end
        if held:
            yield packed()

    return map_arrow(sharded, run, f"doc_id {kind}, piece int, start long, length long, bin_id string")
