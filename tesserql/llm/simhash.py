"""Near-duplicate classes by SimHash fingerprints.

Fingerprint: the text's letters A-Z are lower-cased, its words
``[^\\x20\\x09-\\x0D]+`` make shingles of ``width`` consecutive words (repeats
included, joined by one space; fewer words make one shingle of all of them),
each shingle is hashed by XXH64 with seed 42, and a bit is set if it is set in
more than half of the hashes.  No words: fingerprint zero.

Linking: the fingerprint's bits fall into ``SEGMENTS`` equal segments; the
vector of their bit counts is a point whose Manhattan distance to another
fingerprint's point is never above the Hamming distance.  Points within
distance 2 meet in a grid: every point is entered at its own cell and at the
cells one step away along one axis, so two such points share a cell, and a
rule on the two steps names one cell at which the pair counts.  Pairs that
meet are verified exactly on their fingerprints.

Dense cells: where more than ``DENSE`` different fingerprints have one point,
pairs would grow with the square of their number.  Those fingerprints, and
whatever shares a grid cell with them, are entered in the finest grid instead,
whose segments are single bits.  There Manhattan distance is Hamming distance,
a cell has at most 65 members, and members of a cell need only be linked to the
cell's smallest.

Documents with equal fingerprints are one node.  Null and empty texts have
fingerprint zero and are linked like any other; null ids form rows of their
own with a null component unless their fingerprint has another id; repeated
rows return as often as they came; an empty table gives an empty result; other
columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserql.llm.common import checkpointed, map_arrow, shuffled
from tesserql.llm.components import components

SEED = 42
SEGMENTS = 16
#: More different fingerprints than this at one point make it dense.
DENSE = 16

_LOWER = {c: c + 32 for c in range(65, 91)}
#: Bytes that part words: space and 0x09 to 0x0D; bytes.split() knows the same.
_WORD_BREAKS = bytes([32, *range(9, 14)])


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of one text, as an unsigned 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hashed, n = xxhash.xxh64_intdigest, len(words)
    if n <= width:
        return hashed(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[: n - width] + 1]).tolist()
    stops = ends[width - 1 :].tolist()
    hashes = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, stops)], "<u8")
    return int(majority(hashes))


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in more than half of the hashes."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        block = hashes[at : at + (1 << 16)]
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(
    df: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, fp)``; fp holds the 64 bits in a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))],
                ["doc_id", "fp"],
            )

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, fp long")


def point(fp: Column, segments: int = SEGMENTS) -> Column:
    """Bit counts by segment, four bits for each segment in one long; one is
    added to every count, so that a step down never borrows."""
    width = 64 // segments
    mask = F.lit((1 << width) - 1)
    parts = [
        F.shiftleft(
            (F.bit_count(F.shiftrightunsigned(fp, width * k).bitwiseAND(mask)) + 1).cast("long"), 4 * k
        )
        for k in range(segments)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def _entered(points: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """Every point at its own cell (axis 0) and the cells one step away."""
    signed = [(s * (k + 1), s << (4 * k)) for k in range(segments) for s in (1, -1)]
    wrapped = [(k, (v + (1 << 63)) % (1 << 64) - (1 << 63)) for k, v in [(0, 0), *signed]]
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).cast("long").alias("v")) for k, v in wrapped])
    return points.select("fp", "dense", "pt", F.explode(steps).alias("s")).select(
        "fp", "dense", F.col("s.k").alias("axis"), F.expr("pt + s.v").alias("cell")
    )


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links ``(a, b)`` whose components are those of "2 or fewer bits differ"
    among the different values of ``fps.fp``."""
    own = fps.select("fp").where("fp is not null").distinct().withColumn("pt", point(F.col("fp")))
    loads = own.groupBy("pt").count()
    dense = checkpointed(loads.where(F.col("count") > DENSE).select("pt", F.lit(True).alias("dense")))
    points = checkpointed(
        own.join(dense, "pt", "left").withColumn("dense", F.coalesce("dense", F.lit(False)))
    )
    cells = _entered(points)
    left = cells.where("not dense").select("cell", F.col("fp").alias("a"), F.col("axis").alias("ka"))
    right = cells.where("not dense").select("cell", F.col("fp").alias("b"), F.col("axis").alias("kb"))
    ka, kb = F.col("ka"), F.col("kb")
    # one cell for each pair: equal points at their own; at distance 1 where b
    # stands; at distance 2 halfway, a having moved along the lower axis
    halfway = (ka != 0) & ((F.abs(ka) < F.abs(kb)) | (ka == -kb))
    pairs = (
        shuffled(left).join(shuffled(right), "cell")
        .where((F.col("a") < F.col("b")) & ((kb == 0) | halfway))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
        .select("a", "b")
    )
    if dense.isEmpty():
        return pairs
    near_cells = cells.where("dense").select("cell").distinct()
    fine = (
        cells.where("not dense").join(shuffled(near_cells), "cell", "left_semi").select("fp")
        .union(points.where("dense").select("fp"))
        .distinct()
    )
    flips = [0, *((1 << k) if k < 63 else -(1 << 63) for k in range(64))]
    variants = fine.select("fp", F.explode(F.array(*[F.lit(v).cast("long") for v in flips])).alias("v")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("v")).alias("variant")
    )
    # a cell of the finest grid has at most 65 members
    members = variants.groupBy("variant").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    fine_links = members.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return pairs.union(fine_links)


def near_duplicate_classes(
    df: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row."""
    fps = checkpointed(fingerprints(df, width, id_col, text_col))
    classes = components(fingerprint_links(fps))
    # one row for each fingerprint with its smallest id, then for each class
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classed = nodes.join(classes, nodes.fp == classes.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("class")
    )
    named = classed.groupBy("class").agg(F.min("least").alias("component_id"))
    by_fp = classed.join(named, "class").select("fp", "component_id")
    return fps.join(by_fp, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
