"""Near-duplicate removal at a stated similarity of shingle sets, exactly.

Copies at a Jaccard similarity of 0.8 differ in far more bits of a SimHash
fingerprint than a range join can follow.  So links come from two places, both
verified on full sets of ``WIDTH``-word shingles: the range join on segment
popcounts of :mod:`tesserql.llm.simhash` over whole fingerprints, and a
prefix-filter join that leaves out no pair of that similarity:

1. Texts with equal words are one node, so copies in any number are one node.
2. In one order of all shingles (that of their hashes), a node's first fifth
   and ``EXTRA`` more must share a stated number of shingles with other nodes,
   or else nothing can be similar to it (:func:`partnered`).  This one pass over
   all texts leaves few nodes, and those are told by counts alone: no pairs.
3. The shingles of the nodes that are left are ordered rarest first, so that
   passages which many texts share come last, out of most prefixes
   (:func:`rare_prefixes`).  Each node is paired with one node of each of its
   prefix shingles (:func:`star_pairs`); verified links make classes.
4. Pairs with a common prefix shingle and in different classes so far are
   verified as well (:func:`cross_pairs`).  Nothing is capped.

Null and empty texts have no shingles and are copies of each other.  Rows are
told apart by file and position, not by id, so null and repeated ids do no
harm; the row with the smallest id (then the first place) of a group stays,
ids before nulls.  Very long texts are one row of an Arrow batch, hashes take
eight bytes a word.  All columns of the input are returned unchanged, whatever
their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from tesserql.llm.common import checkpointed, map_arrow, remove, shuffled, sized, written
from tesserql.llm.components import components
from tesserql.llm.simhash import fingerprint_links, majority

WIDTH = 5
SIMILARITY = 0.8
#: Share of a text's shingles that its prefix holds beyond the one fifth (at a
#: similarity of 0.8) of which one has to be shared; as many more have to be.
EXTRA = 0.1
#: Products of doubles may be a hair's breadth too large.
HAIR = 1e-6


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Different hashes of a text's word shingles, ascending; letters A-Z count
    as lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    if n <= width:
        return np.array([xxhash.xxh3_64_intdigest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[: n - width] + 1]).tolist()
    stops = ends[width - 1 :].tolist()
    hashed = xxhash.xxh3_64_intdigest
    return np.unique(np.array([hashed(joined[a:b]) for a, b in zip(starts, stops)], np.uint64))


def prefix_length(n: int, least: float = SIMILARITY, extra: float = EXTRA) -> int:
    return min(n, n - math.ceil(n * least - HAIR) + 1 + math.ceil(n * extra - HAIR))


def shared_at_least(n: Column, least: float = SIMILARITY, extra: float = EXTRA) -> Column:
    """How many shingles of its prefix a text of n shares with any similar one.

    Let x be the one of a similar pair whose prefix ends first.  Of its n_x
    shingles at most n_x - ceil(least n_x) are missing in the other, so all but
    as many of its prefix are shared, and in the other's prefix too: 1 + extra
    n_x, or ceil(least n_x) if its prefix is the whole text.  And n_x is at
    least ceil(least n).
    """
    smallest = F.ceil(n * least - HAIR)
    return F.least(1 + F.ceil(smallest * extra - HAIR), smallest)


def signatures(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``(…, copy binary, fp long, n int, prefix array<long>)`` for the columns
    of ``rows``, the last of which is the text; n counts shingles."""
    names = rows.columns[:-1]
    schema = StructType(
        [
            *[rows.schema[c] for c in names],
            StructField("copy", BinaryType()),
            StructField("fp", LongType()),
            StructField("n", IntegerType()),
            StructField("prefix", ArrayType(LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, fps, sizes, prefixes, ends = [], [], [], [], [0]
            for t in batch.column(batch.num_columns - 1):
                text = t.as_py() or ""
                copies.append(xxhash.xxh3_128_digest(b" ".join(text.encode("utf-8", "surrogatepass").lower().split())))
                hashes = shingle_hashes(text)
                fps.append(majority(hashes) if len(hashes) else 0)
                sizes.append(len(hashes))
                prefixes.append(hashes[: prefix_length(len(hashes), least)].view(np.int64))
                ends.append(ends[-1] + len(prefixes[-1]))
            flat = pa.array(np.concatenate(prefixes) if prefixes else np.empty(0, np.int64))
            made = [
                pa.array(copies, pa.binary()),
                pa.array(np.array(fps, np.uint64).view(np.int64)),
                pa.array(sizes, pa.int32()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*names, "copy", "fp", "n", "prefix"])

    return map_arrow(rows, run, schema)


def partnered(nodes: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``(node)`` of ``(node, n, prefix)`` that shares enough of its prefix with
    other nodes to be similar to one; all others are similar to none."""
    rows = nodes.select("node", "n", F.explode("prefix").alias("h"))
    shared = checkpointed(rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1").select("h"))
    held = rows.join(shared, "h").groupBy("node", "n").agg(F.count("*").alias("c"))
    return held.where(F.col("c") >= shared_at_least(F.col("n"), least)).select("node")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs ``(a, b)`` whose sets ``(key, hashes)`` are that similar."""
    left = sets.select(F.col("key").alias("b"), F.col("hashes").alias("hb"))
    right = sets.select(F.col("key").alias("a"), F.col("hashes").alias("ha"))
    joined = pairs.join(left, "b").join(right, "a").select("a", "b", "ha", "hb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= least * (len(p) + len(q) - both) and both > 0)
            chosen = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1)], ["a", "b"])

    return map_arrow(joined, run, "a long, b long")


def hash_sets(texts: DataFrame) -> DataFrame:
    """``(key, hashes binary)`` of ``(key, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["key", "hashes"])

    return map_arrow(texts, run, "key long, hashes binary")


def shingle_rows(sets: DataFrame) -> DataFrame:
    """``(key, n, h)``: each shingle of the sets ``(key, hashes)``, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(1)]
            n = np.array([len(x) for x in held], np.int64)
            key = np.repeat(batch.column(0).to_numpy(), n)
            h = np.concatenate(held) if held else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, np.repeat(n, n), h)], ["key", "n", "h"])

    return map_arrow(sets, run, "key long, n long, h long")


def rare_prefixes(sets: DataFrame, least: float) -> DataFrame:
    """``(key, n, own, h, at, short)``: the shared shingles among the first ones
    of each set, in an order of all shingles, rarest first; own is the share of
    its shingles that no other set has.

    Two sets of n >= m shingles that share at least o have their first common
    one among the first n - o + 1 and m - o + 1; o is at least ``least`` n, and
    2 ``least`` / (1 + ``least``) m, within which a row is ``short``.
    """
    rows = shingle_rows(sets)
    counts = checkpointed(rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"))
    # counted from the end, as the shingles that no other set has come first
    back = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("df"), F.desc("h")))
    own = 1 - F.count("*").over(Window.partitionBy("key")) / F.col("n")
    longer, shorter = (F.col("n") - F.ceil(F.col("n") * part - HAIR) for part in (least, 2 * least / (1 + least)))
    placed = shuffled(rows).join(counts, "h").withColumn("at", F.col("n") - back).withColumn("own", own)
    return placed.where(F.col("at") <= longer).select("key", "n", "own", "h", "at", (F.col("at") <= shorter).alias("short"))


def star_pairs(prefixes: DataFrame, least: float) -> DataFrame:
    """Pairs ``(a, b)`` of each set and, for each of its prefix shingles, the
    set with it that has the least of its own, as far as their sizes allow.

    In a group of edited copies that set is the least edited one, to which the
    others are more similar than to each other.
    """
    firsts = prefixes.groupBy("h").agg(F.min(F.struct("own", "key", "n")).alias("first"), F.count("*").alias("g")).where("g > 1")
    both = prefixes.join(firsts.select("h", F.col("first.key").alias("b"), F.col("first.n").alias("m")), "h")
    return both.where((F.col("key") != F.col("b")) & (F.least("n", "m") >= F.greatest("n", "m") * least - HAIR)).select(
        F.col("key").alias("a"), "b"
    ).distinct()


def cross_pairs(prefixes: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs ``(a, b)`` of sets in different classes with a common prefix
    shingle, as far as their sizes and its places allow similarity."""
    first = checkpointed(
        prefixes.join(classes, prefixes.key == classes.node, "left")
        .select("key", "n", "h", "at", "short", F.coalesce("component", "key").alias("class"))
    )
    mixed = first.groupBy("h").agg(F.min("class").alias("l"), F.max("class").alias("m")).where("l < m").select("h")
    first = first.join(mixed, "h", "left_semi")
    x, y = first.alias("x"), first.where("short").alias("y")
    on = (
        (F.col("x.h") == F.col("y.h"))
        & (F.struct("x.n", "x.key") > F.struct("y.n", "y.key"))
        & (F.col("x.class") != F.col("y.class"))
        # what is left from the first common one on has to suffice
        & (F.least(F.expr("x.n - x.at"), F.expr("y.n - y.at")) * (1 + least) >= F.expr("x.n + y.n") * least - HAIR)
    )
    return x.join(y, on).select(F.greatest("x.key", "y.key").alias("a"), F.least("x.key", "y.key").alias("b")).distinct()


def rare_pairs(sets: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs ``(a, b)`` of the sets in different classes, among them all that
    are so similar."""
    return cross_pairs(checkpointed(rare_prefixes(sets, least)), classes, least)


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``(node, fp)`` with equal whole fingerprints (with
    the smallest node only) or, from the range join, 2 or fewer differing bits."""
    fps = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(fps, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = (
        fingerprint_links(fps.select("fp"))
        .join(fps.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a")
        .join(fps.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
        .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    )
    return same.union(near)


def grouped(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``(…, node, group)`` for the columns of ``rows``, which name a row, but
    the last, its text; node numbers the rows, and rows of one group are copies
    or linked by that similarity."""
    spark, by = rows.sparkSession, rows.columns[:-1]
    signed, signed_at = written(signatures(rows, least).withColumn("node", F.monotonically_increasing_id()))
    nodes, nodes_at = written(
        signed.groupBy("copy").agg(F.min_by(F.struct("node", "fp", "n", "prefix"), "node").alias("x")).select("x.*").where("n > 0")
    )
    named = checkpointed(signed.select(*by, "node", "copy"))
    remove(spark, signed_at)
    near = checkpointed(fingerprint_pairs(nodes.select("node", "fp")))
    left = checkpointed(partnered(nodes, least))
    remove(spark, nodes_at)
    wanted = checkpointed(named.join(sized(left), "node", "left_semi").select(*by, "node"))
    sets = checkpointed(hash_sets(sized(wanted).join(rows, by).select("node", rows.columns[-1])))
    prefixes = checkpointed(rare_prefixes(sets, least))
    links = checkpointed(similar(star_pairs(prefixes, least).union(near).distinct(), sets, least))
    links = checkpointed(links.union(similar(cross_pairs(prefixes, components(links), least), sets, least)))
    classes = components(links)
    copies = named.groupBy("copy").agg(F.min("node").alias("first"))
    of_copy = copies.join(classes, F.col("first") == F.col("node"), "left").select(
        "copy", F.coalesce("component", "first").alias("group")
    )
    return shuffled(named).join(of_copy, "copy").select(*by, "node", "group")


def near_duplicates(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``(key, group)`` of every row of ``(key, text)`` with different keys
    that are not null; rows of one group are copies or linked by that similarity."""
    return grouped(rows.select("key", "text"), least).select("key", "group")


def places(docs: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """``docs``, and ``docs`` with each row's file and position under two new
    names; ``docs`` is written to the shared folder unless it is a table of
    files that tell them."""
    for _ in range(2):
        if "Relation" in docs._jdf.queryExecution().analyzed().nodeName():
            meta = docs.metadataColumn("_metadata")
            try:
                return docs, docs.select("*", meta["file_path"].alias(names[0]), meta["row_index"].alias(names[1]))
            except AnalysisException:  # files of a kind without positions
                pass
        docs = checkpointed(docs)
    raise RuntimeError("no positions in a table just written")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, all columns kept.

    ``docs`` is read from files, or else written to the shared folder first: a
    row's place in its file is its identity, which a repeated task does not
    change.
    """
    if not isinstance(docs.schema[id_col].dataType, LongType):
        raise TypeError(f"{id_col} is to be a long")
    place = [f"{name}_{uuid.uuid4().hex}" for name in ("file", "at")]
    docs, placed = places(docs, place)
    rows = placed.select(*[F.col(c).alias(n) for c, n in zip(place, ("file", "at"))], F.col(f"`{text_col}`").alias("text"))
    ids = placed.select(*[F.col(c).alias(n) for c, n in zip(place, ("file", "at"))], F.col(f"`{id_col}`").alias("id"))
    named = checkpointed(grouped(rows, least).join(ids, ["file", "at"]))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("f")
    stay = named.groupBy("group").agg(first).select(F.col("f.node").alias("node"))
    gone = named.join(shuffled(stay), "node", "left_anti").select(*[F.col(n).alias(c) for c, n in zip(place, ("file", "at"))])
    return placed.join(sized(checkpointed(gone)), place, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
