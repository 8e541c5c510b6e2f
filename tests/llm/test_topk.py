import math

import numpy as np
from pyspark.sql import functions as F

from tesserql.llm import topk

SCHEMA = "vec_id long, embedding array<float>, id long, v string, dim int, block string, query_id int"


def slow(rows, k=5):
    kept = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, q in kept:
        if i % 50 == 0:
            found = [(-sum(a * b for a, b in zip(q, c)), j) for j, c in kept if j != i and len(c) == len(q)]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def run(spark, rows):
    frame = spark.createDataFrame([(i, v, *[None] * 5) for i, v in rows], SCHEMA)
    found = topk.top_k(frame, frame.where(F.col("vec_id") % 50 == 0), scale=256.0)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect())


def test_all_rows_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(400)]
    rows += [(400 + i, rows[i % 7][1]) for i in range(200)]  # ties
    assert run(spark, rows) == slow(rows)


def scored_share(block, queries, k=5):
    """Share of the block that walks score; results are held against brute force."""
    lists, n = topk.Lists(np.arange(len(block)), block), 0
    for query in queries:
        ids, scores, met = lists.walk(-1, query, k)
        s = block @ query
        best = sorted(range(len(block)), key=lambda i: (-s[i], i))[:k]
        assert ids.tolist() == best and scores.tolist() == s[best].tolist()
        n += met
    return n / len(block) / len(queries)


def test_skewed_lists_stop_early():
    rng = np.random.default_rng(2)
    block = rng.integers(-3, 4, size=(3000, 4)).astype(float)
    block[:40] *= 100
    assert scored_share(block, rng.integers(-9, 10, size=(5, 4)).astype(float)) < 0.5


def test_64_dimensions_stop_at_the_bound():
    """Few large components among 64: the walk ends at the bound.  Components
    all alike: it meets nearly all rows first, and is right all the same."""
    rng = np.random.default_rng(3)
    alike = rng.integers(-256, 256, size=(4000, 64)).astype(float)
    falling = np.floor(alike * 2.0 ** -np.arange(64))
    share = scored_share(falling, falling[:20])
    print("share scored", share, scored_share(alike, alike[:20]))
    assert share < 0.25


def test_zero_queries_and_rows_of_the_query():
    lists = topk.Lists(np.array([3, 1, 2, 1]), np.array([[1.0, 0], [0, 0], [-1, 5], [0, 1]]))
    ids, scores, _ = lists.walk(1, np.array([0.0, 0.0]), 5)
    assert (ids.tolist(), scores.tolist()) == ([2, 3], [0, 0])
    ids, scores, _ = lists.walk(9, np.array([-2.0, 1.0]), 2)
    assert (ids.tolist(), scores.tolist()) == ([2, 1], [7, 1])


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 0.0]),
            (None, [1.0, 1.0]), (5, [-1.0, 0.5]), (6, [1.0]), (100, []), (7, []), (150, [3.0, 3.0, 3.0])]
    assert run(spark, rows) == slow(rows)
    assert run(spark, []) == []


def test_large_components_are_exact():
    lists = topk.Lists(np.array([1, 2]), np.array([[2.0**40, 1.0], [2.0**40, 2.0]]))
    assert lists.products(np.array([[2.0**30, 1.0]]), lists.rows).tolist() == [[2**70 + 1, 2**70 + 2]]
    assert lists.products(np.array([[2.0**15, 1.0]]), lists.rows).tolist() == [[2**55 + 1, 2**55 + 2]]


def test_queries_are_broadcast_in_bounded_turns(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4 + i % 2).tolist()) for i in range(600)]
    monkeypatch.setattr(topk, "SENT_BYTES", 100)
    monkeypatch.setattr(topk, "QUERIES", 2)
    broadcast = []
    plain = F.broadcast
    monkeypatch.setattr(topk.F, "broadcast", lambda df: broadcast.append(df.count()) or plain(df))
    assert run(spark, rows) == slow(rows)
    assert len(broadcast) > 1 and max(broadcast) == 1  # no query block is repeated for groups of candidates
