import random

from pyspark.sql import functions as F

from tests.llm.edge import SCHEMA, edge_documents, empty_documents
from tesserql.llm import packing


def slow(sizes, sources, clusters, capacity):
    """Tightest compatible bin by looking at all bins."""
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters):
        fitting = [
            (room, k) for k, (room, ss, cs) in enumerate(bins)
            if room >= size and not (s is not None and s in ss) and not (c is not None and c in cs)
        ]
        if fitting:
            room, k = min(fitting)
        else:
            room, k = capacity, len(bins)
            bins.append((capacity, set(), set()))
        bins[k] = (room - size, bins[k][1] | {s}, bins[k][2] | {c})
        out.append(k)
    return out


def test_best_fit_matches_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(60)
        sizes = sorted((rng.randrange(101) for _ in range(n)), reverse=True)
        sources = [rng.choice([None, "hot", "hot", "a", "b", "c", "d"]) for _ in range(n)]
        clusters = [rng.choice([None, 1, 2, *range(3, 40)]) for _ in range(n)]
        assert packing.best_fit(sizes, sources, clusters, 100) == slow(sizes, sources, clusters, 100)


def check(rows, docs, capacity):
    """Every unit is packed once, no bin overflows or holds a conflict."""
    size = {d.doc_id: len((d.text or "").encode()) for d in docs}
    source = {d.doc_id: d.source for d in docs}
    bins, parts = {}, {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
        parts.setdefault(r.doc_id, []).append((r.start, r.length))
    for held in bins.values():
        assert sum(r.length for r in held) <= capacity
        own = [source[r.doc_id] for r in held if source[r.doc_id] is not None]
        assert len(own) == len(set(own))
    for d, spans in parts.items():
        assert sum(n for _, n in spans) == size[d] * len([x for x in docs if x.doc_id == d])
    assert set(parts) == set(size)


def packed(df, capacity=1000):
    return packing.pack(
        df, capacity, F.octet_length("text"), source=F.col("source"), cluster=F.md5("text")
    ).collect()


def test_many_shards_hold_together(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 50)
    rng = random.Random(2)
    rows = [(i, "x" * rng.choice([0, 3, 300, 999, 1000, 1001, 3500]), "en", rng.choice(["hot", "a", "b", None]), 1, *[None] * 7)
            for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    check(packed(df), df.collect(), 1000)
    # one id a thousand times: one hash, several shards
    same = spark.createDataFrame([(1, "y" * 10, "en", None, 1, *[None] * 7)] * 1000, SCHEMA)
    found = packing.pack(same, 1000, F.octet_length("text")).collect()
    assert len(found) == 1000 and sum(r.length for r in found) == 10_000
    assert max(sum(r.length for r in found if r.bin_id == b) for b in {r.bin_id for r in found}) <= 1000


def test_whole_result_matches_brute_force(spark, monkeypatch):
    """Shards, cuts and bins of a whole table, item by item."""
    monkeypatch.setattr(packing, "SHARD", 40)
    rng = random.Random(3)
    texts = ["x" * rng.choice([0, 3, 300, 999, 1000, 1001, 3500]) + rng.choice("abcdefgh") for _ in range(60)]
    rows = [(i, rng.choice([*texts, None]), "en", rng.choice(["hot", "hot", "a", "b", None]), 1, *[None] * 7) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    items = []
    for i, text, _, source, *_ in rows:
        size = len(text or "")
        for piece in range(max(1, -(-size // 1000))):
            items.append((i, piece, piece * 1000, min(1000, size - piece * 1000), source, text))
    total = sum(max(1, -(-len(r[1] or "") // 1000)) for r in rows)
    hashed = (
        spark.createDataFrame(items, "doc_id long, piece int, start long, length long, source string, text string")
        .select("*", F.when(F.col("text").isNotNull(), F.xxhash64(F.md5("text"))).alias("cluster"))
        .select("*", F.xxhash64("doc_id", "piece", "cluster").alias("h")).collect()
    )
    shards = {}
    for r in hashed:
        shards.setdefault(r.h % -(-total // 40), []).append(r)
    want = []
    for shard, held in shards.items():
        held.sort(key=lambda r: (r.h, r.doc_id, r.piece))
        for cut in range(0, len(held), 80):
            part = sorted(held[cut : cut + 80], key=lambda r: -r.length)
            bins = slow([r.length for r in part], [r.source for r in part], [r.text for r in part], 1000)
            want += [(r.doc_id, r.piece, r.start, r.length, f"{shard}-{cut // 80}-{b}") for r, b in zip(part, bins)]
    assert sorted(map(tuple, packed(df))) == sorted(want) and len(shards) > 3


def test_edge_cases(spark):
    df = edge_documents(spark)
    rows = packed(df)
    check(rows, df.collect(), 1000)
    assert {r.piece for r in rows if r.doc_id == 7} == set(range(30))
    assert packed(empty_documents(spark)) == []
