import random
import re

import xxhash

from tests.llm.edge import edge_documents, empty_documents
from tesserql.llm import simhash
from tesserql.llm.components import components


def slow_fingerprint(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [words[i : i + 3] for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(values):
    """Smallest member of each value's component under 2 differing bits."""
    up = {v: v for v in values}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    ordered = sorted(up)
    for i, x in enumerate(ordered):
        for y in ordered[:i]:
            if ((x ^ y) & (2**64 - 1)).bit_count() <= 2:
                x0, y0 = root(x), root(y)
                up[max(x0, y0)] = min(x0, y0)
    return {v: root(v) for v in values}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_matches_brute_force():
    rng = random.Random(1)
    texts = ["", None, "One", "a b", "a b c", "É A a A a", "x\x85y z\x0bw", " lead  and trail "]
    texts += [" ".join(rng.choice("ab Cd é".split()) for _ in range(rng.randrange(40))) for _ in range(200)]
    for t in texts:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_links_in_dense_and_sparse_cells(spark):
    rng = random.Random(2)
    base, values = rng.getrandbits(64), []
    for _ in range(400):
        x = base
        for _ in range(rng.randrange(0, 5)):
            x ^= 1 << rng.randrange(64)
        values.append(x)
    values += [rng.getrandbits(64) for _ in range(300)]
    values += [x ^ (1 << rng.randrange(64)) for x in values[-50:]]
    values += [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in values[400:460]]
    values = sorted(set(map(signed, values)))
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {r.node: r.component for r in components(simhash.fingerprint_links(frame)).collect()}
    assert {v: found.get(v, v) for v in values} == slow_classes(values)


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 500), (501, None), (502, 503), (503, 502)]
    frame = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.component for r in components(frame).collect()}
    assert found == {i: 0 for i in range(201)} | {502: 502, 503: 502}


def test_edge_cases(spark):
    rows = simhash.near_duplicate_classes(edge_documents(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert len(rows) == 11 and len(by[5]) == 2
    assert by[2] == by[3] == by[4] == [("0" * 16, 2)]
    assert by[1][0][1] == by[5][0][1] == 1
    assert by[None][0][1] is None
    assert simhash.near_duplicate_classes(empty_documents(spark)).collect() == []


def broadcast_generates(df):
    """Nodes of the plan that make rows below a broadcast."""
    out, inside = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-*()0123456789"))
        inside = [x for x in inside if x < at]
        if "BroadcastExchange" in line:
            inside.append(at)
        elif inside and re.search("Generate|MapInArrow", line):
            out.append(line.strip())
    return out


def test_cells_are_not_broadcast(spark):
    """Entered points are 33 times what the optimiser takes them for."""
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(300)]
    near = [x ^ 1 for x in values[:40]] + [x ^ 6 for x in values[40:60]]
    dense = [1 << a | 1 << b for a in range(4) for b in range(4, 64)]
    for some in ([*values, *near], [*values, *near, *dense]):
        fps = spark.createDataFrame([(signed(x),) for x in some], "fp long")
        links = simhash.fingerprint_links(fps)
        assert "Generate" in links._jdf.queryExecution().executedPlan().toString()
        assert not broadcast_generates(links)
        found = {r.node: r.component for r in components(links).collect()}
        groups = {}
        for v, c in slow_classes(some).items():
            groups.setdefault(c, set()).add(signed(v))
        assert {frozenset(g) for g in groups.values() if len(g) > 1} == {
            frozenset(n for n in found if found[n] == c) for c in set(found.values())
        }
