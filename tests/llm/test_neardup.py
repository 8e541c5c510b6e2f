import random

from tests.llm.edge import SCHEMA, edge_documents, empty_documents
from tesserql.llm import neardup


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def test_groups_match_brute_force(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(30):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.randint(30, 300))]
        texts += [" ".join(edited(rng, base, rng.randint(0, max(1, len(base) // 60)))) for _ in range(rng.randint(1, 4))]
    base = [f"h{rng.randrange(5000)}" for _ in range(200)]
    texts += [" ".join(edited(rng, base, rng.randint(1, 2))) for _ in range(60)]  # a large group
    texts += [texts[0]] * 20
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    groups = {}
    for r in neardup.near_duplicates(rows).collect():
        groups.setdefault(r.group, set()).add(r.key)
    slow = {}
    for i in range(len(texts)):
        slow.setdefault(root(i), set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, slow.values()))


def test_members_of_large_groups_that_miss_the_first(spark):
    """Two clusters share part fingerprints with a first node unlike both."""
    rng = random.Random(4)
    shared = [f"s{k}" for k in range(60)]
    first = " ".join([*shared, *[f"f{k}" for k in range(200)]])
    one, two = ([f"{c}{k}" for k in range(70)] for c in "xy")
    texts = [first]
    for base in (one, two):
        texts += [" ".join([*shared, *edited(rng, base, 1)]) for _ in range(8)]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    groups = {}
    for r in neardup.near_duplicates(rows).collect():
        groups.setdefault(r.group, set()).add(r.key)
    assert sorted(map(sorted, groups.values())) == [[0], list(range(1, 9)), list(range(9, 17))]


def test_one_row_of_each_group_stays(spark):
    docs = edge_documents(spark)
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [
        (False, 1), (False, 2), (False, 7), (False, 8), (False, 9), (False, 10), (True, 0)
    ]
    assert neardup.keep_first(empty_documents(spark)).collect() == []
    twice = spark.createDataFrame([(None, "a b c d e f g", "en", "s", 1, *[None] * 7)] * 3, SCHEMA)
    assert neardup.keep_first(twice).count() == 1


def pairs_below_boilerplate(n):
    """``n`` pairs of similar texts; all texts share most of their words, which
    alone makes none similar."""
    shared = [f"s{k}" for k in range(204)]
    return [" ".join([*shared, *[f"p{i}.{k}" for k in range(16)], *[f"o{i}.{side}.{k}" for k in range(22)]]) for i in range(n) for side in "ab"]


def pairs_of(spark, texts):
    groups = {}
    for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "key long, text string")).collect():
        groups.setdefault(r.group, set()).add(r.key)
    return sorted(map(sorted, groups.values()))


def test_pairs_without_a_link_meet_in_later_turns(spark):
    assert pairs_of(spark, pairs_below_boilerplate(40)) == [[2 * i, 2 * i + 1] for i in range(40)]


def test_pairs_in_large_groups_are_complete(spark):
    assert pairs_of(spark, pairs_below_boilerplate(1000)) == [[2 * i, 2 * i + 1] for i in range(1000)]


def test_rare_pairs_hold_all_similar_pairs(spark):
    rng = random.Random(7)
    sets = [set(rng.sample(range(40), rng.randint(1, 30))) for _ in range(60)]
    sets += [s ^ set(rng.sample(range(40), rng.randint(0, 3))) or {1} for s in sets for _ in range(3)]
    rows = [(i, neardup.np.array(sorted(s), neardup.np.uint64).tobytes()) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "key long, hashes binary")
    for least in (0.5, 0.8, 0.9):
        near = {(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}
        none = spark.createDataFrame([], "node long, component long")
        found = {tuple(r) for r in neardup.rare_pairs(frame, none, least).collect()}
        assert near <= found
        one = spark.createDataFrame([(i, 0) for i in range(0, len(sets), 2)], "node long, component long")
        apart = {(a, b) for a, b in near if a % 2 or b % 2}
        assert apart <= {tuple(r) for r in neardup.rare_pairs(frame, one, least).collect()}


def test_pairs_of_short_texts_are_complete(spark):
    whole = [[f"t{i}.{k}" for k in range(9)] for i in range(400)]  # 5 shingles, and 4 of them
    texts = [" ".join(t) for words in whole for t in (words, words[:-1])]
    assert pairs_of(spark, texts) == [[2 * i, 2 * i + 1] for i in range(400)]


def test_no_similar_pair_is_ruled_out_by_its_prefix(spark):
    """All pairs of sizes up to 60 at the threshold keep both nodes."""
    rng = random.Random(3)
    rows, pairs = [], []
    for n in range(1, 61):
        for m in range(-(-4 * n // 5), n + 1):
            same = -(-4 * (n + m) // 9)  # fewest that make 0.8
            x = [rng.getrandbits(64) for _ in range(n)]
            y = x[:same] + [rng.getrandbits(64) for _ in range(m - same)]
            if same <= m:
                pairs.append((len(rows), len(rows) + 1))
                rows += [sorted(x), sorted(y)]
    frame = spark.createDataFrame(
        [(i, len(s), [h - (h >> 63 << 64) for h in s[: neardup.prefix_length(len(s))]]) for i, s in enumerate(rows)],
        "node long, n int, prefix array<long>",
    )
    left = {r.node for r in neardup.partnered(frame).collect()}
    assert {i for p in pairs for i in p} <= left


def test_texts_of_one_repeated_word_are_similar(spark):
    assert pairs_of(spark, ["a " * 8, "a " * 9, "a " * 4, "b " * 9]) == [[0, 1], [2], [3]]


def test_columns_of_any_name_return_unchanged(spark, tmp_path):
    names = ["_place", "_file", "_at", "file", "at", "node", "group", "key", "copy", "h", "n", "_metadata"]
    rows = [(i, f"one two three four five {i // 2}", *[f"{c}{i}" for c in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    docs.write.parquet(f"file://{tmp_path}/docs")
    for table in (docs, spark.read.parquet(f"file://{tmp_path}/docs")):
        kept = neardup.keep_first(table)
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect())) == rows[::2]
    # rows of one file read twice are rows of their own
    twice = spark.read.parquet(f"file://{tmp_path}/docs").withColumn("doc_id", neardup.F.explode(neardup.F.array("doc_id", neardup.F.lit(9))))
    assert sorted(r.doc_id for r in neardup.keep_first(twice).collect()) == [0, 2, 4]


def test_tables_are_broadcast_by_their_rows(spark, monkeypatch):
    """Rows with one long path take next to nothing in a file, and shingles of
    sets more than their sets are taken for."""
    from tesserql.llm import common

    table = common.checkpointed(spark.range(4000).selectExpr("repeat('x', 400) AS file", "id AS at"))
    other = spark.range(5000).selectExpr("repeat('x', 400) AS file", "id AS at")
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1 << 20)
    plan = other.join(common.sized(table), ["file", "at"], "left_anti")
    assert "BroadcastHashJoin" not in plan._jdf.queryExecution().executedPlan().toString() and plan.count() == 1000
    monkeypatch.setattr(common, "BROADCAST_BYTES", 4 << 20)
    plan = other.join(common.sized(table), ["file", "at"], "left_anti")
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString() and plan.count() == 1000
    sets = common.checkpointed(neardup.hash_sets(spark.createDataFrame([(i, f"a b c d e f g {i % 9} {i}") for i in range(90)], "key long, text string")))
    assert "BroadcastHashJoin" not in neardup.rare_prefixes(sets, 0.8)._jdf.queryExecution().executedPlan().toString()


def test_copies_leave_without_any_broadcast(spark, tmp_path, monkeypatch):
    from tesserql.llm import common

    rng = random.Random(11)
    words = [[f"w{rng.randrange(500)}" for _ in range(40)] for _ in range(20)]
    rows = [(i, " ".join(words[i % 20] if i < 40 else edited(rng, words[i % 20], 1))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    with_broadcast = sorted(r.doc_id for r in neardup.keep_first(docs).collect())
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0, raising=False)
    kept = neardup.keep_first(docs)
    assert "BroadcastHashJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in kept.collect()) == with_broadcast and with_broadcast[:20] == list(range(20))
