import pytest

from tests.llm.edge import edge_documents, empty_documents
from tesserql.llm import sharding
from tesserql.llm.common import fresh_dir
from tesserql.llm.sharding import Conflict, ShardStore


def key(r):
    return repr(r)


def test_runs_are_of_one_tier_and_near_the_target():
    shards = [{"path": f"{k}", "bytes": b} for k, b in enumerate([10, 11, 12, 13, 900, 70, 80, 90, 3])]
    found = sharding.runs(shards, 1000)
    assert sorted(tuple(sorted(s["bytes"] for s in r)) for r in found) == [(10, 11, 12, 13), (70, 80, 90)]
    assert sharding.runs([{"path": "a", "bytes": 900}, {"path": "b", "bytes": 950}], 1000) == []
    halves = [{"path": f"{k}", "bytes": 400} for k in range(5)]
    assert [len(r) for r in sharding.runs(halves, 1000)] == [2, 2]


def test_append_compact_and_read_versions(spark):
    s = ShardStore(spark, fresh_dir(spark, "store"))
    docs = edge_documents(spark)
    assert s.append(docs) == 1
    assert s.append(docs.limit(3)) == 2
    assert s.append(empty_documents(spark)) == 3
    before = sorted(s.read().collect(), key=key)
    assert before == sorted([*docs.collect(), *docs.limit(3).collect()], key=key)
    small = len(s.manifest()["shards"])
    assert s.compact() and len(s.manifest()["shards"]) < small
    assert sorted(s.read().collect(), key=key) == before
    assert sorted(s.read(1).collect(), key=key) == sorted(docs.collect(), key=key)
    assert s.compact() == []
    assert s.vacuum() > 0 and sorted(s.read().collect(), key=key) == before


def test_second_writer_of_a_version_conflicts(spark):
    s = ShardStore(spark, fresh_dir(spark, "store"))
    s.append(edge_documents(spark))
    with pytest.raises(Conflict):
        s.commit({"version": 1, "schema": None, "shards": []})
    with pytest.raises(Conflict):
        s._change({"data/nothing"}, [])
    assert s.versions() == [1]
    with pytest.raises(ValueError):
        s.append(spark.range(3))


def test_empty_store(spark):
    s = ShardStore(spark, fresh_dir(spark, "store"))
    with pytest.raises(ValueError):
        s.read()
    s.append(empty_documents(spark))
    assert s.read().collect() == [] and s.compact() == []
