import corpus_pipeline
from tests.llm.edge import edge_documents, empty_documents
from tests.llm.test_neardup import shingles
from tesserql.llm import secrets
from tesserql.llm.queries import BIN_BYTES

SF = "/root/testdata/sf0.001"


def staged(spark, docs, tmp_path):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"file://{tmp_path}/{name}")
        out.append(spark.read.parquet(f"file://{tmp_path}/{name}"))
    return out


def test_stages_against_brute_force(spark, tmp_path):
    docs, known, single, clean, packed = staged(spark, spark.read.parquet(f"{SF}/documents.parquet"), tmp_path)
    for frame in (known, single, clean):
        assert frame.columns == docs.columns
    before = known.collect()
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in before} == {
        r.doc_id for r in docs.collect() if not any(c.isalpha() for c in r.text or "")
    }
    sets = {r.doc_id: shingles(r.text) for r in before}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    assert sorted(r.doc_id for r in single.collect()) == sorted({root(i) for i in ids})
    text = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        base = secrets.base_spans(text[r.doc_id], secrets.holds_name(text[r.doc_id]))
        assert r.n_chars == len(r.text)
        if not base and r.text != text[r.doc_id]:
            assert "[crf]" in r.text
        if base:
            assert not secrets.base_spans(r.text, secrets.holds_name(r.text))
    bins = {}
    for r in packed.collect():
        bins[r.bin_id] = bins.get(r.bin_id, 0) + r.length
    assert max(bins.values()) <= BIN_BYTES
    assert sum(bins.values()) == sum(len(r.text.encode()) for r in clean.collect())


def test_edge_cases(spark, tmp_path):
    out = staged(spark, edge_documents(spark), tmp_path)
    assert sorted(r.doc_id or 0 for r in out[3].collect()) == [0, 1, 7, 8, 9]
    assert out[4].select("doc_id").distinct().count() == 5


def test_empty_table(spark, tmp_path):
    assert [f.count() for f in staged(spark, empty_documents(spark), tmp_path)] == [0] * 5
