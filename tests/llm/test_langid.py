import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.edge import edge_documents, empty_documents
from tesserql.llm import langid

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("piece_bpe_32k.model")


def segmentations(word, vocab):
    """All ways to cut a word into pieces, by enumeration."""
    if not word:
        yield []
    for m in range(1, len(word) + 1):
        k = vocab.get(word[:m], 0 if m == 1 else None)
        if k is not None:
            for rest in segmentations(word[m:], vocab):
                yield [k, *rest]


def words(rng, n, most):
    return [langid.MARK + "".join(rng.choice("theringoé") for _ in range(rng.randint(1, most))) for _ in range(n)]


def test_forward_sums_all_segmentations():
    vocab, rng = langid.pieces(PATH), random.Random(3)
    model = np.random.default_rng(0).random((len(vocab) + 1, 3))
    model /= model.sum(axis=0)
    sample = words(rng, 40, 9)
    found = langid.word_scores(sample, PATH, model)
    assert np.allclose(langid.word_scores(sample, PATH, model, wide=0), found)
    for w, row in zip(sample, found):
        slow = sum(np.prod(model[s], axis=0) for s in segmentations(w, vocab))
        assert np.allclose(row, np.log(slow))


def test_expected_counts_match_enumeration():
    vocab, rng = langid.pieces(PATH), random.Random(4)
    sample = words(rng, 20, 8)
    times = np.arange(1.0, 21.0)
    slow = np.zeros(len(vocab) + 1)
    for w, n in zip(sample, times):
        ways = [(s, math.pow(1 / len(slow), len(s))) for s in segmentations(w, vocab)]
        z = sum(p for _, p in ways)
        for s, p in ways:
            for k in s:
                slow[k] += n * p / z
    assert np.allclose(langid.expected_counts(sample, times, PATH), slow)
    assert np.allclose(langid.expected_counts(sample, times, PATH, wide=0), slow)


def test_long_pieces_and_words():
    """Pieces of any length, and words wider than one batch is."""
    vocab = langid.pieces(PATH)
    long = max(vocab, key=len)
    assert len(long) > 12
    rng = random.Random(5)
    for word in [langid.MARK + long.removeprefix(langid.MARK) + "xé", langid.MARK + "".join(rng.choice("theringoé") for _ in range(300))]:
        size = len(vocab) + 1
        sums = [{0: 1}]  # of the segmentations of each prefix, by number of pieces
        for j in range(1, len(word) + 1):
            now = {}
            for m in range(1, j + 1):
                if (vocab.get(word[j - m : j], 0 if m == 1 else None)) is not None:
                    for pieces, ways in sums[j - m].items():
                        now[pieces + 1] = now.get(pieces + 1, 0) + ways
            sums.append(now)
        exact = sum(ways * size ** (len(word) - k) for k, ways in sums[-1].items())  # times size ** len(word)
        model = np.full((size, 2), 1 / size)
        found = langid.word_scores([word, "ab"], PATH, model)[0]
        assert np.allclose(found, math.log(exact) - len(word) * math.log(size))
    counts = langid.expected_counts([word], np.array([2.0]), PATH)
    lengths = np.zeros(size)
    lengths[[k for k in vocab.values()]] = [len(p) for p in vocab]
    lengths[0] = 1
    assert np.isclose((counts * lengths).sum(), 2 * len(word))


def test_marks_stay_with_their_letters():
    assert langid.letter_runs("नमस्ते,x̂y1") == ["नमस्ते", "x̂y"]
    assert langid.letter_runs("1\u0301") == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs, PATH).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98


def test_edge_cases(spark):
    rows = langid.identify(edge_documents(spark), PATH).collect()
    assert len(rows) == 11
    by = {r.doc_id: r for r in rows}
    assert {i for i, r in by.items() if r.lang_pred == "und"} == {2, 3, 4, 10}
    assert all(0 <= r.score <= 1 for r in rows)
    assert by[None].held_out and not by[1].held_out
    assert langid.identify(empty_documents(spark), PATH).collect() == []
    untaught = edge_documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(untaught, PATH).collect()} == {"und"}


def test_tokens_share_the_rows_of_their_words(monkeypatch):
    """Whatever the table holds, a text's score is the sum over its words."""
    size = len(langid.pieces(PATH)) + 1
    model = np.random.default_rng(1).random((size, 3))
    model /= model.sum(axis=0)
    rng = random.Random(6)
    parts = ["the", "The,", "(the)", "don't", "x1y2z", "12", "--", "été;", "नमस्ते,", "o" * 40, "thering", "a\u0085b", " re", " or", "é.é"]
    texts = [None, "", "  ", *(" ".join(rng.choice(parts) for _ in range(rng.randrange(30))) + rng.choice(["", " ", "\n"]) for _ in range(60))]
    plain = []
    for t in texts:
        words = [langid.MARK + w for token in (t or "").lower().split() for w in langid.letter_runs(token)]
        scores = np.array([langid.word_scores([w], PATH, model)[0] for w in words]).reshape(-1, 3)
        plain.append([*scores.sum(axis=0), len(words)])
    for most in (1, 12, 600):
        monkeypatch.setattr(langid, "KEEP_WORDS", most)
        scorer = langid.Scorer(PATH, model)
        found = np.vstack([scorer.score(texts[k : k + 7]) for k in range(0, len(texts), 7)])
        assert np.allclose(found, plain)
