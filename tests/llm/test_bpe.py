import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm.edge import edge_documents, empty_documents
from tesserql.llm import bpe, tokenfile

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_random_texts_match_the_library(library):
    rng, v, pieces = random.Random(1), bpe.vocabulary(PATH), bpe.backtracking_pieces(PATH)
    other = tokenfile.library_pieces(PATH)
    letters = "aeé <|endoftext|>\n\t 's'll123²½Ⅷ中文日本😀 --==__  \x1c\x85꟒"
    for k in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        if k % 5 == 0:
            text = text[:9] + "<|endoftext|>" + text[9:]
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(pieces.packed(text), "<u4").tolist() == ids, text
        assert np.frombuffer(other.packed(text), "<u4").tolist() == ids, text
        assert v.decode(np.array(ids, np.int64)).decode() == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["-" * 5000, "a" * 9000, "ab" * 4000, " " * 3000, "thethe" * 500])
def test_long_pieces(library, text):
    found = np.frombuffer(bpe.backtracking_pieces(PATH).packed(text), "<u4").tolist()
    assert found == library.encode(text, add_special_tokens=False).ids


def test_malformed_bytes_decode_as_in_the_library(library):
    v, rng = bpe.vocabulary(PATH), random.Random(2)
    for _ in range(300):
        ids = [rng.randrange(256) for _ in range(rng.randrange(12))]
        assert v.decode(np.array(ids, np.int64)).decode() == library.decode(ids, skip_special_tokens=False)


def test_round_trip_frames(spark, library):
    docs = edge_documents(spark)
    texts = sorted((r.text or "") for r in docs.collect())
    ids = bpe.encode_column(docs, PATH)
    assert sorted(r.text for r in bpe.decode_column(ids, PATH).collect()) == texts
    rows = bpe.round_trip_digests(docs, PATH).collect()
    assert sorted(r.decoded_sha256 for r in rows) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    assert bpe.round_trip_digests(empty_documents(spark), PATH).collect() == []


def test_token_files(spark, library):
    docs = edge_documents(spark)
    folder = tokenfile.write_token_files(docs, PATH, end_id=2)
    rows = tokenfile.read_token_files(spark, folder).collect()
    rows.sort(key=lambda r: r.start)
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in rows] == [r.doc_id for r in order]
    at = 0
    for r, d in zip(rows, order):
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids) == (at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert tokenfile.read_manifest(folder)["ids"] == at
    none = tokenfile.write_token_files(empty_documents(spark), PATH, end_id=2)
    assert tokenfile.read_token_files(spark, none).collect() == []
