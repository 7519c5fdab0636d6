import hashlib

import numpy as np
import pytest

from umbra.llm import bpe


@pytest.fixture(scope="module")
def enc():
    return bpe.load(bpe.RANKS)


@pytest.mark.parametrize("text", [
    "", "plain words, don't 123", "a" * 90_000, " " * 70_000, " " * 50_001 + "x", "!?" * 40_000, "\n" * 50_000, "word1's " * 9000,
    "déjà vu ☃ 漢字    x" * 4000, "x'" * 40_000, "1a" * 40_000, "a\n b  c\t" * 9000, "!'s don't 'll" * 8000, "\U0001f600" * 30_000])
def test_same_ids_as_the_library(enc, text):
    assert bpe.encode(enc, text).tolist() == enc.encode_ordinary(text)
    assert "".join(bpe.pieces(text)) == text
    assert bpe.decode(enc, bpe.encode(enc, text)) == text.encode()


def test_rows(spark, enc, edge_docs, edge_rows):
    got = bpe.tokenize(edge_docs, keep_ids=True).collect()
    assert len(got) == len(edge_rows)
    texts = {}
    for r in edge_rows:
        texts.setdefault(r[0], r[1] or "")
    for r in got:
        ids = np.array(enc.encode_ordinary(texts[r.doc_id]), "<u4")
        assert r.n_tokens == len(ids) and list(r.ids) == ids.tolist()
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    raw = bpe.detokenize(spark.createDataFrame([(1, [15496]), (2, None), (3, [])], "doc_id long, ids array<int>")).collect()
    assert [r.raw and bytes(r.raw) for r in raw] == [b"Hello", None, b""]


def test_empty(no_docs):
    assert bpe.tokenize(no_docs).count() == 0
