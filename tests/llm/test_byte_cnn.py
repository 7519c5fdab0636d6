import numpy as np

from umbra.llm import byte_cnn


def test_windows_cover_every_byte():
    texts = ["", "ab", "x" * 255, "y" * 256, "z" * 257, "w" * 5000]
    win, owner, held = byte_cnn.windows_of(texts)
    for t, text in enumerate(texts):
        own = win[owner == t]
        step = byte_cnn.WINDOW - byte_cnn.REACH
        back = b"".join(w[:step].tobytes() for w in own[:-1]) + own[-1].tobytes()
        assert back.rstrip(b"\0") == text.encode()
        assert held[owner == t].min() >= 1


def test_folded_tables_equal_the_taps():
    net = byte_cnn.ByteCNN(["a", "b"])
    win = np.random.default_rng(0).integers(0, 256, (3, byte_cnn.WINDOW)).astype(np.uint8)
    assert np.allclose(net.responses(win, net.fold()), net.fold_sparse(win), atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in byte_cnn.identify(docs).collect() if r.held_out]
    assert len(got) > 150 and sum(lang[r.doc_id] == r.lang_pred for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(edge_docs, edge_rows, no_docs):
    got = byte_cnn.identify(edge_docs).collect()
    assert len(got) == len(edge_rows)
    for r in got:
        if r.doc_id in (100, 101, 102, 104):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("de", "en", "fr")
    assert byte_cnn.identify(no_docs).count() == 0
    kept = byte_cnn.filtered(edge_docs, None, 0.3)
    assert kept.columns == edge_docs.columns and kept.count() == len(edge_rows) - 4


def test_nothing_learned_without_labels(spark):
    got = byte_cnn.identify(spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")).collect()
    assert got[0].lang_pred == "und" and got[0].score == 0
