import itertools

import numpy as np
import pytest

from umbra.llm import toxicity

WORDS = ["stupid", "idiot", "plain", "people", "walking", "under", "trees", "and", "talking", "about", "nice", "weather"]


@pytest.fixture(scope="module")
def lm():
    table = toxicity.symbol_table()
    s = toxicity.symbols("  ".join(WORDS * 200), table)
    n = toxicity.SYMBOLS
    code, count = np.unique((s[:-2] * n + s[1:-1]) * n + s[2:], return_counts=True)
    return toxicity.log_model(dict(zip(code.tolist(), count.tolist())))


def test_restores(lm):
    r = toxicity.Restorer(lm)
    for raw, want in (("such St00pid", "such st"), ("1d1ot here", "idiot here"), ("s t u p i d!", "stupid!"), ("stuuupid", "stupid"), ("p3ople t@lking", "people talking"),
                      ("TREES!! AND!!", "trees!! and!!"), ("3.5 and 2024", "3.5 and 2024"), ("", "")):
        assert r.restore(raw).startswith(want), (raw, r.restore(raw))


def test_decoding_is_the_best_path(lm):
    r = toxicity.Restorer(lm)
    for span in ("1d10t", "st@p1", "a$$b"):
        best = (-np.inf, "")
        for path in itertools.product(*(list(r._arcs(span, i)) for i in range(len(span)))):
            out, score, a, b = "".join(x for x, _ in path), sum(c for _, c in path), 0, 0
            for x in out:
                s = r.symbol.get(x, 0)
                score, a, b = score + lm[a, b, s], b, s
            best = max(best, (score + lm[a, b, 0], out))
        assert r._decode(span) == best[1]


def test_spans_of_any_length():
    n, own = toxicity.SYMBOLS, WORDS + ["hate", "was", "ass"]
    s = toxicity.symbols(" " + " ".join(w for i in range(40) for w in own[i % 7:] + own[:i % 7]) + ", 12 ", toxicity.symbol_table())
    code, count = np.unique((s[:-2] * n + s[1:-1]) * n + s[2:], return_counts=True)
    r = toxicity.Restorer(toxicity.log_model(dict(zip(code.tolist(), count.tolist()))))
    words = ["people", "walking", "under", "trees", "and", "talking", "about", "stupid", "people"]
    assert r.restore(" ".join("".join(words))).split() == words              # over 48 characters, words spaced with single gaps
    assert r.restore("s t u p i d p e o p l e").split() == ["stupid", "people"]
    assert r.restore("so a n d so").split() == ["so", "and", "so"]           # three letters
    assert "stupid" in toxicity.features(r.restore(",".join(words[:7]) + ",stup1d,"))
    assert "stupid" in toxicity.features(r.restore("a.n.d,stup1d"))
    assert r.restore("idio7 n1ce tr33s s7upid hat3 a55") == "idiot nice trees stupid hate ass"
    assert r.restore("people7 and 12 idiot!") == "people7 and 12 idiot!"     # a final mark that stands for itself
    assert r.restore("stup1d," * 20_000).count("stupid") == 20_000


def test_counts_all_texts(spark):
    docs = spark.createDataFrame([("ab",), ("ab",), (None,), ("",)], "text string").repartition(3)
    got = {r.code: r.n for r in toxicity.trigram_counts(docs).collect()}
    n = toxicity.SYMBOLS
    assert got[(0 * n + 1) * n + 2] == 2 and got[(1 * n + 2) * n + 0] == 2


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = [(r.predicted, truth[r.doc_id]) for r in toxicity.detect(docs, labels).collect() if r.held_out and r.doc_id in truth]
    hit = sum(p and t for p, t in got)
    assert hit / sum(p for p, _ in got) > 0.9 and hit / sum(t for _, t in got) > 0.85


def test_held_out_labels_are_never_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - toxic, toxic) as toxic")
    assert sorted(toxicity.detect(docs, labels).collect()) == sorted(toxicity.detect(docs, flipped).collect())


def test_edges(spark, edge_docs, edge_rows, no_docs, no_labels):
    got = toxicity.detect(edge_docs, no_labels).collect()
    assert len(got) == len(edge_rows) and all(r.score == 0 and r.predicted == 0 for r in got)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (3, None), (3, 1)], "doc_id long, toxic int")
    got = toxicity.detect(edge_docs, labels).collect()
    assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (100, 101, 102)}) == 1
    assert toxicity.detect(no_docs, labels).count() == 0
