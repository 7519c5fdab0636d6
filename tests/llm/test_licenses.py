from umbra.llm import licenses


def test_spans_and_labels(spark):
    rows = [
        (1, "Before. Licensed under the Apache License, Version 2.0. After."),
        (2, "The MIT license and the mit License; GENERAL public licenses."),
        (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of the software and associated documentation files, "
            "to deal in the software without any restriction at all"),
        (4, "licensed, sealed, delivered"), (5, None), (6, "ïmit license"), (1, "Released under the MIT License."), (None, "mit license"),
        (7, "mit license " * 2000), (7, "mit license " * 2000),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_words): r for r in got}
    assert (by[1, 10].base_labels, by[1, 10].labels, by[1, 10].first_word) == ("apache", "apache", 4)
    assert (by[2, 10].n_base, by[2, 10].first_word, by[2, 10].last_word, by[2, 10].labels) == (2, 1, 5, "mit")
    third = next(r for r in got if r.doc_id == 3)
    assert third.base_labels == "" and third.labels == "mit" and 0.6 <= third.score < 1
    assert next(r for r in got if r.doc_id == 4).labels == ""
    assert by[5, 0].first_word is None and by[5, 0].score == 0 and by[6, 2].n_base == 0
    assert by[1, 5].labels == "mit" and by[None, 2].n_base == 1
    assert [r.n_base for r in got if r.doc_id == 7] == [2000, 2000]


def test_oracle(same_as_oracle):
    same_as_oracle("op7_license_scan")


def test_edges(edge_docs, edge_rows, no_docs):
    assert licenses.scan(edge_docs).count() == len(edge_rows)
    assert licenses.scan(no_docs).count() == 0
