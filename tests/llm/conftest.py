import random

import pytest

#: Columns beside those of documents, with names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _s string, _row string, id long, keys int, _id long"
LONG = "lorem ipsum dolor sit amet " * 8000 + "x" * 50_000 + " 4111 1111 1111 1111 a@b.example.org\n" + "\n".join(["Same line again."] * 300)


@pytest.fixture(scope="session")
def edge_rows():
    r = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    rows = [(i, " ".join(r.choice(words) for _ in range(40)) + ".", "en", f"s{i % 3}", 10, 0.5, "a", "b", 1, 2, 3) for i in range(30)]
    rows += [
        (100, None, "en", "s0", None, None, None, None, None, None, None),
        (101, "", None, None, 0, 0.1, "x", "y", 5, 6, 7),
        (102, "   \n\t ", "fr", "s1", 3, 0.1, "x", "y", 5, 6, 7),
        (103, LONG, "en", "s1", len(LONG), 0.1, "x", "y", 5, 6, 7),
        (104, "12345 67890", "de", "s2", 11, 0.1, "x", "y", 5, 6, 7),
        (None, "a row without an id, but with some words in it to count.", "en", "s2", 1, 0.1, "x", "y", 5, 6, 7),
        (105, "two words", None, "s2", 9, 0.1, "x", "y", 5, 6, 7),
    ]
    return rows + [rows[3], rows[3], rows[-1]]      # repeated rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def duck():
    from oracle_check import duck as connect
    return connect("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def same_as_oracle(spark, duck):
    from oracle_check import compare

    def check(name):
        from umbra.llm import registry
        got = compare(spark, duck, name, registry.Q[name], registry.SQL[name], "/root/testdata/sf0.001")
        assert got["cols_match"] and got["rows"] == got["oracle_rows"] and got["hash_match"], got
    return check
