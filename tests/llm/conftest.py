import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, mark int, unit string, shard int, stat int, copy int"


def _row(i, text, source="a", lang="en"):
    return (i, text, lang, source, None if text is None else len(text), "x", 1, "u", 9, 2, 3)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, names the operators use inside."""
    long = " ".join(f"w{k}x{k % 13}" for k in range(20_000))
    para = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega. "
    rows = [_row(1, ""), _row(2, None), _row(None, None, None, None), _row(None, para), _row(3, "  \n\t "), _row(4, long, "b"), _row(5, long, None),
            _row(6, para), _row(6, para), _row(6, para + "more"), _row(7, "one"), _row(8, "Ünïcode ſ K wörds 漢字   x"), _row(9, "a\x00b c")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
