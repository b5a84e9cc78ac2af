import base64

import pytest


@pytest.fixture(scope="session")
def tiktoken_encoding():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, a clashing extra column."""
    long = " ".join(f"word{k % 977} of\tthe line {k}" for k in range(30_000))
    rows = [(1, None, "x"), (2, "", None), (None, "some text that repeats here for all", "y"), (3, "some text that repeats here for all", "y"), (3, "some text that repeats here for all", "y"), (4, long, "z"), (5, long + " end", None), (6, "é ü 漢字 \n\n  tabs\t \r\n", "x"), (None, None, None), (7, "x" * 5000, "x"), (8, "\n", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, id string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, id string")
