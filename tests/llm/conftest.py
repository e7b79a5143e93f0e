import pytest
from corpus_tables import SF, table


@pytest.fixture(scope="session")
def shipped(spark):
    from roadloom.session import ship

    ship(spark)
    return spark


@pytest.fixture(scope="session")
def docs(shipped):
    return shipped.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def edge(shipped):
    long = " ".join(f"word{k % 977} alpha{k % 31}," for k in range(15_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, long), (7, long), (7, long), (8, "the same line of text here again"),
        (9, "the same line of text here again"), (None, "no id at all, mail me: someone@example.org"), (None, None), (10, "\U0001f600 émail ünï@bücher.example +49 30 1234567-8"), (11, "x" * 60_000), (12, "1" * 5_000),
        (13, "call +1 (555) 123-4567 now or card 4111 1111 1111 1111 and ip 10.0.0.256 and 10.0.0.25"),
    ]
    return table(shipped, rows)


@pytest.fixture(scope="session")
def nothing(shipped):
    return table(shipped, [(1, "x")]).where("false")
