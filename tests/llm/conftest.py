import pytest

SMALL = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(small):
    return {r.doc_id: r.text for r in small.collect()}


def prose(n: int, seed: int = 0) -> str:
    """n words, no three of which repeat soon."""
    return " ".join(f"{WORDS[(i * 7 + seed) % 20]}{(i * i + seed * 31) % 997}" for i in range(n))


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, blanks, repeats, a very long text, and columns named as the operators name theirs inside."""
    rows = [
        (1, prose(60), "en", "a", 1), (1, prose(60), "en", "a", 1), (2, None, "en", "a", 1), (3, "", "en", None, None),
        (4, " \n\t \n", None, "b", 1), (None, prose(60, 1), "en", "b", 1), (None, None, None, None, None), (5, prose(30_000, 2), "en", "b", 1),
        (6, prose(60).upper(), "en", "c", 1), (7, "one", "en", "c", 1), (8, "one", "en", "c", 1), (9, "x" * 200_000, "en", "c", 1),
    ]
    clash = ["rid", "row", "key", "set", "n", "block", "host", "comp", "root", "first", "pos", "word", "line", "lines", "spans", "part", "cluster", "row_key", "gone", "size", "n_words", "kept"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)
    return spark.createDataFrame([(*r, *clash) for r in rows], schema)
