import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) rows, with columns whose names the operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 7, "x") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, size int, row string")

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows."""
    long = " ".join(WORDS[i * i % 24] + str(i % 97) for i in range(30_000))
    line = "this line is long enough to count as a repeated line of text"
    return [
        (None, "a row without an id, of some words"), (0, None), (1, ""), (2, " \n\t \n"), (3, line), (4, line), (4, line), (5, f"{line}\nother é\r\n{line.upper()}"), (6, f"x\n {line} "), (7, f"{line}\n"),
        (8, long), (9, long + " tail"), (10, "Ünïcödé çà 日本語 \U0001f600 words"), (11, "one"), (12, "One"), (13, "a b c"), (14, "$$$ ### |||"), (-5, "negative id text here for all of you"),
    ]
