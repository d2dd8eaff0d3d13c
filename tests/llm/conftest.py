import pytest

#: Texts that are awkward: null, empty, white space, repeats, odd characters.
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One TWO"), (6, "one two three"), (7, "ONE two\tthree"),
    (8, "a b c d e f g h i j"), (8, "a b c d e f g h i j"), (None, "no id here at all"), (None, None),
    (9, "it's don't '' 's\n\n x  y   z \r\n"), (10, "<|endoftext|> in <|endoftext|>text"), (11, "É ß １２ ½ 😀‍ \x85 \x1c 　 x"),
    (12, "aaaaaaaaaaaaaaaaaaaaaaaaa " * 5), (13, "word " * 3000), (-5, "negative id"), (2**62, "large id"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with extra columns of clashing names."""
    rows = [(i, t, "x", "y", 7, 1.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, source string, ids int, score double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
