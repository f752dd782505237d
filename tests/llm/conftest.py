import pytest

#: Odd texts: null, empty, white space of all kinds, ties, marks of other languages, long ones.
TEXTS = [
    None,
    "",
    " ",
    "\n",
    "\n\n a \n\tA\n",
    "one",
    "one two three four",
    "one two three four five",
    "ONE two THREE four five",
    "The quick brown fox jumps over the lazy dog and runs on and on.",
    "the quick brown fox jumps over the lazy dog and runs on and on.",
    "été où ça naïve über straße ñandú 門夢 😀 ﬁ",
    "\x1c\x1d\x85\xa0 x y \x00 <|endoftext|> </s> ▁▁ mark",
    "word " * 30_000,
    "abc" * 40_000,
    "\n".join(f"line {i % 7}" for i in range(3000)),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every oddity: repeated rows, null ids, extra columns with names
    that operators make."""
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", f"k{i}", i) for i, t in enumerate(TEXTS)]
    rows += [rows[9], rows[9], (None, "lonely text without an id", None, "s1", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept_text string, size long")
    return df.repartition(3, "text").persist()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
