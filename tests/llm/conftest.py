import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, k1 string, row string, n string"
TEXTS = [
    None, "", "   \n\t ", "one", "one two three", "a b c d e", "A b C d e", "Línea uno ñ\nlínea dos\nlínea tres\n\nx",
    "same line\nsame line\nsame line\nsame line\nsame line", "don't  stop now　 we're 'll ² 12,5\r\n\n  end ",
    "<|endoftext|> plain \U0001f642́ text", "word " * 30000, "q" * 20000, "x y z " * 40,
    "mail bob.x@mail.example.com or +1 (988) 555-2485 at 10.0.0.255 with 4111 1111 1111 1111 end",
]


@pytest.fixture(scope="session")
def rows():
    out = [(i, t, "en", f"s{i % 4}" if i % 5 else None, 7, "own", "own", "own", "own") for i, t in enumerate(TEXTS)]
    out += [out[5], out[8], (None, "no id at all, five words", None, None, None, None, None, None, None),
            (100, TEXTS[14], None, "s1", None, "own", None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
