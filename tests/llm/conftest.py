import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, length long, score double, label string, key string, id long, shard int, n long, kept boolean, rule string"


def rows_of(texts, first=0):
    return [(first + i, t, "en", "src0", None if t is None else len(t), 1, 2, 0.5, "x", "y", 7, 8, 9, True, "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns whose names the operators use themselves."""

    def docs(texts, ids=None):
        rows = rows_of(texts)
        if ids is not None:
            rows = [(i, *r[1:]) for i, r in zip(ids, rows)]
        return spark.createDataFrame(rows, SCHEMA)

    return docs


LONG = " ".join(f"word{i % 977} and more{i % 31}." for i in range(12_000))
TEXTS = [
    "The quick brown fox jumps over the lazy dog again and again.", None, "", "   \n\t ", "one", "two words", "The quick brown fox jumps over the lazy dog again and again.",
    LONG, "ünïcödé Éa ßtraße 你好 世界 😀 e\u0301 \u00a0x\u2003y", "a<|endoftext|>b <|startoftext|> c", "x" * 5000, LONG, "tab\tand\x0bvertical\x1cfile\x85next", "UPPER lower 123 4.5 it's we'll",
]


@pytest.fixture(scope="session")
def texts():
    return list(TEXTS)
