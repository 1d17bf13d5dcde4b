import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def odd_texts():
    """Nulls, empty and blank texts, ties, copies, long and odd texts."""
    import random

    rng = random.Random(11)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = line(60)
    long = line(30000)
    return [
        (1, None), (2, ""), (3, "   \t\n"), (4, base), (5, base), (6, base.replace(" ", "  \n")), (7, base + " once more"),
        (8, base.upper()), (9, "one"), (10, "one two three"), (11, "one two three four"), (12, long), (13, long + " end"), (14, long),
        (15, "naïve café ﬀ ſecret \u00a0\u2003 日本語 🙂🙂 e\u0301"), (16, "<|endoftext|> a<|endoftext|>"), (17, "\x1c\x1d\x85 x\x00y"),
        (18, "a" * 50000), (19, "12345 !!! ??? 999"), (20, line(200)), (None, "no id"), (4, base), (21, "x" * 7 + " " * 4000 + "y"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 2}" if i != 9 else None, 1, "clash", 2.0, "z", 7.0, "q") for i, t in odd_texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, size double, row string, score double, lang_pred string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd):
    return odd.where("doc_id < 0")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def rows_of(small):
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{small}/documents.parquet'").fetchall()
