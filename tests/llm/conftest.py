import duckdb
import pytest

SMALL, MIDDLE, LARGE = (f"/root/testdata/sf{s}" for s in ("0.001", "0.01", "0.1"))

# every awkward case in one table: nulls in any column, empty, white and very long texts, repeated
# rows, ties, and columns whose names the operators use themselves
TEXT = "The quick brown fox jumps over the lazy dog and runs far away into the dark green woods today"
ROWS = [
    (1, TEXT, "en", "a"), (1, TEXT, "en", "a"), (2, TEXT + " again", "en", "b"), (3, None, None, None), (4, "", "en", "a"),
    (5, " \t\n ", "en", "a"), (None, TEXT, "en", "a"), (None, None, None, None), (6, "x" * 50_000, "en", ""), (7, "word " * 30_000, "en", "a"),
    (8, "Two words", None, "b"), (9, "two  WORDS", "en", "b"), (10, TEXT.replace(" ", "\n"), "en", "c"), (1, "other text of that id", "en", "a"),
    (11, "<|endoftext|> don't \u3042\u00e9 \U0001F600", "en", "a"), (12, TEXT, "en", "a"),
]
CLASH = ["score", "predicted", "held_out", "n_tokens", "n_bytes", "row", "k", "key", "norm", "mix_rank", "mix_slot", "_source", "ids", "start", "url",
         "path", "dir", "own", "_at", "_id", "y", "component_id", "ruled", "host", "prefix", "bucket", "_lost_id"]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(*r, len(r[1] or ""), *[i if n % 2 else None for n in range(len(CLASH))]) for i, r in enumerate(ROWS)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASH)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (None, 1, 1), (4, None, None), (7, 0, 1), (9, 1, 0)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def bench(spark):
    return spark.createDataFrame([(1, "fox jumps over the lazy dog and runs far", "x"), (2, None, "x"), (3, "", "x"), (4, "two words", None),
                                  (5, "word " * 9, "x"), (None, "nowhere at all to be found here", "x")], "item_id long, text string, doc_id string")


def read(sf, name):
    return duckdb.sql(f"SELECT * FROM '{sf}/{name}.parquet' ORDER BY 1").fetchall()
