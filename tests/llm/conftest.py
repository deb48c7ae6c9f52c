import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])

SENTENCE = "The quick brown fox jumps over the lazy dog near the quiet river bank today, as it did before."


def awkward_rows():
    """Nulls in each column, empty and blank texts, repeated rows, shared ids, ties, one very long text."""
    words = " ".join(f"w{i % 9973}x{i % 31}" for i in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n \x0b\x0c\r ", "en", "s", 8), (None, SENTENCE, "en", "s", 9),
            (None, None, None, None, None), (4, SENTENCE, "en", "s", 9), (4, SENTENCE, "en", "s", 9), (4, "another text of this id", "en", "s", 9),
            (5, words, "en", "s", len(words)), (6, "日本語 の テキスト é ü 😀 a@b.co", None, None, None), (7, "x", "fr", None, 1),
            (8, "Le chat noir dort sur le tapis rouge pendant que la pluie tombe doucement.", "fr", "s", 5)]
    rows += [(9, "A document that every rule keeps has plain sentences in it. They end as sentences do, and none of them is said "
              "twice, so nothing is taken away from what was written here.", "en", "s", 1)]
    rows += [(100 + i, f"{SENTENCE}\nDocument number {i} has this line of its own, which is long enough.\n{SENTENCE}", "en", "s", 1)
             for i in range(8)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    """The awkward rows with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_rows(), SCHEMA)
    for name in ("h", "key", "rid", "fp", "block", "w", "size", "uid", "row", "item_id", "pos", "kind", "score", "digest", "bucket"):
        df = df.withColumn(name, F.lit(7))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
