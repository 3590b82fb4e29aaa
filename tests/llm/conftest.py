import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null and empty texts, ties, a repeated row, special characters, a long text.
ODD_TEXTS = [None, "", " ", "word", "two words", "it's we'll 'S <|endoftext|> x", "日本語 テキスト １２ ½ 🙂🙂", "x\r\n\r\n y \x85\xa0z\x1c", "ab" * 3000, "many words here " * 3000]


@pytest.fixture
def documents(spark):
    def make(texts, clash=False, ids=None):
        rows = [(i if ids is None else ids[i], t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"src{i % 5}", None if t is None else len(t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, DOCUMENTS)
        if clash:
            for name in ("key", "id", "ids", "row", "lines", "size", "score", "start", "shard", "uid", "group", "rank"):
                df = df.withColumn(name, df.n_chars.cast("string"))
        return df

    return make


@pytest.fixture
def odd(documents):
    """Odd texts with columns of clashing names, the last row twice and one without an id."""
    df = documents(ODD_TEXTS, clash=True)
    last = df.filter(df.doc_id == len(ODD_TEXTS) - 1)
    nameless = df.filter(df.doc_id == 4).withColumn("doc_id", F.lit(None).cast("long"))
    return df.unionByName(last).unionByName(nameless)
