import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, rank long, size long, score double, length long, kept boolean, key string, row long, n_words long, node long, comp long, part long, label int, quality int"
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river bank "


def odd_rows():
    texts = [
        None, "", " ", "\n\n", "word", "two words", PROSE * 3, PROSE * 3, PROSE * 3 + "and one more ending here", "é ü 日本 😀 ß", "a" * 3000, "x y " * 30_000,
        PROSE + "\nReleased under the MIT License.\n\ntoken = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" tail", "tab\tand\r\nlines\n \nwith  double  spaces ", "### $$$ %%% !!!",
    ]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else "src" + str(i % 3), len(t or ""), 1, 2, 3, 4, 0.5, 6, True, "k", 7, 8, 9, 10, 11, 0, 1) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], (None, *rows[6][1:]), (None, None, *rows[6][2:])]


def written(spark, path, docs, labels):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    pages = docs.selectExpr("doc_id AS page_id", "CASE WHEN doc_id % 4 = 0 THEN 'https://a.example.net/en/?x' WHEN doc_id % 4 < 3 THEN text END AS url", "text AS html", "source AS host", "score", "kept AS rule")
    pages.write.parquet(f"{path}/pages.parquet")
    docs.selectExpr("doc_id AS item_id", "substr(text, 1, 100) AS text").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    docs = spark.createDataFrame(odd_rows(), SCHEMA).coalesce(2)
    labels = spark.createDataFrame([*[(i, None if i == 3 else i % 2, 0) for i in range(15)], (None, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    return written(spark, tmp_path_factory.mktemp("odd"), docs, labels)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    return written(spark, tmp_path_factory.mktemp("empty"), spark.createDataFrame([], SCHEMA), labels)


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest documents table as rows."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    return [r.asDict() for r in rows]


SF = "/root/testdata/sf0.001"
__all__ = ["F", "SF"]
