import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


EDGE_TEXTS = [
    None, "", "   \n\t ", "one", "tie tie", "tie tie", "tie \t tie", "tie  tie", "été ▁ x y", "</s>[INST] \\ <|x|>",
    "word " * 30_000, "w" * 70_000, "a b c\n" * 40, "A\x00B \x1c ́ \U0001f600",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty, very long, tied and repeated rows, and extra columns with clashing names."""
    rows = [(i, t, None if i % 3 else "en", i, "x") for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[4], rows[4], (None, "no id here", "en", 1, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long, keep_id string").repartition(3)


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def parity_pair():
    """Two different words that a polynomial hash modulo 2**64 gives one value, whatever its odd base."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.fixture(scope="session")
def repeated_docs(spark):
    """Ids on several rows, whole copies of rows, null ids, and extra columns named like those the operators make."""
    a, b, c = (" ".join(f"{k}{j}" for j in range(60)) for k in "abc")
    rows = [(3, a), (5, a), (5, b), (7, b + " tail"), (5, b), (9, c), (9, "  " + c), (9, c), (2, c + " end"), (None, a), (None, "only null"), (None, "only null"), (11, None), (11, "")]
    names = ["doc_id", "text", "__dropped_id", "__doc_id", "row", "class", "doc_id_mark", "row_mark", "stays_mark", "mark_id", "alive", "key", "node", "n_chars"]
    docs = spark.createDataFrame([(i, t, *([k] * (len(names) - 2))) for k, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names[2:]))
    return docs.repartition(3)
