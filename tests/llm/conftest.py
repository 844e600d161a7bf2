import pytest

LONG = "word " * 40_000
TEXTS = [
    (1, "The first line of a shared licence text\nand something else that only this one has\n", "en"),
    (2, "The first line of a shared licence text\nanother thing that is not found anywhere else", "en"),
    (3, "  THE first line of a shared licence text \r\nà côté de la rivière, les enfants jouent", "fr"),
    (4, None, "en"), (5, "", None), (6, "!!! ???", "de"), (7, "x", "en"), (8, LONG, "en"),
    (9, "one two three four five six seven eight nine ten eleven twelve", "en"),
    (10, "one two three four five six seven eight nine ten eleven twelve", "en"),
    (11, "One, two three; four five six seven eight nine ten eleven twelve!", "en"),
    (12, "a\x00b \U0001f600 漢字 ß é\n\n\n", None), (None, "a row without an id that has some words in it", "en"),
    (9, "one two three four five six seven eight nine ten eleven twelve", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and further columns named like results."""
    rows = [(i, t, lang, "src", None, 7, "mine") for i, t, lang in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, spans string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id < -5")


@pytest.fixture
def split_joins(spark):
    """Whether the final plan of a query splits a skewed join, with thresholds for small tables."""
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}

    def run(df_of):
        before = {k: spark.conf.get(k, None) for k in small}
        for k, v in small.items():
            spark.conf.set(k, v)
        try:
            df = df_of()
            df.collect()
            return "skew=true" in df._jdf.queryExecution().executedPlan().toString()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    return run
