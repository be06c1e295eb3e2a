from pyspark.sql import functions as F

from lexmill.functions import text as X


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


def test_strip_takes_every_kind_of_space(spark):
    assert one(spark, "\t\xa0 a b　\n", X.strip("x")) == "a b"
    assert one(spark, " \xa0\t", X.blank_to_null("x")) is None
    assert one(spark, None, X.strip("x")) is None


def test_kept(spark):
    rows = [("[deleted]",), (" [removed]\t",), ("\xa0",), (None,), ("fine",)]
    assert [r[0] for r in spark.createDataFrame(rows, "x string").select(X.is_kept("x")).collect()] == [False, False, False, False, True]


def test_year(spark):
    rows = [("1700000000",), ("1.7e9",), ("1420087672.5",), ("n/a",), ("",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "x string").select(X.year_of("x")).collect()] == [2023, 2023, 2015, None, None, None]


def test_segment_lengths(spark):
    make = lambda n: "a" * (n - 1) + "."
    text = " ".join(make(n) for n in (39, 40, 600, 601))
    assert [len(s) for s in one(spark, text, X.segments("x"))] == [40, 600]


def test_content_tokens(spark):
    assert one(spark, "They can't find the dog's OLD bones, it's well-known", X.content_tokens("x")) == ["find", "dog", "old", "bones", "well-known"]


def test_mid_sentence_words(spark):
    assert one(spark, "Anna saw Paris, NASA and paris. Berlin slept", X.mid_sentence_words("x")) == ["saw", "Paris", "and", "paris", "slept"]


def test_technical_parts(spark):
    assert one(spark, "Rule spotting/Pattern finding (old)", X.technical_parts("x")) == ["rule spotting/pattern finding", "rule spotting", "pattern finding"]


def test_letter_runs(spark):
    assert one(spark, "Zoë's 3x test_case", X.letter_runs(F.col("x"))) == ["zoë", "s", "x", "test", "case"]
