from pyspark.sql import functions as F

from tidemark.functions import text as tx


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(column.alias("x")).collect()]


def test_normalise_keeps_hyphen_and_underscore(spark):
    got = one(spark, tx.normalise(F.col("t")), "  The N/A P-1_b,\n Élan!! ", "", "...", None)
    assert got == ["the n a p-1_b élan", "", "", None]


def test_pre_tokens_keep_punctuation(spark):
    assert one(spark, tx.pre_tokens(F.col("t")), "A/B  c,\td", "") == [["a/b", "c,", "d"], []]


def test_shingles_fall_back_to_the_whole_text(spark):
    w = tx.words(F.col("t"))
    assert one(spark, tx.shingles(w, 5), "one two", "", None) == [["one two"], [], []]
    assert one(spark, tx.shingles(w, 2), "a b a b") == [["a b", "b a"]]


def test_ngrams_of_short_texts_are_empty(spark):
    w = tx.words(F.col("t"))
    assert one(spark, tx.ngrams(w, 13), "a b c d") == [[]]
    assert one(spark, tx.ngrams(w, 4), "a b c d") == [["a b c d"]]


def test_nfc_and_clean(spark):
    assert one(spark, tx.nfc(F.col("t")), "é", "plain", None) == ["é", "plain", None]
    assert one(spark, tx.clean(F.col("t")), "  A \n b. ") == ["A b."]


def test_fingerprint(spark):
    from hashlib import sha256

    df = spark.createDataFrame([(32, "a text")], "label int, text string")
    assert df.select(tx.fingerprint(F.col("label"), F.col("text"))).first()[0] == sha256(b"32\x1fa text").hexdigest()[:32]
