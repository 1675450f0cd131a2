"""Table functions in SQL."""

import pytest

from murmuration.functions import tables


def test_grams_beside_their_rows(spark):
    tables.register(spark)
    df = spark.createDataFrame([(1, "a b  c"), (2, None), (3, " ")], "id int, text string")
    got = spark.sql("SELECT t.id, g.* FROM {t} t, LATERAL word_grams(t.text, 2) g ORDER BY pos, n", t=df)
    assert got.columns == ["id", "pos", "n", "gram", "w1", "w2"]
    assert [tuple(r) for r in got.collect()] == [(1, 0, 1, "a", "a", None), (1, 0, 2, "a b", "a", "b"), (1, 1, 1, "b", "b", None), (1, 1, 2, "b c", "b", "c"), (1, 2, 1, "c", "c", None)]
    with pytest.raises(Exception, match="whole number"):
        spark.sql("SELECT * FROM word_grams('a', 0)").collect()


def test_windows_of_a_partitioned_table(spark):
    tables.register(spark)
    df = spark.createDataFrame([("x", i, f"w{i}") for i in (3, 1, 2, 0)] + [("y", 0, "z"), ("u", 0, None), ("u", 1, "v")], "who string, pos int, text string").repartition(3)
    got = spark.sql("SELECT * FROM word_windows(TABLE({t}), 2, 'who')", t=df)
    assert sorted(map(tuple, got.collect())) == [("u", 0, 1, " v"), ("x", 0, 1, "w0 w1"), ("x", 1, 2, "w1 w2"), ("x", 2, 3, "w2 w3")]
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM word_windows(TABLE({t}), 2)", t=df).collect()
