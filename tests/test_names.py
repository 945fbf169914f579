"""Working columns never meet an input's columns."""

from siltstone.names import column, fresh


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`__x` int, `__X_` int, `a.b``c` int")
    assert fresh(df, "__x") == "__x__" and fresh(df, "y") == "y"
    assert df.select(column("a.b`c")).first()[0] == 3
