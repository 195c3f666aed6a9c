import pytest

from ripplegraph.functions.keyed import unit, unit_of, wrapping


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_native_equals_plain_integers(spark, ansi):
    rows = [(777, 0, 0, 0), (12345, -1, 0, 3), (4294967295, 999_999, 119, 40), (1, 2**31 - 1, 1, 0)]
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with wrapping(spark):
            df = spark.createDataFrame(rows, "s long, n long, d long, c long").select("s", "n", "d", "c", unit("s", "n", "d", "c").alias("u"))
        for s, n, d, c, u in df.collect():
            assert u == unit_of(s, n, d, c)
            assert 0 <= u < 1
        assert spark.conf.get("spark.sql.ansi.enabled") == ansi
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
