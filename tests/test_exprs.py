import pytest
from pyspark.sql import functions as F

from gridstats import functions as g


def one(spark, column, **values):
    schema = ", ".join(
        f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()
    )
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, expected",
    [("12", 12), (" 12 ", 12), ("12.0", 12), ("12.5", None), ("x", None), ("", None), (r"\N", None), (None, None),
     ("9007199254740993", 9007199254740993)],
)
def test_to_whole(spark, text, expected):
    assert one(spark, g.to_whole("t"), t=text) == expected


@pytest.mark.parametrize(
    "parser, text, seconds",
    [
        (g.lap_time, "1:26.572", 86.572),
        (g.lap_time, "1:02:03.4", None),
        (g.lap_time, "fast", None),
        (g.result_time, "+5.478", 5.478),
        (g.result_time, "1:34:50.616", 5690.616),
        (g.result_time, "25:38.426", None),
        (g.result_time, "+1 Lap", None),
        (g.result_time, "+1:02.3", None),
        (g.result_time, None, None),
        (g.sprint_time, "25:38.426", 1538.426),
        (g.sprint_time, "+1.430", 1.43),
        (g.fastest_lap_time, "1:18.5", 78.5),
        (g.fastest_lap_time, "1:01:18.5", 3678.5),
    ],
)
def test_durations(spark, parser, text, seconds):
    assert one(spark, g.seconds_of(parser("t")), t=text) == seconds


@pytest.mark.parametrize(
    "text, expected", [("14:05:09", "14:05:09"), ("25:00:00", None), ("noon", None), (None, None)]
)
def test_clock_time(spark, text, expected):
    assert one(spark, g.clock_time("t"), t=text) == expected


def test_days(spark):
    assert str(one(spark, g.to_day("t"), t="1985-01-07")) == "1985-01-07"
    assert one(spark, g.to_day("t"), t="1985-13-07") is None


def test_ratio_and_clip_keep_null(spark):
    assert one(spark, g.ratio("a", "b"), a=1.0, b=0.0) is None
    assert one(spark, g.ratio("a", "b"), a=1.0, b=4.0) == 0.25
    assert one(spark, g.clip(F.col("a"), 0.0, 5.0), a=9.0) == 5.0
    assert one(spark, g.clip(F.lit(None).cast("double"), 0.0, 5.0), a=9.0) is None


@pytest.mark.parametrize("value, digits, expected", [(0.125, 2, 0.12), (0.375, 2, 0.38), (139.075, 2, 139.07), (2.5, 0, 2.0)])
def test_half_even(spark, value, digits, expected):
    assert one(spark, g.half_even(F.col("a"), digits), a=value) == expected


def test_pearson_is_null_without_variance_or_pairs(spark):
    df = spark.createDataFrame(
        [("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("one", 1.0, 2.0), ("one", 4.0, None), ("line", 1.0, 2.0), ("line", 2.0, 4.0), ("line", None, 9.0)],
        "k string, x double, y double",
    )
    found = {r["k"]: r["c"] for r in df.groupBy("k").agg(g.pearson("x", "y").alias("c")).collect()}
    assert found["flat"] is None and found["one"] is None
    assert found["line"] == pytest.approx(1.0)


def test_top_k_breaks_ties_and_puts_nulls_last(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, None), (4, 2.0)], "id int, v double")
    assert [r["id"] for r in g.top_k(df, None, "v", "id").collect()] == [4, 1, 3, 2]
    assert [r["id"] for r in g.top_k(df, 3, "v", "id", ascending=True).collect()] == [1, 3, 4]


def test_calendar(spark):
    row = spark.sql("SELECT 1997 AS year, DATE'1970-06-30' AS dob")
    found = row.select(g.decade("year").alias("d"), g.age_at_year_end("year", "dob").alias("a")).first()
    assert found["d"] == 1990
    assert found["a"] == pytest.approx(10046 / 365.25)
