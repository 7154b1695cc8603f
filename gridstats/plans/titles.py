"""A14 title retention, A15 ages of winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W, WindowSpec
from pyspark.sql import functions as F

from gridstats.functions import age_at_year_end, decade, half_even, top_k
from gridstats.operators.quantiles import quantiles, value_counts
from gridstats.plans.eda import histogram
from gridstats.plans.performance import regression, won
from gridstats.plans.scoring import latest_year


def _by_year() -> WindowSpec:
    """Order of seasons; used on frames with one row per season, so it stays small."""
    return W.orderBy("year")


# --- A14 -------------------------------------------------------------------


def champions(df: DataFrame) -> DataFrame:
    """The driver with most race points per season; the lower id on a tie."""
    points = (
        df.where(F.col("year").isNotNull() & F.col("driverId").isNotNull())
        .groupBy("year", "driverId", "driverRef")
        .agg(F.coalesce(F.sum("points"), F.lit(0.0)).alias("points"))
    )
    leader = F.max(F.struct("points", (-F.col("driverId")).alias("minus_id"), "driverRef"))
    return (
        points.groupBy("year")
        .agg(leader.alias("lead"))
        .select(
            "year",
            (-F.col("lead.minus_id")).alias("driverId"),
            "lead.driverRef",
            "lead.points",
        )
    )


def _followed(df: DataFrame) -> DataFrame:
    """Champions with the next season's row beside them."""
    return champions(df).withColumns(
        {"next_year": F.lead("year").over(_by_year()), "next_driver": F.lead("driverId").over(_by_year())}
    )


def _kept_next_year() -> Column:
    return F.coalesce(
        (F.col("next_year") == F.col("year") + 1) & (F.col("next_driver") == F.col("driverId")),
        F.lit(False),
    )


def back_to_back(df: DataFrame) -> DataFrame:
    return _followed(df).where(_kept_next_year()).select("year", "driverRef")


def retention_calendar(df: DataFrame, recent_years: int = 10) -> DataFrame:
    """Share of all seasons whose champion also won the next calendar year."""
    kept = _kept_next_year().cast("double")
    recent = F.col("year") >= champions(df).agg(F.max("year")).scalar() - recent_years
    return _followed(df).agg(
        F.avg(kept).alias("retention_rate"),
        F.avg(F.when(recent, kept)).alias("recent_rate"),
    )


def retention_flags(df: DataFrame) -> DataFrame:
    """Every season but the last: did the same driver win the next one raced?"""
    followed = _followed(df).where(F.col("next_year").isNotNull())
    return followed.select("year", (F.col("driverId") == F.col("next_driver")).alias("retained"))


def retention_consecutive(df: DataFrame) -> DataFrame:
    kept = F.col("retained").cast("int")
    return retention_flags(df).agg(
        F.coalesce(F.sum(kept), F.lit(0)).alias("retained"),
        F.count(F.lit(1)).alias("transitions"),
        F.coalesce(F.avg(kept), F.lit(0.0)).alias("retention_rate"),
    )


def longest_streak(df: DataFrame) -> DataFrame:
    """Longest run of titles; the first run of that length, no holder for a run of 1."""
    changed = F.col("driverId") != F.lag("driverId", 1, -1).over(_by_year())
    runs = (
        champions(df)
        .withColumn("changed", changed.cast("int"))
        .withColumn("run", F.sum("changed").over(_by_year()))
        .groupBy("run")
        .agg(F.count(F.lit(1)).alias("streak"), F.min("driverRef").alias("driverRef"))
    )
    best = top_k(runs, 1, "streak", "run")
    return best.select(
        F.col("streak").alias("longest_streak"),
        F.when(F.col("streak") > 1, F.col("driverRef")).alias("streak_holder"),
    )


def recent_titles(df: DataFrame, recent_years: int = 10) -> DataFrame:
    winners = champions(df)
    recent = winners.where(F.col("year") >= winners.agg(F.max("year")).scalar() - recent_years)
    return recent.where(F.col("driverRef").isNotNull()).groupBy("driverRef").agg(
        F.count(F.lit(1)).alias("titles")
    )


def outlook(df: DataFrame, last: int = 5) -> DataFrame:
    """Current champion, overall rate, rate of the last transitions, and the larger."""
    flags = retention_flags(df).withColumns(
        {"back": F.row_number().over(W.orderBy(F.col("year").desc())), "kept": F.col("retained").cast("int")}
    )
    recent = F.coalesce(F.sum(F.when(F.col("back") <= last, F.col("kept"))), F.lit(0)) / last
    current = champions(df).agg(F.max_by("driverRef", "year")).scalar()
    rates = flags.agg(
        F.coalesce(F.avg("kept"), F.lit(0.0)).alias("retention_rate"), recent.alias("recent_rate")
    )
    return rates.withColumns(
        {"probability": F.greatest("retention_rate", "recent_rate"), "current_champion": current}
    )


# --- A15 -------------------------------------------------------------------


def ages_by_year(df: DataFrame, low: int = 18, high: int = 60) -> DataFrame:
    """One row per race won: season minus birth year, within plausible ages."""
    age = F.col("year") - F.year("dob")
    return df.where(won()).select("resultId", "year", age.alias("age")).where(F.col("age").between(low, high))


def ages_by_days(df: DataFrame, low: int = 18, high: int = 60) -> DataFrame:
    """One row per race won: age in years on the last day of the season."""
    age = age_at_year_end("year", "dob")
    return df.where(won()).select("resultId", "year", age.alias("age")).where(F.col("age").between(low, high))


def age_year_summary(df: DataFrame) -> DataFrame:
    return ages_by_year(df).agg(
        F.avg("age").alias("average"), F.min("age").alias("youngest"), F.max("age").alias("oldest")
    )


def age_days_summary(df: DataFrame) -> DataFrame:
    ages = ages_by_days(df)
    median = quantiles(value_counts(ages, [], "age"), [], {"median": 0.5}).select("median").scalar()
    return ages.agg(
        F.avg("age").alias("average"),
        F.min("age").alias("youngest"),
        F.max("age").alias("oldest"),
        F.stddev_samp("age").alias("std"),
    ).withColumn("median", median)


def age_decades(df: DataFrame) -> DataFrame:
    return (
        ages_by_days(df)
        .groupBy(decade("year").alias("decade"))
        .agg(
            half_even(F.avg("age"), 1).alias("average"),
            half_even(F.min("age"), 1).alias("youngest"),
            half_even(F.max("age"), 1).alias("oldest"),
            F.count("age").alias("champions"),
        )
    )


def age_trend(df: DataFrame) -> DataFrame:
    return regression(ages_by_days(df), "year", "age")


def age_trend_by_year(df: DataFrame) -> DataFrame:
    return regression(ages_by_year(df), "year", "age")


def age_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(ages_by_days(df), "age", bins)


def age_recent(df: DataFrame, recent_years: int = 10) -> DataFrame:
    """Mean age of the last seasons against the overall mean."""
    ages = ages_by_days(df)
    recent = F.col("year") >= latest_year(ages) - recent_years
    means = ages.agg(
        F.avg(F.when(recent, F.col("age"))).alias("recent_average"), F.avg("age").alias("average")
    )
    younger = F.round("recent_average", 9) < F.round("average", 9)
    return means.withColumn("trend", F.when(younger, "Younger").otherwise("Older"))
