"""A16 the next team of a driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstats.functions import ratio, top_k
from gridstats.operators.quantiles import median_of


def history(df: DataFrame, driver: str) -> DataFrame:
    """Points, mean and best finish and entries per season and team."""
    rows = df.where((F.col("driverRef") == driver) & F.col("constructorRef").isNotNull())
    return rows.groupBy("year", "constructorRef").agg(
        F.coalesce(F.sum("points"), F.lit(0.0)).alias("points"),
        F.avg("position").alias("avg_position"),
        F.min("position").alias("best_position"),
        F.count("raceId").alias("races"),
    )


def _trend(line: DataFrame, *order: str) -> Column:
    """Mean of the last three relative changes of ``points`` along a driver's line.

    The line has one row per season (and team) of one driver: a short frame.
    """
    along = W.orderBy(*order)
    back = W.orderBy(*[F.col(c).desc() for c in order])
    changes = line.withColumns(
        {
            "change": F.try_divide("points", F.lag("points").over(along)) - 1,
            "back": F.row_number().over(back),
        }
    )
    return changes.where(F.col("back") <= 3).agg(F.avg("change")).scalar()


def _team_totals(df: DataFrame, year: Column) -> DataFrame:
    """Points of every team in one season."""
    season = df.where((F.col("year") == year) & F.col("constructorRef").isNotNull())
    return season.groupBy("constructorRef").agg(
        F.coalesce(F.sum("points"), F.lit(0.0)).alias("points")
    )


def outlook_rows(df: DataFrame, driver: str) -> DataFrame:
    """Likelihood of a move from the season-and-team rows.

    The current team is the alphabetically first one of the last season.
    """
    rows = history(df, driver)
    current = F.min(F.struct((-F.col("year")).alias("minus_year"), "constructorRef", "points"))
    facts = rows.agg(
        current.alias("current"),
        F.count_distinct("constructorRef").alias("teams"),
        (F.max("year") - F.min("year")).alias("years_active"),
    ).where(F.col("teams") > 0)
    per_team = ratio("years_active", "teams")
    table = facts.select(
        F.col("current.constructorRef").alias("current_team"),
        (-F.col("current.minus_year")).alias("latest_year"),
        F.col("current.points").alias("current_points"),
        "teams",
        per_team.alias("avg_years_per_team"),
        _trend(rows, "year", "constructorRef").alias("recent_trend"),
    )
    falling = F.coalesce(F.round("recent_trend", 9) < 0, F.lit(False))
    high = (falling & (F.col("avg_years_per_team") < 3)) | (F.col("avg_years_per_team") >= 4)
    return table.withColumns(
        {
            "direction": F.when(F.round("recent_trend", 9) > 0, "Improving").otherwise("Declining"),
            "likelihood": F.when(high, "High").otherwise("Low"),
        }
    )


def outlook_years(df: DataFrame, driver: str) -> DataFrame:
    """Likelihood of a move from yearly totals.

    The current team is the one with most points in the last season. The rule
    compares ``races_at_current`` with the mean number of seasons per team;
    ``years_at_current`` is the count one would expect there.
    """
    rows = df.where((F.col("driverRef") == driver) & F.col("year").isNotNull())
    teams = history(df, driver)
    last = rows.agg(F.max("year")).scalar()
    season = teams.where(F.col("year") == last).select(
        "constructorRef", "points", F.rank().over(W.orderBy(F.col("points").desc(), "constructorRef")).alias("place")
    )
    current = season.where(F.col("place") == 1).select("constructorRef").scalar()
    years = rows.groupBy("year").agg(F.coalesce(F.sum("points"), F.lit(0.0)).alias("points"))
    spans = teams.groupBy("constructorRef").agg(F.count_distinct("year").alias("years"))
    totals = _team_totals(df, last)
    here = F.col("constructorRef") == current
    table = (
        teams.agg(
            F.max("year").alias("latest_year"),
            F.coalesce(F.sum(F.when(here, F.col("races"))), F.lit(0)).alias("races_at_current"),
            F.count_distinct(F.when(here, F.col("year"))).alias("years_at_current"),
        )
        .where(F.col("latest_year").isNotNull())
        .withColumns(
            {
                "current_team": current,
                "current_points": years.where(F.col("year") == last).select("points").scalar(),
                "recent_trend": _trend(years, "year"),
                "avg_team_duration": spans.agg(F.avg("years")).scalar(),
                "median_team_points": median_of(totals, "points"),
            }
        )
    )
    high = (
        F.coalesce(F.round("recent_trend", 9) < -0.1, F.lit(False))
        | (F.col("races_at_current") > F.col("avg_team_duration"))
        | (F.col("current_points") < F.col("median_team_points"))
    )
    return table.withColumn("likelihood", F.when(high, "High").otherwise("Low"))


def _better_teams(df: DataFrame, facts: DataFrame) -> DataFrame:
    """Teams of the last season with more points than the driver."""
    year = facts.select("latest_year").scalar()
    points = facts.select("current_points").scalar()
    return _team_totals(df, year).where(F.col("points") > points)


def candidates_by_name(df: DataFrame, driver: str, n: int = 3) -> DataFrame:
    """The first teams by name, only if a move is likely."""
    facts = outlook_rows(df, driver)
    likely = facts.select("likelihood").scalar()
    better = _better_teams(df, facts).where(likely == "High")
    return better.orderBy("constructorRef").limit(n)


def candidates_by_points(df: DataFrame, driver: str, n: int = 3) -> DataFrame:
    """The teams with most points."""
    rows = df.where((F.col("driverRef") == driver) & F.col("year").isNotNull())
    season = rows.groupBy(F.col("year").alias("latest_year")).agg(
        F.coalesce(F.sum("points"), F.lit(0.0)).alias("current_points")
    )
    facts = season.where(F.col("latest_year") == rows.agg(F.max("year")).scalar())
    return top_k(_better_teams(df, facts), n, "points", "constructorRef")


def by_team(df: DataFrame, driver: str) -> DataFrame:
    """Seasons and mean points per team."""
    rows = df.where((F.col("driverRef") == driver) & F.col("constructorRef").isNotNull())
    return rows.groupBy("constructorRef").agg(
        F.count_distinct("year").alias("years"), F.avg("points").alias("avg_points")
    )


def by_year(df: DataFrame, driver: str) -> DataFrame:
    """Mean points per season."""
    return df.where(F.col("driverRef") == driver).groupBy("year").agg(F.avg("points").alias("avg_points"))
