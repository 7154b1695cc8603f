"""A1 driver and constructor performance, A2 grid against finish, A3 pit stops.

Every function takes the race-results master (one row per race and driver) and
returns a lazy frame. ``position`` is NULL for an entry that did not finish. An
id has one name, so names are grouping keys: a minimum over text would sort all
rows before the aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstats.functions import count_where, pearson, ratio, top_k


def won() -> Column:
    return F.col("position") == 1


def on_podium() -> Column:
    return F.col("position") <= 3


def driver_win_ratio(df: DataFrame, n: int | None = 5, by: str = "position") -> DataFrame:
    """Share of a driver's entries won, 0 if none."""
    shares = (
        df.where(F.col("driverId").isNotNull())
        .groupBy("driverId", "driverRef")
        .agg(
            ratio(count_where(F.col(by) == 1), F.count(F.lit(1))).alias("win_ratio"),
        )
    )
    return top_k(shares, n, "win_ratio", "driverId")


def constructor_wins(df: DataFrame, n: int | None = 5) -> DataFrame:
    """Wins per constructor; constructors without a win are absent."""
    wins = (
        df.where(won() & F.col("constructorId").isNotNull())
        .groupBy("constructorId", "constructorRef")
        .agg(F.count(F.lit(1)).alias("wins"))
    )
    return top_k(wins, n, "wins", "constructorId")


def driver_totals(df: DataFrame) -> DataFrame:
    """Podiums, points and entries per driver."""
    return (
        df.where(F.col("driverId").isNotNull())
        .groupBy("driverId")
        .agg(
            count_where(F.col("position").isin(1, 2, 3)).alias("podiums"),
            F.coalesce(F.sum("points"), F.lit(0.0)).alias("points"),
            F.count(F.lit(1)).alias("races"),
        )
    )


def constructor_podiums(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("position").isin(1, 2, 3) & F.col("constructorId").isNotNull())
        .groupBy("constructorId")
        .agg(F.count(F.lit(1)).alias("podiums"))
    )


def position_gain(df: DataFrame, n: int | None = 5) -> DataFrame:
    """Mean of grid minus finish per driver; entries without a finish are skipped."""
    gains = (
        df.where(F.col("driverId").isNotNull())
        .groupBy("driverId", "driverRef")
        .agg(
            F.avg(F.col("grid") - F.col("position")).alias("position_gain"),
        )
    )
    return top_k(gains, n, "position_gain", "driverId")


def grid_points(df: DataFrame, driver: str) -> DataFrame:
    """Grid and finish of every entry, those of one driver marked."""
    return df.select(
        "resultId",
        "driverRef",
        "grid",
        "position",
        "points",
        F.coalesce(F.col("driverRef") == driver, F.lit(False)).alias("selected"),
    )


def pit_totals(pits: DataFrame) -> DataFrame:
    """Stops and their mean duration per race and driver. Totals are returned as they are.

    The functions below take stops or their totals; totals that are dealt like
    the entries (``keep_bucketed``) meet them without a shuffle.
    """
    if "pit_stops" in pits.columns:
        return pits
    keyed = pits.where(F.col("raceId").isNotNull() & F.col("driverId").isNotNull())
    counts = [F.count(F.lit(1)).alias("pit_stops")]
    if "duration" in pits.columns:
        counts.append(F.avg("duration").alias("duration"))
    return keyed.groupBy("raceId", "driverId").agg(*counts)


def pit_counts(pits: DataFrame) -> DataFrame:
    """Stops per race and driver."""
    return pit_totals(pits).select("raceId", "driverId", "pit_stops")


def with_pit_counts(df: DataFrame, pits: DataFrame) -> DataFrame:
    """Every entry with its number of stops, 0 if none is recorded."""
    entries = df.select("raceId", "driverId", "position", "positionOrder")
    return entries.join(pit_counts(pits), ["raceId", "driverId"], "left").fillna(0, ["pit_stops"])


def _in_range(entries: DataFrame, low: int | None, high: int | None) -> DataFrame:
    kept = entries.where(F.col("position").isNotNull())
    if low is not None:
        kept = kept.where(F.col("position") >= low)
    if high is not None:
        kept = kept.where(F.col("position") <= high)
    return kept


def pit_corr_filled(df: DataFrame, pits: DataFrame) -> DataFrame:
    """Correlation of stops and finish with every null as 0, so a retirement counts as 0."""
    entries = with_pit_counts(df, pits).fillna(0, ["position"])
    return entries.agg(pearson("pit_stops", "position").alias("correlation"))


def pit_corr(df: DataFrame, pits: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Correlation of stops and finish over a range of finishes, with its labels."""
    entries = _in_range(with_pit_counts(df, pits), low, high)
    size = F.abs("correlation")
    return (
        entries.agg(pearson("pit_stops", "position").alias("correlation"))
        .withColumn("sign", F.when(F.col("correlation") > 0, "positive").otherwise("negative"))
        .withColumn("strength", F.when(size < 0.3, "weak").when(size < 0.7, "moderate").otherwise("strong"))
    )


def pits_by_position(
    df: DataFrame, pits: DataFrame, low: int | None = None, high: int | None = None
) -> DataFrame:
    """Mean stops per finish; entries without a finish are left out."""
    entries = _in_range(with_pit_counts(df, pits), low, high)
    return entries.groupBy("position").agg(F.avg("pit_stops").alias("pit_stops"))


def pits_by_position_filled(df: DataFrame, pits: DataFrame) -> DataFrame:
    """Mean stops per finish, with a group 0 for entries without one."""
    entries = with_pit_counts(df, pits).fillna(0, ["position"])
    return entries.groupBy("position").agg(F.avg("pit_stops").alias("pit_stops"))


def pit_trend(df: DataFrame, pits: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Least-squares line of stops on finish."""
    return regression(_in_range(with_pit_counts(df, pits), low, high), "position", "pit_stops")


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """Line of y on x: slope, intercept and r2, NULL without variance in x."""
    return df.agg(
        F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"),
        F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("intercept"),
        F.regr_r2(F.col(y).cast("double"), F.col(x).cast("double")).alias("r2"),
    )


def pit_duration(df: DataFrame, pits: DataFrame) -> DataFrame:
    """Finishing order of every entry with its mean stop duration."""
    mean = pit_totals(pits).select("raceId", "driverId", "duration")
    return df.select("raceId", "driverId", "positionOrder").join(mean, ["raceId", "driverId"], "left")
