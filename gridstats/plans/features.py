"""Feature tables: driver, team and circuit figures, and the season forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstats.functions import is_true, ratio
from gridstats.operators.sequences import earlier_rows, shifted
from gridstats.plans.performance import on_podium, won
from gridstats.sources.files import keep


def driver_finish(df: DataFrame) -> DataFrame:
    """Mean and deviation of the finishing order per driver."""
    return df.where(F.col("driverId").isNotNull()).groupBy("driverId").agg(
        F.avg("positionOrder").alias("avg_finishing_position"),
        F.stddev_samp("positionOrder").alias("std_finishing_position"),
    )


def driver_qualifying(qualifying: DataFrame) -> DataFrame:
    return qualifying.where(F.col("driverId").isNotNull()).groupBy("driverId").agg(
        F.avg("position").alias("avg_qualifying_position")
    )


def team_points(df: DataFrame) -> DataFrame:
    """Points per season, averaged over a constructor's seasons."""
    yearly = df.dropna(subset=["constructorId", "year"]).groupBy("constructorId", "year").agg(
        F.coalesce(F.sum("points"), F.lit(0.0)).alias("points")
    )
    return yearly.groupBy("constructorId").agg(F.avg("points").alias("avg_constructor_points"))


def team_dnf(df: DataFrame) -> DataFrame:
    """Share of entries whose status says they did not finish; NULL if there is none."""
    retired = is_true(F.lower("status").contains("did not finish"))
    return df.where(F.col("constructorId").isNotNull()).groupBy("constructorId").agg(
        ratio(F.nullif(F.count_if(retired), F.lit(0)), F.count(F.lit(1))).alias("constructor_dnf_rate")
    )


def circuit_spread(df: DataFrame) -> DataFrame:
    """Deviation of the finishing order per race, averaged per circuit."""
    races = df.dropna(subset=["raceId", "circuitId"]).groupBy("raceId", "circuitId").agg(
        F.stddev_samp("positionOrder").alias("spread")
    )
    return races.groupBy("circuitId").agg(F.avg("spread").alias("avg_position_change"))


FINISH_FEATURES = [
    "avg_finishing_position",
    "std_finishing_position",
    "avg_qualifying_position",
    "avg_constructor_points",
    "constructor_dnf_rate",
    "avg_position_change",
]


def engineered(df: DataFrame, qualifying: DataFrame) -> DataFrame:
    """Every entry with the six figures of its driver, team and circuit.

    The figures are kept, one row per key, so that the joins know how small they
    are: dealt by team or circuit, all entries would meet in a few tasks.
    """
    base = df.select("resultId", "raceId", "driverId", "constructorId", "circuitId", "positionOrder")
    drivers = keep(driver_finish(df).join(driver_qualifying(qualifying), "driverId", "full"))
    teams = keep(team_points(df).join(team_dnf(df), "constructorId", "full"))
    return (
        base.join(drivers, "driverId", "left")
        .join(teams, "constructorId", "left")
        .join(keep(circuit_spread(df)), "circuitId", "left")
    )


# --- season forecast -------------------------------------------------------

FORECAST_FEATURES = [
    "grid",
    "previous_season_points",
    "recent_form",
    "team_strength",
    "career_experience",
    "podium_finishes",
    "race_wins",
    "did_not_finish",
]


def forecast_rows(df: DataFrame, start: int = 2015, lagged_flags: bool = True) -> DataFrame:
    """Every entry since ``start`` with its forecast features.

    ``previous_season_points`` is the driver's previous entry, and
    ``recent_form`` the mean of the three entries before, NULL until there are
    three. The three outcome flags describe the entry before. With
    ``lagged_flags=False``, the published form, the flags and the last entry of
    the form are those of the same race as the target, which gives it away.
    """
    recent = df.where(F.col("year") >= start).select(
        "resultId", "raceId", "driverId", "driverRef", "constructorId",
        "year", "round", "grid", "position", "points",
    )
    flags = recent.withColumns(
        {
            "podium_finishes": is_true(on_podium()).cast("int"),
            "race_wins": is_true(won()).cast("int"),
            "did_not_finish": F.col("position").isNull().cast("int"),
        }
    )
    strength = (
        flags.dropna(subset=["year", "constructorId"])
        .groupBy("year", "constructorId")
        .agg(F.avg("points").alias("p"), F.avg("podium_finishes").alias("r"), F.avg("race_wins").alias("w"))
    )
    parts = F.array_compact(F.array("p", "r", "w"))
    mean = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)
    strength = strength.select("year", "constructorId", mean.alias("team_strength"))

    order = ["round", "resultId"]
    back = {f"_p{k}": ("points", k) for k in (1, 2, 3)}
    if lagged_flags:
        back |= {f"_{c}": (c, 1) for c in ("podium_finishes", "race_wins", "did_not_finish")}
    run = shifted(flags, "driverId", "year", order, back, row="row")
    if lagged_flags:
        run = run.withColumns({c: F.col(f"_{c}") for c in ("podium_finishes", "race_wins", "did_not_finish")})
    form = ["_p1", "_p2", "_p3"] if lagged_flags else ["points", "_p1", "_p2"]
    run = run.withColumns(
        {
            "previous_season_points": F.col("_p1"),
            "recent_form": (F.col(form[0]) + F.col(form[1]) + F.col(form[2])) / 3,
        }
    ).drop(*[c for c in run.columns if c.startswith("_")])
    return (
        run.join(earlier_rows(recent, ["driverId"], "year"), ["driverId", "year"])
        .withColumn("career_experience", F.col("row") + F.col("_before") - 1)
        .drop("row", "_before")
        .join(strength, ["year", "constructorId"])
    )


def forecast_training(rows: DataFrame) -> DataFrame:
    return rows.dropna(subset=[*FORECAST_FEATURES, "points"])


def forecast_inputs(rows: DataFrame) -> DataFrame:
    """One row per driver of the last season, moved one step ahead.

    Taken from the driver's first entry of that season: its points become the
    previous points and the experience grows by one.
    """
    last = rows.agg(F.max("year")).scalar()
    carried = ["driverRef", "points", *[c for c in FORECAST_FEATURES if c != "previous_season_points"]]
    first = F.min(F.struct("round", "resultId", *[F.col(c).alias(c) for c in carried]))
    start = rows.where(F.col("year") == last).groupBy("driverId").agg(first.alias("f"))
    entry = start.select("driverId", *[F.col(f"f.{c}").alias(c) for c in carried])
    return entry.withColumns(
        {
            "previous_season_points": F.col("points"),
            "career_experience": F.col("career_experience") + 1,
            "current_points": F.col("points"),
        }
    ).drop("points")
