"""A13 drivers and circuits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstats.functions import clip, half_even, top_k
from gridstats.operators.grids import SparseMatrix
from gridstats.operators.quantiles import box_stats


def driver_circuits(df: DataFrame, min_races: int = 3) -> DataFrame:
    """Results per driver and circuit with a score; lower is better.

    Without a deviation there is no score.
    """
    keyed = df.where(F.col("driverId").isNotNull() & F.col("circuitId").isNotNull())
    stats = (
        keyed.groupBy("driverId", "circuitId")
        .agg(
            half_even(F.avg("position"), 2).alias("avg_position"),
            half_even(F.stddev_samp("position"), 2).alias("position_std"),
            F.count("position").alias("races"),
            half_even(F.avg("points"), 2).alias("avg_points"),
        )
        .where(F.col("races") >= min_races)
    )
    return stats.withColumn(
        "performance_score", F.col("avg_position") * 0.6 + F.col("position_std") * 0.4
    )


def worst_combinations(df: DataFrame, n: int | None = 5) -> DataFrame:
    return top_k(driver_circuits(df), n, "performance_score", "driverId", "circuitId")


def best_combinations(df: DataFrame, n: int | None = 5) -> DataFrame:
    return top_k(driver_circuits(df), n, "performance_score", "driverId", "circuitId", ascending=True)


def circuit_difficulty(df: DataFrame, n: int | None = 3) -> DataFrame:
    """Circuits by mean finish."""
    means = (
        df.where(F.col("circuitId").isNotNull())
        .groupBy("circuitId")
        .agg(F.avg("position").alias("avg_position"))
    )
    return top_k(means, n, "avg_position", "circuitId")


def driver_profile(df: DataFrame, driver: str) -> DataFrame:
    """One driver at every circuit: nine figures and a score; lower is better."""
    rows = df.where((F.col("driverRef") == driver) & F.col("circuitId").isNotNull())
    stats = rows.groupBy("circuitId", F.col("circuitRef").alias("circuit_name")).agg(
        half_even(F.avg("position"), 2).alias("avg_position"),
        half_even(F.coalesce(F.stddev_samp("position"), F.lit(0.0)), 2).alias("position_std"),
        F.count("position").alias("races"),
        F.min("position").alias("best_finish"),
        F.max("position").alias("worst_finish"),
        half_even(F.coalesce(F.avg("points"), F.lit(0.0)), 2).alias("avg_points"),
        half_even(F.coalesce(F.sum("points"), F.lit(0.0)), 2).alias("total_points"),
        half_even(F.avg("grid"), 2).alias("avg_grid"),
        F.min("grid").alias("best_grid"),
    )
    score = (
        F.col("avg_position") * 0.4
        + F.col("position_std") * 0.2
        + (20 - F.col("avg_points")) * 0.3
        + F.col("avg_grid") * 0.1
    )
    return stats.withColumn("performance_score", clip(score, lower=0.0))


def driver_best(df: DataFrame, driver: str, n: int = 3) -> DataFrame:
    """The n best circuits; a circuit without a score comes last."""
    return top_k(driver_profile(df, driver), n, "performance_score", "circuitId", ascending=True)


def driver_worst(df: DataFrame, driver: str, n: int = 3) -> DataFrame:
    """The n worst circuits; a circuit without a score comes last."""
    return top_k(driver_profile(df, driver), n, "performance_score", "circuitId")


def driver_summary(df: DataFrame, driver: str) -> DataFrame:
    """Mean of the circuit means, circuits raced, strongest and weakest circuit."""
    score = F.round("performance_score", 9)
    named = F.struct(score, F.col("circuitId").alias("id"), F.col("circuit_name").alias("name"))
    last = F.struct(score, (-F.col("circuitId")).alias("id"), F.col("circuit_name").alias("name"))
    present = F.col("performance_score").isNotNull()
    return driver_profile(df, driver).agg(
        F.avg("avg_position").alias("avg_finish"),
        F.count(F.lit(1)).alias("circuits"),
        F.min(F.when(present, named)).getField("name").alias("strongest"),
        F.max(F.when(present, last)).getField("name").alias("weakest"),
    )


def points_box(df: DataFrame, driver: str) -> DataFrame:
    """Box statistics of a driver's points per circuit."""
    return box_stats(df.where(F.col("driverRef") == driver), ["circuitRef"], "points")


def selected_grid_points(df: DataFrame, driver: str, n: int = 3) -> DataFrame:
    """Grid and finish of a driver at the n best and n worst circuits."""
    chosen = driver_best(df, driver, n).unionByName(driver_worst(df, driver, n)).select("circuitId")
    rows = df.where(F.col("driverRef") == driver)
    return rows.join(chosen, "circuitId", "left_semi").select(
        "resultId", "circuitRef", "grid", "position"
    )


def circuit_wins(df: DataFrame) -> SparseMatrix:
    """Wins by driver and circuit, for all drivers and circuits of the results; most combinations have none."""
    keyed = df.where(F.col("driverId").isNotNull() & F.col("circuitId").isNotNull())
    won = keyed.where(F.col("position") == 1)
    cells = won.groupBy("driverId", "circuitId").agg(F.count(F.lit(1)).cast("double").alias("wins"))
    drivers, circuits = keyed.select("driverId").distinct(), keyed.select("circuitId").distinct()
    return SparseMatrix(cells, "driverId", "circuitId", "wins", drivers, circuits)
