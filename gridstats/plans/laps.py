"""A9 lap efficiency. Takes the race-results and the lap-times master."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstats.functions import ratio, top_k
from gridstats.operators.grids import SparseMatrix, dense_grid
from gridstats.operators.quantiles import box_stats
from gridstats.sources import keep


def lap_totals(laps: DataFrame) -> DataFrame:
    """Lap totals per circuit, race and driver. Totals are returned as they are.

    The functions of this module take laps or their totals; totals that are
    dealt like the results (``keep_bucketed``) meet them without a shuffle.
    """
    if "total_ms" in laps.columns:
        return laps
    return laps.groupBy("circuitId", "raceId", "driverId").agg(
        F.sum("milliseconds").alias("total_ms"),
        F.count("milliseconds").alias("laps"),
        F.min("milliseconds").alias("fastest_ms"),
    )


def _driven_laps(df: DataFrame, laps: DataFrame) -> DataFrame:
    """Lap totals per circuit, race, driver and constructor.

    Laps are summed per race and driver before they meet the results. A driver
    with two results in a race counts every lap twice, as the plain join does.
    """
    return lap_totals(laps).join(df.select("raceId", "driverId", "constructorId"), ["raceId", "driverId"])


def average_laps(df: DataFrame, laps: DataFrame) -> DataFrame:
    """Mean lap time per circuit, driver and constructor."""
    return _averages(_driven_laps(df, laps))


def _averages(driven: DataFrame) -> DataFrame:
    keyed = driven.where(F.col("circuitId").isNotNull() & F.col("constructorId").isNotNull())
    return keyed.groupBy("circuitId", "driverId", "constructorId").agg(
        ratio(F.sum("total_ms"), F.sum("laps")).alias("avg_ms")
    )


def efficiency(df: DataFrame, laps: DataFrame) -> DataFrame:
    """Fastest lap of the circuit over the mean lap of each driver and team."""
    driven = _driven_laps(df, laps)
    fastest = driven.groupBy("circuitId").agg(F.min("fastest_ms").alias("fastest_ms"))
    return (
        _averages(driven)
        .join(fastest, "circuitId")
        .withColumn("efficiency_ratio", ratio("fastest_ms", "avg_ms"))
    )


def _mean_efficiency(
    df: DataFrame, laps: DataFrame, key: str, name: str, n: int | None, names: DataFrame | None
) -> DataFrame:
    means = efficiency(df, laps).groupBy(key).agg(F.avg("efficiency_ratio").alias("efficiency_ratio"))
    best = top_k(means, n, "efficiency_ratio", key)  # names are looked up for these only
    named = df if names is None else names
    found = named.select(key, name).join(best.select(key), key, "left_semi").distinct()
    return top_k(best.join(found, key, "left"), None, "efficiency_ratio", key)


def team_efficiency(
    df: DataFrame, laps: DataFrame, n: int | None = 5, names: DataFrame | None = None
) -> DataFrame:
    """Teams by mean efficiency. ``names`` are results with the names, if ``df`` has none."""
    return _mean_efficiency(df, laps, "constructorId", "constructorRef", n, names)


def driver_efficiency(
    df: DataFrame, laps: DataFrame, n: int | None = 5, names: DataFrame | None = None
) -> DataFrame:
    """Drivers by mean efficiency. ``names`` are results with the names, if ``df`` has none."""
    return _mean_efficiency(df, laps, "driverId", "driverRef", n, names)


def team_circuits(df: DataFrame, laps: DataFrame) -> SparseMatrix:
    """Mean efficiency by team and circuit, 0 where the team never ran."""
    cells = (
        efficiency(df, laps)
        .groupBy("constructorId", "circuitId")
        .agg(F.avg("efficiency_ratio").alias("efficiency_ratio"))
    )
    return SparseMatrix.of(keep(cells), "constructorId", "circuitId", "efficiency_ratio")


def team_circuit_efficiency(df: DataFrame, laps: DataFrame) -> DataFrame:
    """Mean efficiency for every team and circuit, 0 where the team never ran. ``team_circuits`` is its sparse form."""
    matrix = team_circuits(df, laps)
    return dense_grid(matrix.cells, matrix.rows, matrix.columns, {"efficiency_ratio": 0.0})


def team_circuit_display(df: DataFrame, laps: DataFrame, teams: int = 5) -> DataFrame:
    """The rows shown in the chart: the first teams by id, not the best ones."""
    matrix = team_circuits(df, laps)
    return matrix.dense(matrix.rows.orderBy("constructorId").limit(teams))


def lap_box(df: DataFrame, laps: DataFrame) -> DataFrame:
    """Box statistics of the lap time per circuit.

    A lap counts once per result of its driver in the race; laps meet the few
    results and are then counted by circuit and time, partly before the shuffle.
    """
    results = df.groupBy("raceId", "driverId").agg(F.count(F.lit(1)).alias("results"))
    weighted = laps.join(results, ["raceId", "driverId"]).select("circuitId", "milliseconds", "results")
    return box_stats(weighted, ["circuitId"], "milliseconds", "results")
