"""A6 moves between teams, A7 team comparison, A8 driver consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstats.functions import count_where, half_even, ratio, top_k
from gridstats.operators.grids import SparseMatrix, dense_grid
from gridstats.operators.pairs import pair_sums
from gridstats.operators.quantiles import median_of
from gridstats.operators.sequences import shifted
from gridstats.plans.performance import on_podium
from gridstats.sources.files import keep


# --- A6 --------------------------------------------------------------------


def _steps(df: DataFrame) -> DataFrame:
    """Every pair of consecutive entries of a driver; ``year`` is the earlier one's."""
    rows = df.where(F.col("driverId").isNotNull()).select(
        "driverId", "driverRef", "constructorId", "constructorRef", "year", "round", "resultId"
    )
    ahead = {"to_id": ("constructorId", 1), "to_team": ("constructorRef", 1), "_next": ("resultId", 1)}
    paired = shifted(rows, "driverId", "year", ["round", "resultId"], ahead, ahead=True)
    return (
        paired.where(F.col("_next").isNotNull())
        .drop("_next")
        .withColumnsRenamed({"constructorId": "from_id", "constructorRef": "from_team"})
    )


def _edges(steps: DataFrame) -> DataFrame:
    return steps.groupBy("from_id", "to_id", "from_team", "to_team").agg(
        F.count(F.lit(1)).alias("steps"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )


def team_steps(df: DataFrame) -> DataFrame:
    """Edges between the teams of consecutive entries, the same team included."""
    return _edges(_steps(df))


def team_moves(df: DataFrame) -> DataFrame:
    """Edges of real team changes, one row per (from, to)."""
    return _edges(_steps(df).where(F.col("from_id") != F.col("to_id")))


def driver_moves(df: DataFrame, driver: str) -> DataFrame:
    """The team changes of one driver in order, not collapsed."""
    steps = _steps(df.where(F.col("driverRef") == driver))
    changes = steps.where(F.col("from_id") != F.col("to_id"))
    return changes.select("from_id", "to_id", "from_team", "to_team", "year", "round").orderBy(
        "year", "round"
    )


# --- A7 --------------------------------------------------------------------


def podium_rate(df: DataFrame, n: int | None = 10) -> DataFrame:
    """Podiums over entries per team; NULL for a team without a podium."""
    rates = (
        df.where(F.col("constructorId").isNotNull())
        .groupBy("constructorId", "constructorRef")
        .agg(
            ratio(F.nullif(count_where(on_podium()), F.lit(0)), F.count(F.lit(1))).alias("podium_rate"),
        )
    )
    return top_k(rates, n, "podium_rate", "constructorId")


def _seen_circuit_rates(df: DataFrame) -> DataFrame:
    keyed = df.where(F.col("constructorId").isNotNull() & F.col("circuitId").isNotNull())
    return keyed.groupBy("circuitId", "constructorId").agg(
        ratio(count_where(on_podium()), F.count(F.lit(1))).alias("podium_rate")
    )


def circuit_rates(df: DataFrame) -> SparseMatrix:
    """Podium rates by team and circuit; a team that never raced at a circuit has the rate 0."""
    return SparseMatrix.of(_seen_circuit_rates(df), "constructorId", "circuitId", "podium_rate")


def circuit_rate(df: DataFrame) -> DataFrame:
    """Podium rate for every circuit and team, 0 where the team never raced. ``circuit_rates`` is its sparse form."""
    seen = keep(_seen_circuit_rates(df))
    return dense_grid(seen, seen.select("circuitId"), seen.select("constructorId"), {"podium_rate": 0.0})


def circuit_rate_mean(df: DataFrame, n: int | None = 5) -> DataFrame:
    """Mean of the circuit rates over all circuits, never raced ones counting as 0."""
    means = circuit_rates(df).by_row().select("constructorId", F.col("mean").alias("mean_circuit_rate"))
    return top_k(means, n, "mean_circuit_rate", "constructorId")


def circuit_rate_top(df: DataFrame, teams: int = 10, circuits: int = 10) -> DataFrame:
    """Circuit rates of the best teams at the circuits with the most entries."""
    best = podium_rate(df, teams).select("constructorId")
    sizes = df.where(F.col("circuitId").isNotNull()).groupBy("circuitId").agg(F.count(F.lit(1)).alias("entries"))
    busiest = top_k(sizes, circuits, "entries", "circuitId").select("circuitId")
    return circuit_rates(df).dense(best, busiest)


def team_head_to_head(df: DataFrame, by_circuit: bool = False) -> DataFrame:
    """For ordered team pairs: share of common races in which ``team`` was ahead.

    A team's place is its best one. A race without a finish for either still
    counts as played. ``by_circuit`` finds the best places per circuit and race
    and counts the circuits too; a race has one circuit, so the shares are the
    same.
    """
    race = ["circuitId", "raceId"] if by_circuit else ["raceId"]
    keyed = df.dropna(subset=[*race, "constructorId"])
    best = keyed.groupBy(*race, "constructorId").agg(F.min("position").alias("position"))
    if by_circuit:
        found = pair_sums(best, "raceId", "constructorId", "position", by="circuitId")
        totals = [F.sum(c).alias(c) for c in ("together", "a_ahead", "b_ahead")]
        pairs = found.groupBy("a", "b").agg(*totals, F.count(F.lit(1)).alias("circuits"))
    else:
        pairs = pair_sums(best, "raceId", "constructorId", "position")

    def side(team: str, opponent: str, wins: str):
        return F.struct(
            F.col(team).alias("team"),
            F.col(opponent).alias("opponent"),
            F.col("together").cast("bigint").alias("races"),
            ratio(wins, "together").alias("win_ratio"),
            *(["circuits"] if by_circuit else []),
        )

    return pairs.select(F.inline(F.array(side("a", "b", "a_ahead"), side("b", "a", "b_ahead"))))


def head_to_head_of(df: DataFrame, team: int, by_circuit: bool = False) -> DataFrame:
    """One team against every opponent: share of common races in which it was ahead.

    The team's own races, one row each, meet the others' once, so that work and
    answer grow with the rows. ``by_circuit`` finds the best places per circuit
    and race and counts the circuits too; a race has one circuit, so the shares
    are the same.
    """
    race = ["circuitId", "raceId"] if by_circuit else ["raceId"]
    keyed = df.dropna(subset=[*race, "constructorId"])
    best = keyed.groupBy(*race, "constructorId").agg(F.min("position").alias("position"))
    own = best.where(F.col("constructorId") == team).select(*race, F.col("position").alias("own"))
    met = best.where(F.col("constructorId") != team).join(own, race)
    ahead = count_where(F.col("own") < F.col("position"))
    counts = [F.count(F.lit(1)).alias("races"), ratio(ahead, F.count(F.lit(1))).alias("win_ratio")]
    if by_circuit:
        counts.append(F.count_distinct("circuitId").alias("circuits"))
    duels = met.groupBy(F.col("constructorId").alias("opponent")).agg(*counts)
    return duels.select(F.lit(team).cast("bigint").alias("team"), *duels.columns)


def team_head_to_head_matrix(df: DataFrame, n: int = 10) -> DataFrame:
    """Head to head among the n teams with the best podium rate, with names."""
    best = podium_rate(df, n)
    rows = best.select(F.col("constructorId").alias("team"), F.col("constructorRef").alias("team_name"))
    columns = best.select(
        F.col("constructorId").alias("opponent"), F.col("constructorRef").alias("opponent_name")
    )
    # A pair depends on its own two teams only, so the others can go before.
    own = df.join(best.select("constructorId"), "constructorId", "left_semi")
    return team_head_to_head(own).join(rows, "team").join(columns, "opponent")


# --- A8 --------------------------------------------------------------------


def consistency(df: DataFrame, min_races: int = 10) -> DataFrame:
    """Spread and mean of the finish for drivers with enough of them.

    The top-10 share is over all entries, in percent, and NULL if there is none.
    """
    top_10 = F.nullif(count_where(F.col("position") <= 10), F.lit(0))
    stats = (
        df.where(F.col("driverId").isNotNull())
        .groupBy("driverId", F.col("driverRef").alias("driver_name"))
        .agg(
            F.round(F.stddev_samp("position"), 9).alias("position_std"),
            F.avg("position").alias("avg_position"),
            F.count("position").alias("races"),
            half_even(ratio(top_10, F.count(F.lit(1))) * 100, 2).alias("top_10_ratio"),
        )
    )
    return stats.where(F.col("races") >= min_races)


def consistent_drivers(df: DataFrame, n: int | None = 5, below: float = 10, min_races: int = 10) -> DataFrame:
    """Front runners with a spread under the median of all qualifying drivers."""
    stats = keep(consistency(df, min_races))
    steady = stats.where(
        (F.col("avg_position") < below) & (F.col("position_std") < median_of(stats, "position_std"))
    )
    return top_k(steady, n, "position_std", "driverId", ascending=True)


def fluctuating_drivers(df: DataFrame, n: int | None = 5, min_races: int = 10) -> DataFrame:
    return top_k(consistency(df, min_races), n, "position_std", "driverId")
