"""A10 line-up, A11 recency-weighted forecast, A12 teams at risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstats.functions import clip, count_where, half_even, linear_weight, ratio, top_k
from gridstats.plans.performance import on_podium, won


def latest_year(df: DataFrame) -> Column:
    """Last season as a scalar subquery: one number, computed once."""
    return df.agg(F.max("year")).scalar()


# --- A10 -------------------------------------------------------------------

# Weights of the line-up score.
LINEUP_WEIGHTS = {
    "avg_points_norm": 0.3,
    "podium_ratio_norm": 0.25,
    "win_ratio_norm": 0.25,
    "consistency_score": 0.2,
}


def driver_scores(df: DataFrame, recent_years: int = 3, min_races: int = 10) -> DataFrame:
    """Recent form per driver and its weighted score.

    The window is inclusive: ``recent_years=3`` covers four seasons. A measure
    that is equal for all drivers cannot be scaled and gives no score.
    """
    recent = df.where(
        (F.col("year") >= latest_year(df) - recent_years) & F.col("driverId").isNotNull()
    )
    races = F.count("raceId")
    stats = (
        recent.groupBy("driverId", F.col("driverRef").alias("driver_name"))
        .agg(
            half_even(F.coalesce(F.sum("points"), F.lit(0.0)), 2).alias("total_points"),
            half_even(F.avg("points"), 2).alias("avg_points"),
            half_even(F.avg("position"), 2).alias("avg_position"),
            half_even(F.stddev_samp("position"), 2).alias("position_std"),
            races.alias("races"),
            half_even(F.coalesce(ratio(count_where(on_podium()), races), F.lit(0.0)), 3).alias("podium_ratio"),
            half_even(F.coalesce(ratio(count_where(won()), races), F.lit(0.0)), 3).alias("win_ratio"),
        )
        .where(F.col("races") >= min_races)
    )
    scaled = ["avg_points", "podium_ratio", "win_ratio"]
    bounds = stats.agg(
        F.struct(
            *[F.min(c).alias(f"{c}_min") for c in scaled],
            *[F.max(c).alias(f"{c}_max") for c in scaled],
            F.max("position_std").alias("position_std_max"),
        )
    ).scalar()

    def normed(c: str) -> Column:
        low, high = bounds.getField(f"{c}_min"), bounds.getField(f"{c}_max")
        return ratio(F.col(c) - low, high - low)

    scores = stats.withColumns({f"{c}_norm": normed(c) for c in scaled}).withColumn(
        "consistency_score", 1 - ratio("position_std", bounds.getField("position_std_max"))
    )
    total = sum((F.col(c) * w for c, w in LINEUP_WEIGHTS.items()), F.lit(0.0))
    return scores.withColumn("final_score", total)


def lineup(df: DataFrame, recent_years: int = 3, n: int = 5) -> DataFrame:
    return top_k(driver_scores(df, recent_years), n, "final_score", "driverId")


def lineup_pair(df: DataFrame, recent_years: int = 3) -> DataFrame:
    return lineup(df, recent_years, 2).select("driverId", "driver_name", "final_score")


def lineup_pair_stats(df: DataFrame, recent_years: int = 3) -> DataFrame:
    """Combined figures of the two best drivers."""
    return lineup(df, recent_years, 2).agg(
        F.sum("total_points").alias("total_points"),
        F.avg("avg_points").alias("avg_points"),
        F.sum(F.col("podium_ratio") * F.col("races")).alias("podiums"),
        F.sum(F.col("win_ratio") * F.col("races")).alias("wins"),
        F.avg("consistency_score").alias("avg_consistency"),
    )


# --- A11, weighted ---------------------------------------------------------


def _weighted_points(df: DataFrame, start: int) -> DataFrame:
    weight = linear_weight("year", F.lit(start - 1), latest_year(df))
    recent = df.where(F.col("year") >= start)
    return recent.withColumn("weighted_points", F.col("points") * weight)


def weighted_drivers(df: DataFrame, start: int = 2020, n: int | None = 3) -> DataFrame:
    """Points since ``start``, weighted linearly towards the last season."""
    table = (
        _weighted_points(df, start)
        .where(F.col("driverId").isNotNull())
        .groupBy("driverId", "driverRef")
        .agg(
            F.coalesce(F.sum("weighted_points"), F.lit(0.0)).alias("weighted_points"),
            F.coalesce(F.sum("points"), F.lit(0.0)).alias("points"),
            F.avg("position").alias("avg_position"),
        )
    )
    return top_k(table, n, "weighted_points", "driverId")


def weighted_constructors(df: DataFrame, start: int = 2020, n: int | None = 3) -> DataFrame:
    table = (
        _weighted_points(df, start)
        .where(F.col("constructorId").isNotNull())
        .groupBy("constructorId", "constructorRef")
        .agg(
            F.coalesce(F.sum("weighted_points"), F.lit(0.0)).alias("weighted_points"),
            F.coalesce(F.sum("points"), F.lit(0.0)).alias("points"),
        )
    )
    return top_k(table, n, "weighted_points", "constructorId")


# --- A12 -------------------------------------------------------------------


def _recent(df: DataFrame, back: int) -> DataFrame:
    return df.where((F.col("year") >= latest_year(df) - back) & F.col("constructorId").isNotNull())


def team_growth(df: DataFrame, back: int = 4) -> DataFrame:
    """Mean and deviation of a team's yearly change in points, 0 if there is none.

    A season without the team keeps the points of the one before; a season
    after zero points gives no change. Only seasons that some team raced count.
    """
    recent = _recent(df, back)
    yearly = recent.groupBy("constructorId", "year").agg(
        F.coalesce(F.sum("points"), F.lit(0.0)).alias("points")
    )
    last = latest_year(df)
    seasons = recent.select("year").distinct()
    dense = (
        yearly.select("constructorId")
        .distinct()
        .withColumn("year", F.explode(F.sequence(last - back, last)))
        .join(seasons, "year", "left_semi")
        .join(yearly, ["constructorId", "year"], "left")
    )
    line = W.partitionBy("constructorId").orderBy("year")
    filled = dense.withColumn("points", F.last("points", ignorenulls=True).over(line))
    change = F.try_divide("points", F.lag("points").over(line)) - 1
    return (
        filled.withColumn("change", change)
        .groupBy("constructorId")
        .agg(
            F.coalesce(F.avg("change"), F.lit(0.0)).alias("point_growth"),
            F.coalesce(F.stddev_samp("change"), F.lit(0.0)).alias("volatility"),
        )
    )


def risk_linear(df: DataFrame, growth: bool = True) -> DataFrame:
    """Risk over the last three seasons with linear recency weights.

    ``growth=False`` leaves out the development term, as in the published
    figures, where a misaligned index kept it at zero.
    """
    last = latest_year(df)
    recent = _recent(df, 2).withColumn(
        "weighted", F.col("points") * linear_weight("year", last - 3, last)
    )
    teams = recent.groupBy("constructorId", F.col("constructorRef").alias("constructor_name")).agg(
        half_even(F.coalesce(F.sum("weighted"), F.lit(0.0)), 2).alias("weighted_points"),
        half_even(F.avg("points"), 2).alias("avg_points"),
        half_even(F.stddev_samp("points"), 2).alias("points_std"),
        half_even(F.avg("position"), 2).alias("avg_position"),
        half_even(F.stddev_samp("position"), 2).alias("position_std"),
    )
    best = teams.agg(F.max("weighted_points")).scalar()
    if growth:
        changes = team_growth(df, 2).select("constructorId", F.col("point_growth").alias("development_score"))
        teams = teams.join(changes, "constructorId", "left")
    else:
        teams = teams.withColumn("development_score", F.lit(None).cast("double"))
    scored = teams.withColumns(
        {
            "consistency_score": 1 / (F.col("points_std") + 1),
            "performance_score": ratio("weighted_points", best),
        }
    )
    shrinking = F.when(F.round("development_score", 9) < 0, 1.0).otherwise(0.0)
    risk = (
        (1 - F.col("performance_score")) * 0.4
        + (1 - F.col("consistency_score")) * 0.3
        + shrinking * 0.3
    )
    return top_k(scored.withColumn("risk_score", risk), None, "risk_score", "constructorId")


def risk_exponential(df: DataFrame) -> DataFrame:
    """Risk over the last five seasons with exponential recency weights."""
    last = latest_year(df)
    back, base = 4, 1.5
    weight = F.pow(F.lit(base), F.col("year") - (last - back)) / base**back
    recent = _recent(df, back).withColumn("weighted", F.col("points") * weight)
    teams = recent.groupBy("constructorId", F.col("constructorRef").alias("constructor_name")).agg(
        half_even(F.coalesce(F.sum("weighted"), F.lit(0.0)), 2).alias("weighted_points"),
        half_even(F.avg("points"), 2).alias("avg_points"),
        half_even(F.stddev_samp("points"), 2).alias("points_std"),
        F.count("points").alias("race_count"),
        half_even(F.avg("position"), 2).alias("avg_position"),
        half_even(F.stddev_samp("position"), 2).alias("position_std"),
        F.count_distinct("year").alias("years_active"),
    )
    best = F.greatest(teams.agg(F.max("weighted_points")).scalar(), F.lit(1.0))
    scored = teams.join(team_growth(df, back), "constructorId", "left").withColumns(
        {
            "development_score": F.col("point_growth"),
            "stability_score": 1 / (clip(F.col("volatility"), lower=0.001) + 1),
            "participation_score": F.col("years_active") / 4.0,
            "consistency_score": clip(
                F.col("points_std")
                / F.when(F.col("avg_points") == 0, 0.001).otherwise(F.col("avg_points")),
                upper=5.0,
            ),
        }
    )
    risk = (
        (1 - F.col("weighted_points") / best) * 0.35
        + F.col("consistency_score") * 0.20
        + (1 - clip(F.col("stability_score"), 0.0, 1.0)) * 0.20
        + F.when(F.round("development_score", 9) < 0, 1.0).otherwise(0.0) * 0.15
        + (1 - clip(F.col("participation_score"), 0.0, 1.0)) * 0.10
    )
    scored = scored.withColumn("risk_score", F.coalesce(risk, F.lit(1.0)))
    return top_k(scored, None, "risk_score", "constructorId")


def risk_level(df: DataFrame, n: int | None = 3) -> DataFrame:
    """The riskiest teams with their labels."""
    risky = top_k(risk_exponential(df), n, "risk_score", "constructorId")
    return risky.select(
        "constructorId",
        "constructor_name",
        "risk_score",
        "avg_points",
        F.when(F.col("risk_score") > 0.7, "High")
        .when(F.col("risk_score") > 0.4, "Moderate")
        .otherwise("Low")
        .alias("risk_level"),
        F.when(F.round("development_score", 9) < 0, "Negative").otherwise("Positive").alias("trend"),
        F.when(F.col("stability_score") >= 0.5, "Stable").otherwise("Volatile").alias("stability"),
        F.format_string("%.0f%%", F.col("participation_score") * 100).alias("participation"),
    )


def risk_trend(df: DataFrame, n: int = 5) -> DataFrame:
    """Mean points per season of the riskiest teams."""
    risky = top_k(risk_exponential(df), n, "risk_score", "constructorId").select("constructorId")
    return (
        _recent(df, 4)
        .join(risky, "constructorId", "left_semi")
        .groupBy("constructorId", F.col("constructorRef").alias("constructor_name"), "year")
        .agg(F.avg("points").alias("points"))
    )
