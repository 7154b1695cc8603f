"""Profiles and the data behind the exploratory charts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstats.functions import pearson, top_k

#: Cells that a density's values are counted in.
CELLS = 1 << 16


def profile_table(df: DataFrame) -> DataFrame:
    """Row count, type and null count of every column, one row per column.

    All counts come from one pass over the table.
    """
    nulls = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns],
    )
    kinds = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    long = nulls.unpivot(["_rows"], df.columns, "column", "nulls")
    return long.select(
        "column", kinds[F.col("column")].alias("type"), F.col("_rows").alias("rows"), "nulls"
    )


def profile_before_after(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Profiles of a table before and after cleaning."""
    stages = [("before", raw), ("after", cleaned)]
    return reduce(
        DataFrame.unionByName, [profile_table(df).withColumn("stage", F.lit(s)) for s, df in stages]
    )


def head(df: DataFrame, *keys: str, n: int = 5) -> DataFrame:
    """First rows in key order."""
    return df.orderBy(*keys).limit(n)


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram; the top edge belongs to the last bin, empty bins show 0."""
    x = F.col(value).cast("double")
    values = df.where(x.isNotNull())
    edge = values.agg(F.struct(F.min(x).alias("low"), F.max(x).alias("high"))).scalar()
    low, width = edge.getField("low"), (edge.getField("high") - edge.getField("low")) / bins
    place = F.coalesce(F.floor(F.try_divide(x - low, width)), F.lit(0))
    counts = values.groupBy(F.least(place + 1, F.lit(bins)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return (
        every.join(counts, "bin", "left")
        .fillna(0, ["n"])
        .withColumns({"low": low + (F.col("bin") - 1) * width, "high": low + F.col("bin") * width})
    )


def density(df: DataFrame, value: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density on an even grid from the smallest to the largest value.

    The bandwidth is Scott's rule. Values are counted in ``CELLS`` cells of equal
    width, and the kernel is evaluated once per cell in use, at the mean of its
    values, and grid point. That is exact where a cell holds equal values only,
    and linear in the rows of a continuous column.
    """
    x = F.col(value).cast("double")
    facts = df.agg(
        F.struct(
            F.min(x).alias("low"),
            F.max(x).alias("high"),
            F.count(x).alias("n"),
            F.stddev_samp(x).alias("std"),
        )
    ).scalar()
    low, high, n = (facts.getField(f) for f in ("low", "high", "n"))
    width = facts.getField("std") * F.pow(n.cast("double"), F.lit(-0.2))
    step = (high - low) / (points - 1)
    at = low + F.col("point") * step
    cell = F.coalesce(F.floor(F.try_divide(x - low, high - low) * CELLS), F.lit(0))
    counts = (
        df.where(x.isNotNull())
        .groupBy(cell.alias("cell"))
        .agg(F.avg(x).alias("v"), F.count(F.lit(1)).alias("w"))
    )
    spread = counts.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    kernel = F.exp(F.pow(F.try_divide(at - F.col("v"), width), 2) * -0.5) * F.col("w")
    scale = F.try_divide(F.lit(1.0), width * n * F.sqrt(2 * F.pi()))
    sums = spread.groupBy("point").agg(F.sum(kernel).alias("total"))
    return sums.select("point", at.alias("x"), (F.col("total") * scale).alias("density"))


def grid_finish(df: DataFrame) -> DataFrame:
    """Grid and finishing order of every entry."""
    return df.select("resultId", "grid", "positionOrder")


def grid_finish_corr(df: DataFrame) -> DataFrame:
    return df.agg(pearson("grid", "positionOrder").alias("correlation"))


def top_drivers(df: DataFrame, n: int = 10) -> DataFrame:
    """Drivers by total points, grouped by id and name; a missing name drops out."""
    keys = ["driverId", "forename", "surname"]
    totals = df.dropna(subset=keys).groupBy(*keys).agg(F.coalesce(F.sum("points"), F.lit(0.0)).alias("points"))
    return top_k(totals, n, "points", "driverId", "forename", "surname")


def circuit_points(df: DataFrame, n: int = 10) -> DataFrame:
    """Circuits by mean points."""
    means = df.dropna(subset=["circuit_name"]).groupBy("circuit_name").agg(F.avg("points").alias("points"))
    return top_k(means, n, "points", "circuit_name")


def status_counts(df: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent outcomes."""
    counts = df.dropna(subset=["status"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, n, "n", "status")


def yearly_points(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["year"]).groupBy("year").agg(F.avg("points").alias("points"))


def driver_list(df: DataFrame) -> DataFrame:
    """The sorted names to choose from."""
    return df.select("driverRef").distinct().orderBy("driverRef")
