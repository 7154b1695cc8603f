"""Exact quantiles and box statistics for groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstats.sources.files import keep

#: Ranges that values are dealt into, as a multiple of the shuffle partitions: few of them are read again.
FINER = 4


def value_counts(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct values per group with their row count (or summed weight)."""
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    present = df.where(F.col(value).isNotNull())
    return present.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(amount.alias("_w"))


def ranged(counts: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """The counts written in order of group and value, with the number ``_p`` of their range.

    Spark samples the bounds of the ranges, so that each holds about as many
    values, whatever their distribution; a large group has many ranges, small
    groups share one. The written table fixes the ranges for all who read it.
    """
    parts = parts or FINER * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartitionByRange(parts, *[F.col(k) for k in (*keys, "_v")])
    return keep(dealt.withColumn("_p", F.spark_partition_id()))


def quantiles(
    counts: DataFrame, keys: list[str], probabilities: dict[str, float], buckets: int | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation, from ``value_counts``.

    The values are dealt into ranges (``buckets`` of them, or a few times the
    number of shuffle partitions). This runs a job.
    """
    return _located(ranged(counts, keys, buckets), keys, probabilities)


def _located(values: DataFrame, keys: list[str], probabilities: dict[str, float]) -> DataFrame:
    """Quantiles by weighted rank selection over ranges.

    The weights of each group and range are added up, and their running totals
    show which ranges hold the wanted ranks. Only those ranges are read again
    and put in order, a range of a group in one task.
    """
    upto = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        values.groupBy(*keys, "_p")
        .agg(F.sum("_w").alias("_in"))
        .withColumn("_before", F.coalesce(F.sum("_in").over(upto), F.lit(0)))
        .withColumn("_n", F.sum("_in").over(W.partitionBy(*keys)))
    )
    places = {name: (F.col("_n") - 1) * p for name, p in probabilities.items()}
    ranks = [end(at) for at in places.values() for end in (F.floor, F.ceil)]
    holds = [(r >= F.col("_before")) & (r < F.col("_before") + F.col("_in")) for r in ranks]
    wanted = totals.where(reduce(Column.__or__, holds)).drop("_in")
    in_range = W.partitionBy(*keys, "_p").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ordered = values.join(wanted, [*keys, "_p"]).withColumn("_to", F.col("_before") + F.sum("_w").over(in_range))
    outputs = []
    for name, at in places.items():
        # The value of a rank is the first one up to which there are more rows than the rank's number.
        low, high = (F.min(F.when(F.col("_to") > end(at), F.col("_v"))) for end in (F.floor, F.ceil))
        outputs.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return ordered.groupBy(*keys).agg(F.max("_n").alias("n"), *outputs)


def box_stats(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Quartiles, whiskers within 1.5 IQR, and the number of rows beyond them."""
    counts = ranged(value_counts(df, keys, value, weight), keys)
    quartiles = _located(counts, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach)
    shape = ["n", "q1", "median", "q3"]
    return (
        counts.join(quartiles, keys)
        .groupBy(*keys, *shape)
        .agg(
            F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("_w"))), F.lit(0)).alias("outliers"),
        )
    )


def median_of(df: DataFrame, value: str):
    """Exact median of a column as a scalar."""
    return quantiles(value_counts(df, [], value), [], {"median": 0.5}).select("median").scalar()
