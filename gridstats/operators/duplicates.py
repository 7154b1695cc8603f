"""Removal of repeated rows that shuffles only rows that have copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstats.sources.files import keep

#: Repeated hashes, of 8 bytes each, that are sent to every executor; with more, whole rows are shuffled.
MOST_REPEATED = 2_000_000


def repeated_hashes(df: DataFrame) -> DataFrame:
    """``_row``: hashes that more than one row has. Equal rows have equal hashes."""
    hashed = df.select(F.xxhash64(*[f"`{c}`" for c in df.columns]).alias("_row"))
    return hashed.groupBy("_row").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("_row")


def split_rows(df: DataFrame, most: int = MOST_REPEATED) -> tuple[DataFrame | None, DataFrame]:
    """Rows that surely have no copy (None if that is not known), and all others.

    A first pass shuffles one hash a row, partly counted before. Its result is
    written, and so of known size: none of it leaves no other rows, up to
    ``most`` hashes are broadcast to tell the rows apart, and with more of them
    nothing is told apart. Different rows that share a hash count as others.
    """
    repeated = keep(repeated_hashes(df))
    found = repeated.count()
    if found == 0:
        return df, df.limit(0)
    if found > most:
        return None, df
    marked, row = F.broadcast(repeated), F.xxhash64(*[df[f"`{c}`"] for c in df.columns])
    on = row == marked["_row"]
    return df.join(marked, on, "left_anti"), df.join(marked, on, "left_semi")


def distinct_rows(df: DataFrame, most: int = MOST_REPEATED) -> DataFrame:
    """The rows of ``dropDuplicates()``. Rows without copies take part in no shuffle.

    Runs a job that reads ``df`` once, and the result reads it again: for wide
    rows with few copies that is less than shuffling all of them, for narrow
    ones or a costly source it is more.
    """
    single, others = split_rows(df, most)
    if single is None:
        return others.dropDuplicates()
    return single.unionByName(others.dropDuplicates())


def copies_removed(df: DataFrame, most: int = MOST_REPEATED) -> DataFrame:
    """One row: ``rows_before``, ``rows_after`` and ``removed`` of ``distinct_rows``."""
    single, others = split_rows(df, most)
    copies = others.groupBy(*[f"`{c}`" for c in df.columns]).agg(F.count(F.lit(1)).alias("rows_before"))
    counted = copies.select("rows_before", F.lit(1).alias("rows_after"))
    if single is not None:
        alone = single.agg(F.count(F.lit(1)).alias("rows_before"))
        counted = counted.unionByName(alone.withColumn("rows_after", F.col("rows_before")))
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows_before", "rows_after")]
    return counted.agg(*totals).withColumn("removed", F.col("rows_before") - F.col("rows_after"))
