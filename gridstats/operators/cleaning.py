"""Cleaning jobs: coerce, trim, parse, remove duplicates, fill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstats.functions import seconds_of
from gridstats.operators.duplicates import copies_removed, distinct_rows
from gridstats.sources.files import keep
from gridstats.sources.schemas import KINDS, SPECS, TableSpec


def coerce(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """Typed columns; a value that cannot be read becomes NULL."""
    return raw.select(*[KINDS[kind](name).alias(name) for name, kind in spec.columns.items()])


def with_durations(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Add the intervals read from time text, and their length in seconds."""
    spans = df.withColumns({name: parse(source) for name, (parse, source) in spec.spans.items()})
    return spans.withColumns({name: seconds_of(span) for name, span in spec.seconds.items()})


def clean(raw: DataFrame, name: str, few_copies: bool = False) -> DataFrame:
    """Cleaned table ``name``.

    With ``few_copies`` only rows that have copies are shuffled, at the price of
    writing the typed rows, which are read several times (``duplicates.distinct_rows``):
    reading values from text costs more than that.

    Durations follow from the text, so they are added to the rows that remain
    and not carried through the shuffle. Nulls are filled after duplicates are
    removed: a row with no status and a row with the fill text both stay.
    """
    spec = SPECS[name]
    typed = coerce(raw, spec)
    unique = with_durations(distinct_rows(keep(typed)) if few_copies else typed.dropDuplicates(), spec)
    return unique.fillna(spec.fill_after) if spec.fill_after else unique


def removed_rows(raw: DataFrame, name: str, few_copies: bool = False) -> DataFrame:
    """How many rows cleaning drops as duplicates."""
    typed = coerce(raw, SPECS[name])
    if few_copies:
        return copies_removed(keep(typed))
    copies = typed.groupBy(*typed.columns).agg(F.count(F.lit(1)).alias("copies"))
    return copies.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
    ).withColumn("removed", F.col("rows_before") - F.col("rows_after"))
