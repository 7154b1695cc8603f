"""Order inside a group, for groups of any size.

A window puts a whole partition into one task. These operators split every
group into consecutive stretches (a season, a range of values), do the work
inside the stretches, and carry only small totals or edge rows across them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def earlier_rows(df: DataFrame, group: list[str], stretch: str) -> DataFrame:
    """Per stretch, how many rows of the group lie in earlier stretches."""
    sizes = df.groupBy(*group, stretch).agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*group).orderBy(stretch).rowsBetween(W.unboundedPreceding, -1)
    return sizes.select(
        *group, stretch, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")
    )


def numbered(
    df: DataFrame,
    group: list[str],
    stretch: str,
    order: list[Column],
    out: str,
    sizes_of: DataFrame | None = None,
) -> DataFrame:
    """Exact 1-based row number in ``group`` by ``(stretch, *order)``.

    ``stretch`` must grow along the order. Row numbers are taken per stretch
    and shifted by the number of rows in earlier stretches. ``sizes_of`` is a
    cheaper frame with the same rows to count, where ``df`` is a long plan.
    """
    rows = df if sizes_of is None else sizes_of
    inside = W.partitionBy(*group, stretch).orderBy(*order)
    return (
        df.withColumn("_row", F.row_number().over(inside))
        .join(earlier_rows(rows, group, stretch), [*group, stretch])
        .withColumn(out, F.col("_row") + F.col("_before"))
        .drop("_row", "_before")
    )


def value_stretch(df: DataFrame, value: str) -> Column:
    """Descending stretch number of a non-negative value: ranges of equal ratio.

    There are more and narrower ranges the more rows the frame has, without a
    limit, so that a range of one hot group still fits a task.
    """
    per_doubling = df.agg(F.greatest(F.ceil(F.count(F.lit(1)) / 1e6), F.lit(16))).scalar()
    return (-F.floor(F.log2(F.col(value).cast("double") + 1.0) * per_doubling)).cast("int")


def shifted(
    df: DataFrame,
    entity: str,
    stretch: str,
    order: list[str],
    shifts: dict[str, tuple[str, int]],
    *,
    ahead: bool = False,
    row: str | None = None,
) -> DataFrame:
    """Add ``{out: (column, k)}``: the column k rows back (or ahead) per entity.

    ``row`` names a column for the row's number inside its stretch, if wanted.

    The sequence of an entity runs by ``(stretch, *order)``. Rows far enough
    from the edge of their stretch find the other row inside it. The others are
    settled among the edge rows alone: 2 * k rows per stretch.
    """
    reach = max(k for _, k in shifts.values())

    def along(*keys: str) -> list[Column]:
        return [F.col(k).desc() if ahead else F.col(k).asc() for k in keys]

    inside = W.partitionBy(entity, stretch).orderBy(*along(*order))
    across = W.partitionBy(entity).orderBy(*along(stretch, *order))

    def moved(frame: DataFrame, window) -> DataFrame:
        return frame.withColumns({o: F.lag(c, k).over(window) for o, (c, k) in shifts.items()})

    marked = df.withColumns(
        {
            "_from_start": F.row_number().over(inside),
            "_rows": F.count(F.lit(1)).over(W.partitionBy(entity, stretch)),
        }
    )
    near_end = F.col("_rows") - F.col("_from_start") < reach
    settled = moved(marked, inside).where(F.col("_from_start") > reach)
    edges = marked.where((F.col("_from_start") <= reach) | near_end)
    at_start = moved(edges, across).where(F.col("_from_start") <= reach)
    both = settled.unionByName(at_start).drop("_rows")
    return both.withColumnRenamed("_from_start", row) if row else both.drop("_from_start")
