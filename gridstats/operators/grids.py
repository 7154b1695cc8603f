"""Matrices by two keys: sparse, dense in long form, and wide for display."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstats.functions import ratio


@dataclass
class SparseMatrix:
    """Cells that exist, the keys of both sides, and the value of every other cell.

    ``cells`` has one row per existing cell (columns ``row``, ``column``,
    ``value``); ``rows`` and ``columns`` have one row per key, whether a cell
    has it or not. No operation forms all combinations: absent cells are
    counted, and formed for chosen rows only.
    """

    cells: DataFrame
    row: str
    column: str
    value: str
    rows: DataFrame
    columns: DataFrame
    default: float = 0.0

    @classmethod
    def of(cls, cells: DataFrame, row: str, column: str, value: str, default: float = 0.0) -> SparseMatrix:
        """A matrix whose keys are those of its cells."""
        kept = cells.select(row, column, value)
        return cls(kept, row, column, value, kept.select(row).distinct(), kept.select(column).distinct(), default)

    def frame(self) -> DataFrame:
        """The matrix as one frame: the cells, then a row per key with the other key NULL and the default.

        It grows with the cells and the keys. A combination that has no row of
        its own has the default.
        """
        kinds = dict(self.cells.dtypes)
        fill = F.lit(self.default).cast(kinds[self.value]).alias(self.value)

        def none(key: str):
            return F.lit(None).cast(kinds[key]).alias(key)

        own = self.rows.select(self.row, none(self.column), fill)
        other = self.columns.select(none(self.row), self.column, fill)
        return self.cells.select(self.row, self.column, self.value).unionByName(own).unionByName(other)

    def by_row(self) -> DataFrame:
        """Per row its ``present`` and ``absent`` cells and the ``mean`` over all columns."""
        width = self.columns.agg(F.count(F.lit(1))).scalar()
        sums = self.cells.groupBy(self.row).agg(F.count(F.lit(1)).alias("present"), F.sum(self.value).alias("total"))
        every = self.rows.join(sums, self.row, "left").fillna(0, ["present", "total"])
        absent = width - F.col("present")
        return every.select(
            self.row,
            F.col("present").cast("bigint").alias("present"),
            absent.cast("bigint").alias("absent"),
            ratio(F.col("total") + absent * self.default, width).alias("mean"),
        )

    def dense(self, rows: DataFrame, columns: DataFrame | None = None) -> DataFrame:
        """All cells of some chosen rows, which the caller bounds (by a limit, say), at all or some columns.

        The rows go as one array beside every column key, so that the work
        grows with the columns.
        """
        chosen = rows.select(self.row).distinct()
        keys = chosen.agg(F.collect_list(self.row)).scalar()
        grid = (self.columns if columns is None else columns.select(self.column).distinct()).withColumn(
            self.row, F.explode(keys)
        )
        cells = self.cells.join(F.broadcast(chosen), self.row, "left_semi")
        return grid.join(cells, [self.row, self.column], "left").fillna(self.default, [self.value])


#: Combinations that one shard of a grid holds, about.
SHARD = 1_000_000


def dense_grid(
    cells: DataFrame, rows: DataFrame, columns: DataFrame, fill: dict[str, float]
) -> DataFrame:
    """Every (row key, column key) combination with the values of ``cells``, else ``fill``.

    The combinations are the answer here. They come from an equality join on a
    shard number: each column key lives in one shard, each row key in all.
    There are as many shards as the two numbers of keys ask for.
    """
    held, spread = columns.distinct(), rows.distinct()
    keys = held.agg(F.count(F.lit(1)).alias("n")).scalar() * spread.agg(F.count(F.lit(1)).alias("n")).scalar()
    shards = F.greatest(F.ceil(keys / SHARD), F.lit(1)).cast("int")
    held = held.withColumn("_shard", F.pmod(F.xxhash64(*columns.columns), shards).cast("int"))
    spread = spread.withColumn("_shard", F.explode(F.sequence(F.lit(0), shards - 1)))
    grid = spread.join(held, "_shard").drop("_shard")
    return grid.join(cells, [*rows.columns, *columns.columns], "left").fillna(fill)


def wide(cells: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """A matrix for display: one column per given key, 0 where there is no cell.

    The keys are named by the caller, so their number is bounded. A cell with
    another key stops the job instead of being left out.
    """
    known = F.col(column).isNull() | F.col(column).isin(columns)
    key = F.when(known, F.col(column)).otherwise(F.raise_error("a cell has a key outside the columns"))
    mean = cells.withColumn(column, key).groupBy(row).pivot(column, columns).agg(F.avg(value))
    return mean.fillna(0.0).withColumnsRenamed({str(c): f"{column}_{c}" for c in columns})
