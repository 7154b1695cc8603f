"""Reading and writing tables."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstats.sources.schemas import SPECS


def strip_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """One CSV file or folder, every column as text. Quotes inside quotes are doubled.

    All files of a folder must have the same columns in the same order; a file
    with another header stops the read.
    """
    frame = spark.read.csv(path, header=True, nullValue=r"\N", escape='"', enforceSchema=False)
    return strip_column_names(frame)


def raw(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Raw table ``name`` as text. A column the file lacks is read as NULL, but it must have its key."""
    frame = read_csv(spark, f"{root}/{name}.csv")
    present, key = set(frame.columns), next(iter(SPECS[name].columns))
    if key not in present:
        raise ValueError(f"{name} has no column {key}")
    return frame.select(
        *[
            F.col(c) if c in present else F.lit(None).cast("string").alias(c)
            for c in SPECS[name].columns
        ]
    )


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A cleaned or master table by name."""
    return spark.read.parquet(f"{root}/{name}")


def by_column(df: DataFrame, column: str | None):
    """A writer that lays the table out by a column, one folder per value.

    Readers then skip whole values. The rebalance hint gathers a value's rows
    into few files and splits the files of a large one.
    """
    if column is None:
        return df.write
    return df.hint("rebalance", column).write.partitionBy(column)


def save(df: DataFrame, root: str, name: str, fmt: str = "parquet", by: str | None = None) -> None:
    """Write a table. Parquet keeps dates and intervals; CSV gets intervals as text."""
    if fmt == "csv":
        spans = [c for c, kind in df.dtypes if kind.startswith("interval")]
        df = df.withColumns({c: F.col(c).cast("string") for c in spans})
        df.write.mode("overwrite").csv(f"{root}/{name}", header=True, escape='"')
    else:
        by_column(df, by).mode("overwrite").format(fmt).save(f"{root}/{name}")


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. A local master, whose
    executors run on the driver's machine, gets a temporary folder where that
    setting is missing; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gridstats-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{spark.sparkContext.applicationId}"


def keep(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write a frame that several operators read, and return the written table.

    This runs a job. The table lies in the shared folder: readers prune its
    columns, the lineage ends there, and a lost executor costs a re-read and
    not a re-computation. ``forget`` removes all tables of the application.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid4().hex}"
    by_column(df, by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys into the buckets of ``keep_bucketed``; sums by these and other keys stay there."""
    return df.repartition(_buckets(df.sparkSession), *keys)


def keep_bucketed(df: DataFrame, *keys: str, dealt: bool = False) -> DataFrame:
    """``keep``, dealt by keys: tables dealt alike are joined and grouped on them without another shuffle.

    The buckets, one file each, are as many as shuffle partitions. Adaptive
    execution cannot split a bucket, so a key must have few rows: sum up first.
    ``dealt`` says that ``deal`` by the same keys has dealt the rows already.
    """
    spark = df.sparkSession
    name = f"{_bucketed_prefix(spark)}{uuid4().hex}"
    rows = df if dealt else deal(df, *keys)
    written = rows.write.bucketBy(_buckets(spark), *keys)
    written.option("path", f"{shared_folder(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _bucketed_prefix(spark: SparkSession) -> str:
    return f"kept_{spark.sparkContext.applicationId}_".replace("-", "_").lower()


def forget(spark: SparkSession) -> None:
    """Remove every table that ``keep`` and ``keep_bucketed`` wrote for this application."""
    for row in spark.sql(f"SHOW TABLES LIKE '{_bucketed_prefix(spark)}*'").collect():
        spark.sql(f"DROP TABLE IF EXISTS {row['tableName']}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The CSV files of a folder: one row of ``path`` and ``name`` per file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.csv$", 1)
    return files.select("path", name.alias("name"))


def scatter_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """First two columns of every CSV file of a folder; narrower files are skipped.

    Only the list of files, one row per table, comes to the driver.
    """
    tables = {r["name"]: read_csv(spark, r["path"]) for r in table_paths(spark, folder).collect()}
    pairs = {name: first_two_columns(df) for name, df in tables.items()}
    return {name: df for name, df in pairs.items() if df is not None}


def scatter_rows(spark: SparkSession, folder: str) -> DataFrame:
    """First two columns of every CSV file below a folder as one long frame, whatever their headers.

    Returns ``name`` (of the file, or of the folder ``<name>.csv`` that holds
    it), ``x_name``, ``y_name``, ``x`` and ``y`` as text. Cells are mapped by
    position in one scan of all files; the headers, a row per file, are the
    files' first rows. Files with fewer than two columns are skipped; a file
    without rows adds none. The files' number does not matter to the plan.
    """
    options = {"recursiveFileLookup": True, "pathGlobFilter": "*.csv", "escape": '"'}
    pair = spark.read.options(**options).schema("x string, y string")
    file = F.col("_metadata.file_path").alias("file")
    cells = pair.csv(folder, header=True, enforceSchema=True, nullValue=r"\N").select(file, "x", "y")
    # A file's first row has the smallest place among the rows of its first block.
    lines = pair.csv(folder, header=False).where("_metadata.file_block_start = 0")
    placed = lines.select(file, F.monotonically_increasing_id().alias("place"), "x", "y")
    headers = placed.groupBy("file").agg(F.min(F.struct("place", "x", "y")).alias("first"))
    named = headers.select(
        "file",
        F.regexp_extract("file", r"([^/]+)\.csv(?:/[^/]+)?$", 1).alias("name"),
        F.trim("first.x").alias("x_name"),
        F.trim("first.y").alias("y_name"),
    )
    # Kept, so that the join knows how small they are: dealt by file, all cells would lie in as many tasks as files.
    return cells.join(keep(named.where("y_name is not null")), "file").select("name", "x_name", "y_name", "x", "y")


def first_two_columns(df: DataFrame) -> DataFrame | None:
    """The first two columns (the data of a scatter chart); None if there are fewer."""
    if len(df.columns) < 2:
        return None
    return df.select(*df.columns[:2])
