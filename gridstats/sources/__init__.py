from gridstats.sources.files import (
    deal,
    first_two_columns,
    forget,
    keep,
    keep_bucketed,
    load,
    raw,
    save,
    scatter_rows,
    scatter_tables,
    shared_folder,
    strip_column_names,
    table_paths,
)
from gridstats.sources.order_tables import RaceTables
from gridstats.sources.schemas import SPECS, TableSpec

__all__ = [
    "RaceTables",
    "SPECS",
    "TableSpec",
    "deal",
    "first_two_columns",
    "forget",
    "keep",
    "keep_bucketed",
    "load",
    "raw",
    "save",
    "scatter_rows",
    "scatter_tables",
    "shared_folder",
    "strip_column_names",
    "table_paths",
]
