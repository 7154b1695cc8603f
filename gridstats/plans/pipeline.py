"""The batch job: raw CSV tables to cleaned tables to master tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridstats.operators.cleaning import clean
from gridstats.plans import masters
from gridstats.sources.files import load, raw, save
from gridstats.sources.schemas import SPECS

MASTERS = {
    "master_race_results": (
        masters.race_results,
        ["results", "races", "drivers", "constructors", "circuits", "seasons", "status"],
    ),
    "master_qualifying": (masters.qualifying, ["qualifying", "races", "drivers", "constructors"]),
    "master_sprint_results": (
        masters.sprint_results,
        ["sprint_results", "races", "drivers", "constructors"],
    ),
    "master_pit_stops": (masters.pit_stops, ["pit_stops", "races", "drivers", "constructors"]),
    "master_lap_times": (masters.lap_times, ["lap_times", "races", "drivers", "circuits"]),
}


def clean_tables(spark: SparkSession, raw_root: str, clean_root: str, fmt: str = "parquet") -> None:
    """Clean every raw table and write it."""
    for name in SPECS:
        save(clean(raw(spark, raw_root, name), name), clean_root, name, fmt)


def build_masters(spark: SparkSession, clean_root: str, master_root: str) -> None:
    """Join the cleaned tables into the five masters and write them by season."""
    for name, (build, inputs) in MASTERS.items():
        save(build(*[load(spark, clean_root, t) for t in inputs]), master_root, name, by="year")


def master(spark: SparkSession, master_root: str, name: str = "master_race_results") -> DataFrame:
    return load(spark, master_root, name)
