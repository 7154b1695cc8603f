"""Wide master tables: one fact table left-joined to its dimensions.

Names never collide: a column that two tables share carries the name of its
table. No join is hinted. Spark broadcasts a dimension when its measured size
allows it, and otherwise joins by key and splits hot partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

RENAMED = {
    "races": {"name": "race_name", "date": "race_date", "time": "race_time", "url": "race_url"},
    "drivers": {
        "number": "driver_number",
        "nationality": "driver_nationality",
        "url": "driver_url",
    },
    "constructors": {
        "name": "constructor_name",
        "nationality": "constructor_nationality",
        "url": "constructor_url",
    },
    "circuits": {"name": "circuit_name", "url": "circuit_url"},
    "seasons": {"url": "season_url"},
    "status": {},
}
KEYS = {
    "races": "raceId",
    "drivers": "driverId",
    "constructors": "constructorId",
    "circuits": "circuitId",
    "seasons": "year",
    "status": "statusId",
}


#: The dimension that grows with the rows: it is joined first, where a shuffle carries only the fact's own columns.
LARGEST = "drivers"


def attach(fact: DataFrame, **dimensions: DataFrame) -> DataFrame:
    """Left-join each named dimension to the fact table on its key.

    The columns come in the order of the names; the joins begin with LARGEST.
    """
    renamed = {name: table.withColumnsRenamed(RENAMED[name]) for name, table in dimensions.items()}
    columns = fact.columns
    for name, table in renamed.items():
        key = KEYS[name]
        columns = [key, *(c for c in columns + table.columns if c != key)]
    for name in sorted(renamed, key=lambda name: name != LARGEST):
        fact = fact.join(renamed[name], KEYS[name], "left")
    return fact.select(*[f"`{c}`" for c in columns])


def race_results(results, races, drivers, constructors, circuits, seasons, status) -> DataFrame:
    return attach(
        results.withColumnRenamed("time", "result_time"),
        races=races,
        drivers=drivers,
        constructors=constructors,
        circuits=circuits,
        seasons=seasons,
        status=status,
    )


def qualifying(qualifying, races, drivers, constructors) -> DataFrame:
    return attach(qualifying, races=races, drivers=drivers, constructors=constructors)


def sprint_results(sprint_results, races, drivers, constructors) -> DataFrame:
    fact = sprint_results.withColumnRenamed("time", "result_time")
    return attach(fact, races=races, drivers=drivers, constructors=constructors)


def pit_stops(pit_stops, races, drivers, constructors) -> DataFrame:
    """Constructors are joined only if the stops name one."""
    fact = attach(pit_stops.withColumnRenamed("time", "stop_time"), races=races, drivers=drivers)
    if "constructorId" in pit_stops.columns:
        fact = attach(fact, constructors=constructors)
    return fact


def lap_times(lap_times, races, drivers, circuits) -> DataFrame:
    fact = lap_times.withColumnRenamed("time", "lap_time")
    return attach(fact, races=races, drivers=drivers, circuits=circuits)
