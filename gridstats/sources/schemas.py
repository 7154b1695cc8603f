"""Columns of the fourteen raw tables and what cleaning turns each one into.

``whole`` and ``small`` are whole numbers (64 and 32 bit), ``real`` a double,
``day`` a date, ``clock`` a time of day, ``trim`` stripped text, ``text`` text
that is kept as it is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

from gridstats.functions import (
    clock_time,
    fastest_lap_time,
    lap_time,
    present,
    result_time,
    sprint_time,
    to_day,
    to_double,
    to_whole,
    trimmed,
)


KINDS: dict[str, Callable[[str], Column]] = {
    "whole": to_whole,
    "small": lambda name: to_whole(name).try_cast("int"),
    "real": to_double,
    "day": to_day,
    "clock": clock_time,
    "trim": trimmed,
    "text": present,
}


@dataclass(frozen=True)
class TableSpec:
    """One raw table: its columns in order, added columns, and late fills."""

    columns: dict[str, str]
    spans: dict[str, tuple[Callable[[str], Column], str]] = field(default_factory=dict)
    seconds: dict[str, str] = field(default_factory=dict)
    fill_after: dict[str, str] = field(default_factory=dict)


def _cols(**kinds: str) -> dict[str, str]:
    return {name: kind for kind, names in kinds.items() for name in names.split()}


def _ordered(order: str, **kinds: str) -> dict[str, str]:
    by_name = _cols(**kinds)
    return {name: by_name[name] for name in order.split()}


SPECS: dict[str, TableSpec] = {
    "circuits": TableSpec(
        _ordered(
            "circuitId circuitRef name location country lat lng alt url",
            whole="circuitId",
            trim="circuitRef name location country url",
            real="lat lng alt",
        )
    ),
    "constructor_results": TableSpec(
        _ordered(
            "constructorResultsId raceId constructorId points status",
            whole="constructorResultsId raceId constructorId",
            real="points",
            trim="status",
        ),
        fill_after={"status": "Unknown"},
    ),
    "constructor_standings": TableSpec(
        _ordered(
            "constructorStandingsId raceId constructorId points position positionText wins",
            whole="constructorStandingsId raceId constructorId",
            real="points",
            small="position wins",
            trim="positionText",
        )
    ),
    "constructors": TableSpec(
        _ordered(
            "constructorId constructorRef name nationality url",
            whole="constructorId",
            trim="constructorRef name nationality url",
        )
    ),
    "driver_standings": TableSpec(
        _ordered(
            "driverStandingsId raceId driverId points position positionText wins",
            whole="driverStandingsId raceId driverId",
            real="points",
            small="position wins",
            trim="positionText",
        )
    ),
    "drivers": TableSpec(
        _ordered(
            "driverId driverRef number code forename surname dob nationality url",
            whole="driverId",
            small="number",
            day="dob",
            trim="driverRef code forename surname nationality url",
        )
    ),
    "lap_times": TableSpec(
        _ordered(
            "raceId driverId lap position time milliseconds",
            whole="raceId driverId milliseconds",
            small="lap position",
            text="time",
        ),
        spans={"time_timedelta": (lap_time, "time")},
        seconds={"time_seconds": "time_timedelta"},
    ),
    "pit_stops": TableSpec(
        _ordered(
            "raceId driverId stop lap time duration milliseconds",
            whole="raceId driverId milliseconds",
            small="stop lap",
            clock="time",
            real="duration",
        )
    ),
    "qualifying": TableSpec(
        _ordered(
            "qualifyId raceId driverId constructorId number position q1 q2 q3",
            whole="qualifyId raceId driverId constructorId",
            small="number position",
            text="q1 q2 q3",
        ),
        spans={f"{q}_timedelta": (lap_time, q) for q in ("q1", "q2", "q3")},
        seconds={f"{q}_seconds": f"{q}_timedelta" for q in ("q1", "q2", "q3")},
    ),
    "races": TableSpec(
        _ordered(
            "raceId year round circuitId name date time url"
            " fp1_date fp1_time fp2_date fp2_time fp3_date fp3_time"
            " quali_date quali_time sprint_date sprint_time",
            whole="raceId circuitId",
            small="year round",
            text="name url",
            day="date fp1_date fp2_date fp3_date quali_date sprint_date",
            clock="time fp1_time fp2_time fp3_time quali_time sprint_time",
        )
    ),
    "results": TableSpec(
        _ordered(
            "resultId raceId driverId constructorId number grid position positionText positionOrder"
            " points laps time milliseconds fastestLap rank fastestLapTime fastestLapSpeed statusId",
            whole="resultId raceId driverId constructorId milliseconds statusId",
            small="number grid position positionOrder laps fastestLap rank",
            real="points fastestLapSpeed",
            text="positionText time fastestLapTime",
        ),
        spans={
            "time_timedelta": (result_time, "time"),
            "fastestLapTime_timedelta": (fastest_lap_time, "fastestLapTime"),
        },
    ),
    "seasons": TableSpec(_ordered("year url", small="year", trim="url")),
    "sprint_results": TableSpec(
        _ordered(
            "resultId raceId driverId constructorId number grid position positionText positionOrder"
            " points laps time milliseconds fastestLap fastestLapTime statusId",
            whole="resultId raceId driverId constructorId milliseconds statusId",
            small="number grid position positionOrder laps fastestLap",
            real="points",
            text="positionText time fastestLapTime",
        ),
        spans={
            "time_timedelta": (sprint_time, "time"),
            "fastestLapTime_timedelta": (fastest_lap_time, "fastestLapTime"),
        },
    ),
    "status": TableSpec(_ordered("statusId status", whole="statusId", trim="status")),
}
