from gridstats.functions.exprs import (
    NULL_MARKERS,
    age_at_year_end,
    clip,
    clock_time,
    count_where,
    decade,
    fastest_lap_time,
    half_even,
    is_true,
    lap_time,
    linear_weight,
    pearson,
    present,
    ratio,
    result_time,
    seconds_of,
    sprint_time,
    to_day,
    to_double,
    to_whole,
    top_k,
    trimmed,
)

__all__ = [
    "NULL_MARKERS",
    "age_at_year_end",
    "clip",
    "clock_time",
    "count_where",
    "decade",
    "fastest_lap_time",
    "half_even",
    "is_true",
    "lap_time",
    "linear_weight",
    "pearson",
    "present",
    "ratio",
    "result_time",
    "seconds_of",
    "sprint_time",
    "to_day",
    "to_double",
    "to_whole",
    "top_k",
    "trimmed",
]
