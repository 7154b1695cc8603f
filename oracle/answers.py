"""The expected answer of every registered query, as one DuckDB statement each.

Doubles are rounded to six digits and days shown as text, as in the queries.
"""

from oracle.tables import TABLES

DRIVER, OTHER = "Supplier#000000001", "Supplier#000000002"
START = 1997
ORACLE: dict[str, str] = {}


def answer(name: str, select: str, **ctes: str) -> None:
    extra = "".join(f",\n{cte} AS ({body})" for cte, body in ctes.items())
    ORACLE[name] = f"{TABLES}{extra}\n{select}"


def corr(x: str, y: str) -> str:
    both = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    spread = f"nullif(stddev_pop({x}) {both} * stddev_pop({y}) {both}, 0)"
    return f"covar_pop({y}, {x}) {both} / {spread}"


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) AS {name}"


# --- cleaning --------------------------------------------------------------

answer("clean_circuits", "SELECT * FROM circuits")
answer(
    "clean_constructor_results",
    "SELECT * REPLACE (coalesce(status, 'Unknown') AS status) FROM constructor_results",
)
answer("clean_constructor_standings", "SELECT * FROM constructor_standings")
answer("clean_constructors", "SELECT * FROM constructors")
answer("clean_driver_standings", "SELECT * FROM driver_standings")
answer("clean_drivers", "SELECT * REPLACE (CAST(dob AS VARCHAR) AS dob) FROM drivers")
answer(
    "clean_lap_times",
    f"""SELECT DISTINCT *, {r6('milliseconds / 1000.0', 'time_timedelta')},
    {r6('milliseconds / 1000.0', 'time_seconds')} FROM lap_times""",
)
answer("clean_pit_stops", "SELECT DISTINCT * FROM pit_stops")
_q = ", ".join(
    f"CASE WHEN {q} IS NOT NULL THEN round(({75000 - i * 400} + position * 53) / 1000.0, 6) END AS {q}_{kind}"
    for i, q in enumerate(("q1", "q2", "q3"))
    for kind in ("timedelta", "seconds")
)
answer("clean_qualifying", f"SELECT *, {_q} FROM qualifying")
_days = ["date", "fp1_date", "fp2_date", "fp3_date", "quali_date", "sprint_date"]
_as_text = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in _days)
answer("clean_races", f"SELECT * REPLACE ({_as_text}) FROM races")
_gap = "(positionOrder - 1) * 1234 / 1000.0::DOUBLE"
answer(
    "clean_results",
    f"""SELECT * EXCLUDE (fast_ms), round(CASE WHEN position IS NULL OR positionOrder > 20 THEN NULL
      WHEN positionOrder = 1 THEN 5401.234::DOUBLE ELSE {_gap} END, 6) AS time_timedelta,
    round(fast_ms / 1000.0::DOUBLE, 6) AS "fastestLapTime_timedelta" FROM results""",
)
answer("clean_seasons", "SELECT * FROM seasons")
answer(
    "clean_sprint_results",
    f"""SELECT * EXCLUDE (fast_ms), round(CASE WHEN position IS NULL OR positionOrder > 20 THEN NULL
      WHEN positionOrder = 1 THEN 1500.617::DOUBLE ELSE {_gap} END, 6) AS time_timedelta,
    round(fast_ms / 1000.0, 6) AS "fastestLapTime_timedelta" FROM sprint_results""",
)
answer("clean_status", "SELECT * FROM status")
answer(
    "dst_rows",
    """SELECT rows_before, rows_after, rows_before - rows_after AS removed
    FROM (SELECT count(*) + count(*) FILTER (WHERE raceId % 10 = 0) AS rows_before FROM lap_times),
      (SELECT count(*) AS rows_after FROM (SELECT DISTINCT * FROM lap_times))""",
)

for _name, _same in [
    ("src_csv", "clean_circuits"),
    ("snk_csv", "clean_circuits"),
    ("cols_strip", "clean_circuits"),
    ("src_csv_nulls", "clean_qualifying"),
    ("src_named", "clean_lap_times"),
    ("dst_rows_few_copies", "dst_rows"),
    ("clean_results_few_copies", "clean_results"),
]:
    ORACLE[_name] = ORACLE[_same]

answer(
    "src_glob",
    "\nUNION ALL ".join(
        f"""SELECT '{t}' AS name, '{x}' AS x_name, 'raceId' AS y_name, CAST({x} AS VARCHAR) AS x, CAST(raceId AS VARCHAR) AS y FROM {t}"""
        for t, x in (
            ("constructor_standings", "constructorStandingsId"),
            ("driver_standings", "driverStandingsId"),
            ("results", "resultId"),
        )
    ),
)

# --- profiles and charts ---------------------------------------------------

_RESULT_TYPES = {
    "resultId": "bigint", "raceId": "bigint", "driverId": "bigint", "constructorId": "bigint", "number": "int",
    "grid": "int", "position": "int", "positionText": "string", "positionOrder": "int", "points": "double",
    "laps": "int", "time": "string", "milliseconds": "bigint", "fastestLap": "int", "rank": "int",
    "fastestLapTime": "string", "fastestLapSpeed": "double", "statusId": "bigint",
}
answer(
    "profile_table",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS type, count(*) AS rows,
        count(*) FILTER (WHERE "{c}" IS NULL) AS nulls FROM results"""
        for c, t in _RESULT_TYPES.items()
    ),
)
_CR_TYPES = {"constructorResultsId": "bigint", "raceId": "bigint", "constructorId": "bigint", "points": "double"}
answer(
    "profile_before_after",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{'string' if stage == 'before' else t}' AS type,
        count(*){' + count(*) FILTER (WHERE constructorResultsId % 10 = 0)' if stage == 'before' else ''} AS rows,
        0 AS nulls, '{stage}' AS stage FROM constructor_results"""
        for stage in ("before", "after")
        for c, t in {**_CR_TYPES, "status": "string"}.items()
    ),
)
answer("profile_head", "SELECT * FROM circuits ORDER BY circuitId LIMIT 5")
answer("profile_first_two", "SELECT raceId, driverId FROM lap_times")


def _histogram(source: str, value: str) -> str:
    return f"""SELECT b AS bin, count(v) AS n, round(any_value(lo) + (b - 1) * any_value(w), 6) AS low,
      round(any_value(lo) + b * any_value(w), 6) AS high
    FROM (SELECT unnest(range(1, 21)) AS b), (SELECT min({value}) AS lo, (max({value}) - min({value})) / 20.0::DOUBLE AS w FROM {source}) e
    LEFT JOIN (SELECT {value} AS v FROM {source}) x
      ON least(floor((v - lo) / w) + 1, 20) = b
    GROUP BY b"""


answer("eda_position_hist", _histogram("m", "positionOrder"))
answer(
    "eda_position_density",
    """SELECT g AS point, round(lo + g * step, 6) AS x,
      round(sum(w * exp(-0.5 * ((lo + g * step - v) / h) * ((lo + g * step - v) / h))) / (any_value(h) * any_value(n) * sqrt(2 * pi())), 6) AS density
    FROM (SELECT unnest(range(0, 200)) AS g), counts, facts GROUP BY g, lo, step""",
    counts="SELECT positionOrder AS v, count(*) AS w FROM m GROUP BY ALL",
    facts="""SELECT min(positionOrder) AS lo, (max(positionOrder) - min(positionOrder)) / 199.0::DOUBLE AS step,
      count(*) AS n, stddev_samp(positionOrder) * pow(count(*), -0.2) AS h FROM m""",
)
answer("eda_grid_finish", "SELECT resultId, grid, positionOrder FROM m")
answer("eda_grid_finish_corr", f"SELECT {r6(corr('grid', 'positionOrder'), 'correlation')} FROM m")
answer(
    "eda_top_drivers",
    """SELECT driverId, forename, surname, sum(points) AS points FROM m GROUP BY ALL
    ORDER BY points DESC, driverId LIMIT 10""",
)
answer(
    "eda_circuit_points",
    """SELECT circuit_name, round(p, 6) AS points FROM (SELECT circuit_name, avg(points) AS p FROM m GROUP BY ALL)
    ORDER BY round(p, 9) DESC, circuit_name LIMIT 10""",
)
answer("eda_status_counts", "SELECT status, count(*) AS n FROM m GROUP BY ALL ORDER BY n DESC, status LIMIT 10")
answer("eda_yearly_points", "SELECT year, round(avg(points), 6) AS points FROM m GROUP BY ALL")
answer("dst_names", 'SELECT DISTINCT "driverRef" FROM m ORDER BY 1')

# --- masters ---------------------------------------------------------------

_RACE = ", ".join(
    [
        "year", "round", "circuitId", "a.name AS race_name", "CAST(a.date AS VARCHAR) AS race_date",
        "a.time AS race_time", "a.url AS race_url",
        *[f"CAST({d} AS VARCHAR) AS {d}, {d.replace('_date', '_time')}" for d in _days[1:]],
    ]
)
_DRIVER = """driverRef, d.number AS driver_number, code, forename, surname, CAST(dob AS VARCHAR) AS dob,
  d.nationality AS driver_nationality, d.url AS driver_url"""
_TEAM = """constructorRef, k.name AS constructor_name, k.nationality AS constructor_nationality,
  k.url AS constructor_url"""
_CIRCUIT = "circuitRef, c.name AS circuit_name, location, country, lat, lng, alt, c.url AS circuit_url"
_JOIN_RACE = "LEFT JOIN races a ON f.raceId = a.raceId"
_JOIN_DRIVER = "LEFT JOIN drivers d ON f.driverId = d.driverId"
_JOIN_TEAM = "LEFT JOIN constructors k ON f.constructorId = k.constructorId"

answer(
    "master_race_results",
    f"""SELECT * REPLACE (CAST(race_date AS VARCHAR) AS race_date, CAST(dob AS VARCHAR) AS dob,
    {', '.join(f'CAST({d} AS VARCHAR) AS {d}' for d in _days[1:])}) FROM m""",
)
answer(
    "master_qualifying",
    f"SELECT f.*, {_RACE}, {_DRIVER}, {_TEAM} FROM qualifying f {_JOIN_RACE} {_JOIN_DRIVER} {_JOIN_TEAM}",
)
answer(
    "master_sprint_results",
    f"""SELECT f.* EXCLUDE (time, fast_ms), f.time AS result_time, {_RACE}, {_DRIVER}, {_TEAM}
    FROM sprint_results f {_JOIN_RACE} {_JOIN_DRIVER} {_JOIN_TEAM}""",
)
answer(
    "master_pit_stops",
    f"""SELECT f.* EXCLUDE (time), f.time AS stop_time, {_RACE}, {_DRIVER}
    FROM pit_stops f {_JOIN_RACE} {_JOIN_DRIVER}""",
)
answer(
    "master_lap_times",
    f"""SELECT f.* EXCLUDE (time), f.time AS lap_time, {_RACE.replace('circuitId', 'a.circuitId')}, {_DRIVER}, {_CIRCUIT}
    FROM lap_times f {_JOIN_RACE} {_JOIN_DRIVER} LEFT JOIN circuits c ON a.circuitId = c.circuitId""",
)

# --- A1, A2, A3 ------------------------------------------------------------

answer(
    "a01_driver_win_ratio",
    """SELECT driverId, driverRef, round(x, 6) AS win_ratio FROM (
      SELECT driverId, driverRef, count(*) FILTER (WHERE position = 1) / count(*) AS x FROM m GROUP BY ALL)
    ORDER BY round(x, 9) DESC, driverId LIMIT 5""",
)
answer(
    "a01_driver_win_ratio_order",
    """SELECT driverId, driverRef, round(x, 6) AS win_ratio FROM (
      SELECT driverId, driverRef, count(*) FILTER (WHERE positionOrder = 1) / count(*) AS x FROM m GROUP BY ALL)
    ORDER BY round(x, 9) DESC, driverId LIMIT 10""",
)
answer(
    "a01_constructor_wins",
    """SELECT constructorId, constructorRef, count(*) AS wins FROM m WHERE position = 1 GROUP BY ALL
    ORDER BY wins DESC, constructorId LIMIT 5""",
)
answer(
    "a01_podiums_points",
    """SELECT driverId, count(*) FILTER (WHERE position IN (1, 2, 3)) AS podiums, sum(points) AS points,
    count(*) AS races FROM m GROUP BY ALL""",
)
answer(
    "a01_constructor_podiums",
    "SELECT constructorId, count(*) AS podiums FROM m WHERE position IN (1, 2, 3) GROUP BY ALL",
)
answer(
    "a02_position_gain",
    """SELECT driverId, driverRef, round(x, 6) AS position_gain FROM (
      SELECT driverId, driverRef, avg(grid - position) AS x FROM m GROUP BY ALL)
    ORDER BY round(x, 9) DESC NULLS LAST, driverId LIMIT 5""",
)
answer(
    "a02_grid_points",
    f"SELECT resultId, driverRef, grid, position, points, driverRef = '{DRIVER}' AS selected FROM m",
)
answer("a03_pit_counts", "SELECT * FROM pits")
answer(
    "a03_pit_corr_filled",
    f"""SELECT {r6(corr('pit_stops', 'p'), 'correlation')}
    FROM (SELECT pit_stops, coalesce(position, 0) AS p FROM stops)""",
)
answer(
    "a03_pit_corr",
    f"""SELECT round(x, 6) AS correlation, CASE WHEN x > 0 THEN 'positive' ELSE 'negative' END AS sign,
    CASE WHEN abs(x) < 0.3 THEN 'weak' WHEN abs(x) < 0.7 THEN 'moderate' ELSE 'strong' END AS strength
    FROM (SELECT {corr('pit_stops', 'position')} AS x FROM stops WHERE position BETWEEN 1 AND 20)""",
)
answer(
    "a03_pits_by_position",
    """SELECT position, round(avg(pit_stops), 6) AS pit_stops FROM stops
    WHERE position IS NOT NULL GROUP BY ALL""",
)
answer(
    "a03_pits_by_position_filled",
    """SELECT coalesce(position, 0) AS position, round(avg(pit_stops), 6) AS pit_stops FROM stops GROUP BY 1""",
)
answer(
    "a03_pit_trend",
    """SELECT round(regr_slope(pit_stops, position), 6) AS slope, round(regr_intercept(pit_stops, position), 6) AS intercept,
    round(regr_r2(pit_stops, position), 6) AS r2 FROM stops WHERE position IS NOT NULL""",
)
answer(
    "a03_pit_duration",
    """SELECT m.raceId, m.driverId, positionOrder, round(duration, 6) AS duration
    FROM m LEFT JOIN (SELECT raceId, driverId, avg(duration) AS duration FROM pit_stops GROUP BY ALL) p
    ON m.raceId = p.raceId AND m.driverId = p.driverId""",
)

# --- A4, A5 ----------------------------------------------------------------

_PAIRS = {
    "finishes": "SELECT raceId, driverId, avg(position) AS position FROM m WHERE position IS NOT NULL GROUP BY ALL",
    "pairs": f"""SELECT x.driverId AS a, y.driverId AS b, count(*) AS races,
      {corr('x.position', 'y.position')} AS correlation, avg(abs(x.position - y.position)) AS diff
      FROM finishes x JOIN finishes y ON x.raceId = y.raceId AND x.driverId < y.driverId GROUP BY ALL""",
    "names": 'SELECT driverId, min("driverRef") AS name FROM m GROUP BY ALL',
    "closest": """SELECT a, b, correlation, diff FROM pairs WHERE correlation IS NOT NULL
      ORDER BY round(diff, 9), a, b LIMIT 5""",
}
answer(
    "a04_driver_race_pos",
    """SELECT driverId, raceId, avg(position) AS position FROM m WHERE position IS NOT NULL GROUP BY ALL""",
)
answer(
    "a04_pair_table",
    """SELECT a, b, races, round(correlation, 6) AS correlation, round(diff, 6) AS avg_finish_diff FROM pairs""",
    **_PAIRS,
)
answer(
    "a04_corr_pairs",
    """SELECT driver_1, driver_2, round(correlation, 6) AS correlation FROM (
      SELECT a AS driver_1, b AS driver_2, correlation FROM pairs
      UNION ALL SELECT b, a, correlation FROM pairs)
    WHERE round(correlation, 9) <> 1 ORDER BY round(correlation, 9) DESC, driver_1, driver_2 LIMIT 5""",
    **_PAIRS,
)
answer(
    "a04_rivalries",
    """SELECT a AS driver_1_id, p.name AS driver_1_name, b AS driver_2_id, q.name AS driver_2_name,
    round(correlation, 6) AS correlation, round(diff, 6) AS avg_finish_diff
    FROM closest JOIN names p ON a = p.driverId JOIN names q ON b = q.driverId""",
    **_PAIRS,
)
answer(
    "a04_rivalry_drivers",
    """SELECT driverId, name AS driverRef, driverId || ' - ' || name AS option FROM names
    WHERE driverId IN (SELECT a FROM closest UNION SELECT b FROM closest)""",
    **_PAIRS,
)
_TWO = {
    "two": """SELECT raceId, avg(CASE WHEN driverId = 1 THEN position END) AS position_1,
      avg(CASE WHEN driverId = 2 THEN position END) AS position_2 FROM m WHERE driverId IN (1, 2) GROUP BY raceId
      HAVING position_1 IS NOT NULL AND position_2 IS NOT NULL"""
}
answer("a04_pair_races", "SELECT * FROM two", **_TWO)
answer(
    "a04_rivals_of",
    f"""SELECT o.driverId AS opponent, count(*) AS races, {r6(corr('a.p', 'o.p'), 'correlation')},
    {r6('avg(abs(a.p - o.p))', 'avg_finish_diff')}
    FROM finishes a JOIN finishes o ON a.raceId = o.raceId AND a.driverId = 1 AND o.driverId <> 1 GROUP BY o.driverId""",
    finishes="""SELECT driverId, raceId, avg(position) AS p FROM m WHERE position IS NOT NULL GROUP BY ALL""",
)
answer(
    "a04_pair_detail",
    f"""SELECT count(*) AS races, {r6(corr('position_1', 'position_2'), 'correlation')},
    {r6('avg(abs(position_1 - position_2))', 'avg_finish_diff')} FROM two""",
    **_TWO,
)
_DUEL = {
    "common": "SELECT year FROM m WHERE driverId = 1 INTERSECT SELECT year FROM m WHERE driverId = 2",
    "duel": """SELECT driverId AS side, * FROM m WHERE driverId IN (1, 2) AND year IN (SELECT year FROM common)""",
    "team_perf": "SELECT year, constructorId, avg(position) AS perf FROM m GROUP BY ALL",
    "first_team": """SELECT side, year, constructorId FROM duel
      QUALIFY row_number() OVER (PARTITION BY side, year ORDER BY round, resultId) = 1""",
    "factors": """SELECT f.year, max(CASE WHEN side = 1 THEN perf END) AS t1, max(CASE WHEN side = 2 THEN perf END) AS t2
      FROM first_team f JOIN team_perf t ON f.year = t.year AND f.constructorId = t.constructorId
      GROUP BY f.year HAVING count(*) = 2""",
    "scaled": """SELECT side, driverRef, position,
      position * (CASE side WHEN 1 THEN t2 ELSE t1 END) / (CASE side WHEN 1 THEN t1 ELSE t2 END) AS s
      FROM duel JOIN factors ON duel.year = factors.year""",
}
answer("a05_common_seasons", "SELECT year FROM common", **_DUEL)
answer("a05_team_perf", "SELECT year, constructorId, round(perf, 6) AS team_position FROM team_perf", **_DUEL)
answer(
    "a05_original_avg",
    """SELECT side, driverRef, round(avg(position), 6) AS original_position FROM duel GROUP BY ALL""",
    **_DUEL,
)
answer(
    "a05_swap_scaled",
    """SELECT side, driverRef, CASE WHEN count(s) = count(*) THEN round(avg(s), 6) END AS swapped_position
    FROM scaled GROUP BY ALL""",
    **_DUEL,
)
answer(
    "a05_swap_expected",
    """SELECT side, driverRef, round(avg(s), 6) AS expected_position,
    round(sqrt(var_pop(s) + avg((0.1 * position) * (0.1 * position))), 6) AS deviation
    FROM scaled WHERE position IS NOT NULL GROUP BY ALL""",
    **_DUEL,
)

# --- A6, A7, A8 ------------------------------------------------------------

_STEPS = {
    "steps": """SELECT driverRef, year, round, constructorId AS from_id, constructorRef AS from_team,
      lead(constructorId) OVER w AS to_id, lead(constructorRef) OVER w AS to_team, lead(resultId) OVER w AS nxt
      FROM m WINDOW w AS (PARTITION BY driverId ORDER BY year, round, resultId)"""
}
_EDGES = """SELECT from_id, to_id, min(from_team) AS from_team, min(to_team) AS to_team, count(*) AS steps,
  min(year) AS first_year, max(year) AS last_year FROM steps WHERE nxt IS NOT NULL {} GROUP BY from_id, to_id"""
answer("a06_steps_all", _EDGES.format(""), **_STEPS)
answer("a06_moves", _EDGES.format("AND from_id <> to_id"), **_STEPS)
answer(
    "a06_moves_driver",
    f"""SELECT from_id, to_id, from_team, to_team, year, round FROM steps
    WHERE driverRef = '{DRIVER}' AND nxt IS NOT NULL AND from_id <> to_id""",
    **_STEPS,
)
_RATES = {
    "podium": """SELECT constructorId, constructorRef,
      nullif(count(*) FILTER (WHERE position <= 3), 0) / count(*) AS rate FROM m GROUP BY ALL""",
    "top_teams": "SELECT * FROM podium ORDER BY round(rate, 9) DESC NULLS LAST, constructorId LIMIT 10",
    "seen": """SELECT circuitId, constructorId, count(*) FILTER (WHERE position <= 3) / count(*) AS rate
      FROM m GROUP BY ALL""",
    "best": "SELECT raceId, constructorId, min(position) AS p FROM m GROUP BY ALL",
    "h2h": """SELECT x.constructorId AS team, y.constructorId AS opponent, count(*) AS races,
      avg(CASE WHEN x.p < y.p THEN 1.0 ELSE 0.0 END) AS ratio
      FROM best x JOIN best y ON x.raceId = y.raceId AND x.constructorId <> y.constructorId GROUP BY ALL""",
}
answer("a07_podium_rate", "SELECT constructorId, constructorRef, round(rate, 6) AS podium_rate FROM top_teams", **_RATES)
answer(
    "a07_circuit_rate",
    """SELECT c.circuitId, t.constructorId, round(coalesce(rate, 0), 6) AS podium_rate
    FROM (SELECT DISTINCT circuitId FROM seen) c CROSS JOIN (SELECT DISTINCT constructorId FROM seen) t
    LEFT JOIN seen s ON s.circuitId = c.circuitId AND s.constructorId = t.constructorId""",
    **_RATES,
)
answer(
    "a07_circuit_rate_mean",
    """SELECT constructorId, round(x, 6) AS mean_circuit_rate FROM (
      SELECT constructorId, sum(rate) / (SELECT count(DISTINCT circuitId) FROM seen) AS x FROM seen GROUP BY ALL)
    ORDER BY round(x, 9) DESC, constructorId LIMIT 5""",
    **_RATES,
)
answer(
    "a07_circuit_rate_top",
    """SELECT c.circuitId, t.constructorId, round(coalesce(s.rate, 0), 6) AS podium_rate
    FROM (SELECT circuitId FROM m GROUP BY ALL ORDER BY count(*) DESC, circuitId LIMIT 10) c CROSS JOIN top_teams t
    LEFT JOIN seen s ON s.circuitId = c.circuitId AND s.constructorId = t.constructorId""",
    **_RATES,
)
answer(
    "a07_h2h_team",
    "SELECT team, opponent, races, round(ratio, 6) AS win_ratio FROM h2h",
    **_RATES,
)
answer(
    "a07_h2h_team_circuit",
    """SELECT x.constructorId AS team, y.constructorId AS opponent, count(*) AS races,
      round(avg(CASE WHEN x.p < y.p THEN 1.0 ELSE 0.0 END), 6) AS win_ratio, count(DISTINCT x.circuitId) AS circuits
      FROM places x JOIN places y ON x.raceId = y.raceId AND x.circuitId = y.circuitId
      AND x.constructorId <> y.constructorId GROUP BY ALL""",
    places="SELECT circuitId, raceId, constructorId, min(position) AS p FROM m GROUP BY ALL",
)
answer(
    "a07_h2h_matrix",
    """SELECT team, opponent, races, round(ratio, 6) AS win_ratio, a.constructorRef AS team_name,
    b.constructorRef AS opponent_name
    FROM h2h JOIN top_teams a ON team = a.constructorId JOIN top_teams b ON opponent = b.constructorId""",
    **_RATES,
)
_CONSISTENCY = {
    "cons": """SELECT driverId, driverRef AS driver_name, round(stddev_samp(position), 9) AS position_std,
      avg(position) AS avg_position, count(position) AS races,
      round_even((nullif(count(*) FILTER (WHERE position <= 10), 0) / count(*) * 100) * 100, 0) / 100 AS top_10_ratio
      FROM m GROUP BY ALL HAVING count(position) >= 10"""
}
_cons = """SELECT * REPLACE (round(position_std, 6) AS position_std, round(avg_position, 6) AS avg_position) FROM cons"""
answer("a08_consistency", _cons, **_CONSISTENCY)
answer(
    "a08_consistent",
    f"""SELECT * FROM ({_cons} WHERE avg_position < 100 AND cons.position_std < (SELECT median(position_std) FROM cons)
    ORDER BY cons.position_std, driverId LIMIT 5)""",
    **_CONSISTENCY,
)
answer(
    "a08_fluctuating",
    f"SELECT * FROM ({_cons} ORDER BY cons.position_std DESC NULLS LAST, driverId LIMIT 5)",
    **_CONSISTENCY,
)

# --- A9 --------------------------------------------------------------------

_LAPS = {
    "driven": """SELECT a.circuitId, l.raceId, l.driverId, r.constructorId, l.milliseconds AS ms
      FROM lap_times l JOIN races a ON l.raceId = a.raceId JOIN results r ON l.raceId = r.raceId AND l.driverId = r.driverId""",
    "avg_laps": "SELECT circuitId, driverId, constructorId, avg(ms) AS avg_ms FROM driven GROUP BY ALL",
    "eff": """SELECT a.*, fastest_ms, fastest_ms / avg_ms AS e FROM avg_laps a
      JOIN (SELECT circuitId, min(ms) AS fastest_ms FROM driven GROUP BY ALL) f ON a.circuitId = f.circuitId""",
    "cells": "SELECT constructorId, circuitId, avg(e) AS e FROM eff GROUP BY ALL",
    "cell_grid": """SELECT t.constructorId, c.circuitId, round(coalesce(e, 0), 6) AS efficiency_ratio
      FROM (SELECT DISTINCT constructorId FROM cells) t CROSS JOIN (SELECT DISTINCT circuitId FROM cells) c
      LEFT JOIN cells s ON s.circuitId = c.circuitId AND s.constructorId = t.constructorId""",
    "boxes": """SELECT circuitId, count(*) AS n, quantile_cont(CAST(ms AS DOUBLE), 0.25) AS q1,
      quantile_cont(CAST(ms AS DOUBLE), 0.5) AS median, quantile_cont(CAST(ms AS DOUBLE), 0.75) AS q3
      FROM driven GROUP BY ALL""",
}
answer("a09_avg_laps", "SELECT circuitId, driverId, constructorId, round(avg_ms, 6) AS avg_ms FROM avg_laps", **_LAPS)
answer(
    "a09_efficiency",
    """SELECT circuitId, driverId, constructorId, round(avg_ms, 6) AS avg_ms, fastest_ms, round(e, 6) AS efficiency_ratio
    FROM eff""",
    **_LAPS,
)
for _name, _key, _label, _source in [
    ("a09_team_eff", "constructorId", "constructorRef", "constructors"),
    ("a09_driver_eff", "driverId", "driverRef", "drivers"),
]:
    answer(
        _name,
        f"""SELECT x.{_key}, {_label}, round(e, 6) AS efficiency_ratio
        FROM (SELECT {_key}, avg(e) AS e FROM eff GROUP BY ALL) x JOIN {_source} n ON x.{_key} = n.{_key}
        ORDER BY round(e, 9) DESC, x.{_key} LIMIT 5""",
        **_LAPS,
    )
answer(
    "a09_team_circuit",
    "SELECT * FROM cell_grid",
    **_LAPS,
)
_WINS = {
    "won": "SELECT driverId, circuitId, CAST(count(*) AS DOUBLE) AS wins FROM m WHERE position = 1 GROUP BY ALL",
    "drivers_met": "SELECT DISTINCT driverId FROM m",
    "circuits_met": "SELECT DISTINCT circuitId FROM m",
    "win_grid": """SELECT driverId, circuitId, coalesce(wins, 0.0) AS wins, wins IS NOT NULL AS present
      FROM drivers_met CROSS JOIN circuits_met LEFT JOIN won USING (driverId, circuitId)""",
}
answer(
    "rs_unstack",
    """SELECT driverId, circuitId, wins FROM won UNION ALL SELECT driverId, NULL, 0.0 FROM drivers_met
    UNION ALL SELECT NULL, circuitId, 0.0 FROM circuits_met""",
    **_WINS,
)
answer(
    "rs_unstack_mean",
    """SELECT driverId, count(*) FILTER (WHERE present) AS present, count(*) FILTER (WHERE NOT present) AS absent,
    round(avg(wins), 6) AS mean FROM win_grid GROUP BY driverId""",
    **_WINS,
)
answer(
    "rs_unstack_chosen",
    """SELECT driverId, circuitId, wins FROM win_grid
    WHERE driverId IN (SELECT driverId FROM m GROUP BY ALL ORDER BY count(position) DESC, driverId LIMIT 5)""",
    **_WINS,
)
answer(
    "a09_team_circuit_display",
    """SELECT * FROM cell_grid
    WHERE constructorId IN (SELECT DISTINCT constructorId FROM cells ORDER BY 1 LIMIT 5)""",
    **_LAPS,
)
answer(
    "rs_pivot_agg",
    "SELECT constructorId, "
    + ", ".join(
        f"round(coalesce(avg(e) FILTER (WHERE circuitId = {c}), 0), 6) AS circuitId_{c}" for c in range(25)
    )
    + " FROM eff GROUP BY constructorId",
    **_LAPS,
)
_BOX = """SELECT b.{key}, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  CAST(min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1)) AS DOUBLE) AS whisker_low,
  CAST(max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1)) AS DOUBLE) AS whisker_high,
  count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
  FROM boxes b JOIN {source} s ON b.{key} = s.{key} GROUP BY b.{key}, n, q1, median, q3"""
answer(
    "a09_lap_box", _BOX.format(key="circuitId", source="(SELECT circuitId, ms AS v FROM driven)"), **_LAPS
)

# --- A10, A11, A12 ---------------------------------------------------------

_SCORES = {
    "stats": """SELECT driverId, driverRef AS driver_name, round_even(sum(points) * 100, 0) / 100 AS total_points,
      round_even(avg(points) * 100, 0) / 100 AS avg_points, round_even(avg(position) * 100, 0) / 100 AS avg_position,
      round_even(stddev_samp(position) * 100, 0) / 100 AS position_std, count(raceId) AS races,
      round_even(count(*) FILTER (WHERE position <= 3) / count(raceId) * 1000, 0) / 1000 AS podium_ratio,
      round_even(count(*) FILTER (WHERE position = 1) / count(raceId) * 1000, 0) / 1000 AS win_ratio
      FROM m WHERE year >= (SELECT max(year) FROM m) - 3 GROUP BY ALL HAVING count(raceId) >= 10""",
    "bounds": """SELECT min(avg_points) AS a0, max(avg_points) AS a1, min(podium_ratio) AS p0, max(podium_ratio) AS p1,
      min(win_ratio) AS w0, max(win_ratio) AS w1, max(position_std) AS s1 FROM stats""",
    "norms": """SELECT stats.*, (avg_points - a0) / nullif(a1 - a0, 0) AS avg_points_norm,
      (podium_ratio - p0) / nullif(p1 - p0, 0) AS podium_ratio_norm,
      (win_ratio - w0) / nullif(w1 - w0, 0) AS win_ratio_norm, 1 - position_std / nullif(s1, 0) AS consistency_score
      FROM stats, bounds""",
    "scores": """SELECT *, avg_points_norm * 0.3 + podium_ratio_norm * 0.25 + win_ratio_norm * 0.25
      + consistency_score * 0.2 AS final_score FROM norms""",
    "ranked_scores": "SELECT * FROM scores ORDER BY round(final_score, 9) DESC NULLS LAST, driverId",
}
_shown = """SELECT * REPLACE (round(avg_points_norm, 6) AS avg_points_norm, round(podium_ratio_norm, 6) AS podium_ratio_norm,
  round(win_ratio_norm, 6) AS win_ratio_norm, round(consistency_score, 6) AS consistency_score,
  round(final_score, 6) AS final_score) FROM """
answer("a10_driver_scores", f"{_shown} scores", **_SCORES)
answer("a10_lineup", f"{_shown} (SELECT * FROM ranked_scores LIMIT 5)", **_SCORES)
answer(
    "a10_pair",
    "SELECT driverId, driver_name, round(final_score, 6) AS final_score FROM (SELECT * FROM ranked_scores LIMIT 2)",
    **_SCORES,
)
answer(
    "a10_pair_stats",
    """SELECT round(sum(total_points), 6) AS total_points, round(avg(avg_points), 6) AS avg_points,
    round(sum(podium_ratio * races), 6) AS podiums, round(sum(win_ratio * races), 6) AS wins,
    round(avg(consistency_score), 6) AS avg_consistency FROM (SELECT * FROM ranked_scores LIMIT 2)""",
    **_SCORES,
)
_WEIGHTED = {
    "weighted": f"""SELECT *, points * ((year - {START - 1}) / ((SELECT max(year) FROM m) - {START - 1})) AS w
      FROM m WHERE year >= {START}"""
}
answer(
    "a11_weighted_drivers",
    """SELECT driverId, driverRef, round(x, 6) AS weighted_points, points, round(p, 6) AS avg_position FROM (
      SELECT driverId, driverRef, sum(w) AS x, sum(points) AS points, avg(position) AS p FROM weighted GROUP BY ALL)
    ORDER BY round(x, 9) DESC, driverId LIMIT 3""",
    **_WEIGHTED,
)
answer(
    "a11_weighted_constructors",
    """SELECT constructorId, constructorRef, round(x, 6) AS weighted_points, points FROM (
      SELECT constructorId, constructorRef, sum(w) AS x, sum(points) AS points FROM weighted GROUP BY ALL)
    ORDER BY round(x, 9) DESC, constructorId LIMIT 3""",
    **_WEIGHTED,
)
_FORECAST = {
    "flagged": f"""SELECT resultId, raceId, driverId, driverRef, constructorId, year, round, grid, position, points,
      CASE WHEN position <= 3 THEN 1 ELSE 0 END AS pod, CASE WHEN position = 1 THEN 1 ELSE 0 END AS win,
      CASE WHEN position IS NULL THEN 1 ELSE 0 END AS dnf FROM m WHERE year >= {START}""",
    "strength": """SELECT year, constructorId, (avg(points) + avg(pod) + avg(win)) / 3 AS team_strength
      FROM flagged GROUP BY ALL""",
    "run": """SELECT f.*, round(team_strength, 6) AS team_strength, lag(points, 1) OVER w AS l1, lag(points, 2) OVER w AS l2,
      lag(points, 3) OVER w AS l3, lag(pod) OVER w AS lpod, lag(win) OVER w AS lwin, lag(dnf) OVER w AS ldnf,
      row_number() OVER w - 1 AS career_experience
      FROM flagged f JOIN strength s ON f.year = s.year AND f.constructorId = s.constructorId
      WINDOW w AS (PARTITION BY driverId ORDER BY f.year, round, resultId)""",
    "rows_now": """SELECT resultId, raceId, driverId, driverRef, constructorId, year, round, grid, position, points,
      pod AS podium_finishes, win AS race_wins, dnf AS did_not_finish, l1 AS previous_season_points,
      round((points + l1 + l2) / 3, 6) AS recent_form, career_experience, team_strength FROM run""",
    "rows_lagged": """SELECT resultId, raceId, driverId, driverRef, constructorId, year, round, grid, position,
  points, lpod AS podium_finishes, lwin AS race_wins, ldnf AS did_not_finish, l1 AS previous_season_points,
  round((l1 + l2 + l3) / 3, 6) AS recent_form, career_experience, team_strength FROM run""",
}
answer("a11_features_same_race", "SELECT * FROM rows_now WHERE recent_form IS NOT NULL", **_FORECAST)
for _name in ("a11_features", "a11_features_lagged"):
    answer(_name, "SELECT * FROM rows_lagged WHERE recent_form IS NOT NULL", **_FORECAST)
answer(
    "a11_inputs",
    """SELECT driverId, driverRef, grid, recent_form, team_strength, career_experience + 1 AS career_experience,
    podium_finishes, race_wins, did_not_finish, points AS previous_season_points, points AS current_points
    FROM rows_lagged WHERE year = (SELECT max(year) FROM rows_lagged)
    QUALIFY row_number() OVER (PARTITION BY driverId ORDER BY round, resultId) = 1""",
    **_FORECAST,
)


def _growth(back: int) -> dict[str, str]:
    return {
        f"near{back}": f"SELECT * FROM m WHERE year >= (SELECT max(year) FROM m) - {back}",
        f"yearly{back}": f"SELECT constructorId, year, sum(points) AS p FROM near{back} GROUP BY ALL",
        f"dense{back}": f"""SELECT t.constructorId, y.year, last_value(p IGNORE NULLS) OVER (
            PARTITION BY t.constructorId ORDER BY y.year) AS p
          FROM (SELECT DISTINCT constructorId FROM near{back}) t CROSS JOIN (SELECT DISTINCT year FROM near{back}) y
          LEFT JOIN yearly{back} s ON s.constructorId = t.constructorId AND s.year = y.year""",
        f"change{back}": f"""SELECT constructorId, p / nullif(lag(p) OVER (PARTITION BY constructorId ORDER BY year), 0) - 1 AS c
          FROM dense{back}""",
        f"growth{back}": f"""SELECT constructorId, coalesce(avg(c), 0) AS point_growth,
          coalesce(stddev_samp(c), 0) AS volatility FROM change{back} GROUP BY ALL""",
    }


answer(
    "a12_growth",
    "SELECT constructorId, round(point_growth, 6) AS point_growth, round(volatility, 6) AS volatility FROM growth4",
    **_growth(4),
)
_LINEAR = {
    **_growth(2),
    "near": "SELECT *, points * ((year - ((SELECT max(year) FROM m) - 3)) / 3) AS w FROM near2",
    "teams2": """SELECT constructorId, constructorRef AS constructor_name, round_even(sum(w) * 100, 0) / 100 AS weighted_points,
      round_even(avg(points) * 100, 0) / 100 AS avg_points, round_even(stddev_samp(points) * 100, 0) / 100 AS points_std,
      round_even(avg(position) * 100, 0) / 100 AS avg_position, round_even(stddev_samp(position) * 100, 0) / 100 AS position_std
      FROM near GROUP BY ALL""",
}
for _name, _dev, _flag in [
    ("a12_risk_linear", "point_growth", "CASE WHEN round(point_growth, 9) < 0 THEN 1.0 ELSE 0.0 END"),
    ("a12_risk_linear_published", "CAST(NULL AS DOUBLE)", "0.0"),
]:
    answer(
        _name,
        f"""SELECT t.*, round({_dev}, 6) AS development_score, round(1 / (points_std + 1), 6) AS consistency_score,
        round(weighted_points / best, 6) AS performance_score,
        round((1 - weighted_points / best) * 0.4 + (1 - 1 / (points_std + 1)) * 0.3 + {_flag} * 0.3, 6) AS risk_score
        FROM teams2 t JOIN growth2 g ON t.constructorId = g.constructorId,
        (SELECT nullif(max(weighted_points), 0) AS best FROM teams2)""",
        **_LINEAR,
    )
_EXP = {
    **_growth(4),
    "near": "SELECT *, points * pow(1.5, year - ((SELECT max(year) FROM m) - 4)) / pow(1.5, 4) AS w FROM near4",
    "teams4": """SELECT constructorId, constructorRef AS constructor_name, round_even(sum(w) * 100, 0) / 100 AS weighted_points,
      round_even(avg(points) * 100, 0) / 100 AS avg_points, round_even(stddev_samp(points) * 100, 0) / 100 AS points_std, count(points) AS race_count,
      round_even(avg(position) * 100, 0) / 100 AS avg_position, round_even(stddev_samp(position) * 100, 0) / 100 AS position_std,
      count(DISTINCT year) AS years_active FROM near GROUP BY ALL""",
    "parts": """SELECT t.*, point_growth, volatility, point_growth AS development_score,
      1 / (greatest(volatility, 0.001) + 1) AS stability_score, years_active / 4 AS participation_score,
      CASE WHEN points_std IS NOT NULL THEN
        least(points_std / CASE WHEN avg_points = 0 THEN 0.001 ELSE avg_points END, 5) END AS consistency_score,
      (SELECT greatest(max(weighted_points), 1) FROM teams4) AS best
      FROM teams4 t JOIN growth4 g ON t.constructorId = g.constructorId""",
    "risk": """SELECT * EXCLUDE (best), coalesce((1 - weighted_points / best) * 0.35 + consistency_score * 0.20
      + (1 - least(greatest(stability_score, 0), 1)) * 0.20
      + CASE WHEN round(development_score, 9) < 0 THEN 1.0 ELSE 0.0 END * 0.15
      + (1 - least(greatest(participation_score, 0), 1)) * 0.10, 1) AS risk_score FROM parts""",
    "riskiest": "SELECT * FROM risk ORDER BY round(risk_score, 9) DESC, constructorId",
}
answer(
    "a12_risk_exp",
    """SELECT * REPLACE (round(point_growth, 6) AS point_growth, round(volatility, 6) AS volatility,
    round(development_score, 6) AS development_score, round(stability_score, 6) AS stability_score,
    round(consistency_score, 6) AS consistency_score, round(risk_score, 6) AS risk_score) FROM risk""",
    **_EXP,
)
answer(
    "a12_risk_level",
    """SELECT constructorId, constructor_name, round(risk_score, 6) AS risk_score, avg_points,
    CASE WHEN risk_score > 0.7 THEN 'High' WHEN risk_score > 0.4 THEN 'Moderate' ELSE 'Low' END AS risk_level,
    CASE WHEN round(development_score, 9) < 0 THEN 'Negative' ELSE 'Positive' END AS trend,
    CASE WHEN stability_score >= 0.5 THEN 'Stable' ELSE 'Volatile' END AS stability,
    printf('%.0f%%', participation_score * 100) AS participation FROM (SELECT * FROM riskiest LIMIT 3)""",
    **_EXP,
)
answer(
    "a12_trend",
    """SELECT constructorId, year, constructorRef AS constructor_name, round(avg(points), 6) AS points FROM near4
    WHERE constructorId IN (SELECT constructorId FROM (SELECT * FROM riskiest LIMIT 5)) GROUP BY ALL""",
    **_EXP,
)

# --- A13 -------------------------------------------------------------------

_TRACKS = {
    "dc": """SELECT driverId, circuitId, round_even(avg(position) * 100, 0) / 100 AS avg_position,
      round_even(stddev_samp(position) * 100, 0) / 100 AS position_std, count(position) AS races, round_even(avg(points) * 100, 0) / 100 AS avg_points,
      round_even(avg(position) * 100, 0) / 100 * 0.6 + round_even(stddev_samp(position) * 100, 0) / 100 * 0.4 AS score
      FROM m GROUP BY ALL HAVING count(position) >= 3""",
    "one": f"SELECT * FROM m WHERE driverRef = '{DRIVER}'",
    "agg": """SELECT circuitId, circuitRef AS circuit_name, round_even(avg(position) * 100, 0) / 100 AS avg_position,
      round_even(coalesce(stddev_samp(position), 0) * 100, 0) / 100 AS position_std, count(position) AS races,
      min(position) AS best_finish, max(position) AS worst_finish, round_even(avg(points) * 100, 0) / 100 AS avg_points,
      round_even(sum(points) * 100, 0) / 100 AS total_points, round_even(avg(grid) * 100, 0) / 100 AS avg_grid, min(grid) AS best_grid
      FROM one GROUP BY ALL""",
    "profile": """SELECT *, CASE WHEN avg_position IS NOT NULL THEN greatest(avg_position * 0.4 + position_std * 0.2
      + (20 - avg_points) * 0.3 + avg_grid * 0.1, 0) END AS performance_score FROM agg""",
    "best3": "SELECT * FROM profile ORDER BY round(performance_score, 9) ASC NULLS LAST, circuitId LIMIT 3",
    "worst3": "SELECT * FROM profile ORDER BY round(performance_score, 9) DESC NULLS LAST, circuitId LIMIT 3",
    "boxes": """SELECT circuitRef, count(*) AS n, quantile_cont(points, 0.25) AS q1, quantile_cont(points, 0.5) AS median,
      quantile_cont(points, 0.75) AS q3 FROM one GROUP BY ALL""",
}
_dc = "SELECT * EXCLUDE (score), round(score, 6) AS performance_score FROM dc"
_profile = "SELECT * REPLACE (round(performance_score, 6) AS performance_score) FROM "
answer("a13_driver_circuit", _dc, **_TRACKS)
answer("a13_worst", f"{_dc} ORDER BY round(score, 9) DESC NULLS LAST, driverId, circuitId LIMIT 5", **_TRACKS)
answer("a13_best", f"{_dc} ORDER BY round(score, 9) ASC NULLS LAST, driverId, circuitId LIMIT 5", **_TRACKS)
answer(
    "a13_difficulty",
    """SELECT circuitId, round(p, 6) AS avg_position FROM (SELECT circuitId, avg(position) AS p FROM m GROUP BY ALL)
    ORDER BY round(p, 9) DESC NULLS LAST, circuitId LIMIT 3""",
)
answer("a13_driver_profile", f"{_profile} profile", **_TRACKS)
answer("a13_driver_best", f"{_profile} best3", **_TRACKS)
answer("a13_driver_worst", f"{_profile} worst3", **_TRACKS)
answer(
    "a13_driver_summary",
    """SELECT round(avg(avg_position), 6) AS avg_finish, count(*) AS circuits,
    (SELECT circuit_name FROM best3 ORDER BY round(performance_score, 9), circuitId LIMIT 1) AS strongest,
    (SELECT circuit_name FROM worst3 ORDER BY round(performance_score, 9) DESC, circuitId LIMIT 1) AS weakest
    FROM profile""",
    **_TRACKS,
)
answer(
    "a13_points_box",
    _BOX.format(key="circuitRef", source="(SELECT circuitRef, points AS v FROM one)"),
    **_TRACKS,
)
answer(
    "a13_grid_points",
    """SELECT resultId, circuitRef, grid, position FROM one
    WHERE circuitId IN (SELECT circuitId FROM best3 UNION SELECT circuitId FROM worst3)""",
    **_TRACKS,
)

# --- A14, A15 --------------------------------------------------------------

_TITLES = {
    "season_points": "SELECT year, driverId, driverRef, sum(points) AS points FROM m GROUP BY ALL",
    "champs": """SELECT * FROM season_points
      QUALIFY row_number() OVER (PARTITION BY year ORDER BY points DESC, driverId) = 1""",
    "flags": """SELECT year, driverId = lead(driverId) OVER (ORDER BY year) AS retained,
      row_number() OVER (ORDER BY year DESC) - 1 AS back FROM champs""",
    "kept": """SELECT c.*, n.year IS NOT NULL AS again FROM champs c
      LEFT JOIN champs n ON n.year = c.year + 1 AND n.driverId = c.driverId""",
    "runs": """SELECT run, count(*) AS n, min(driverRef) AS name FROM (
        SELECT *, year - row_number() OVER (PARTITION BY driverId ORDER BY ord) AS unused,
          ord - row_number() OVER (PARTITION BY driverId ORDER BY ord) AS island,
          min(ord) OVER (PARTITION BY driverId, ord - rn) AS run
        FROM (SELECT *, row_number() OVER (PARTITION BY driverId ORDER BY ord) AS rn
              FROM (SELECT *, row_number() OVER (ORDER BY year) AS ord FROM champs)))
      GROUP BY run""",
}
answer("a14_champions", "SELECT year, driverId, driverRef, points FROM champs", **_TITLES)
answer("a14_back_to_back", "SELECT year, driverRef FROM kept WHERE again", **_TITLES)
answer(
    "a14_retention_calendar",
    """SELECT round(avg(CAST(again AS INTEGER)), 6) AS retention_rate, round(avg(CAST(again AS INTEGER))
    FILTER (WHERE year >= (SELECT max(year) FROM champs) - 3), 6) AS recent_rate FROM kept""",
    **_TITLES,
)
answer("a14_retention_flags", "SELECT year, retained FROM flags WHERE back > 0", **_TITLES)
answer(
    "a14_retention_consecutive",
    """SELECT CAST(sum(CAST(retained AS INTEGER)) AS BIGINT) AS retained, count(*) AS transitions,
    round(avg(CAST(retained AS INTEGER)), 6) AS retention_rate FROM flags WHERE back > 0""",
    **_TITLES,
)
answer(
    "a14_streak",
    """SELECT n AS longest_streak, CASE WHEN n > 1 THEN name END AS streak_holder FROM runs
    ORDER BY n DESC, run LIMIT 1""",
    **_TITLES,
)
answer(
    "a14_recent_titles",
    """SELECT driverRef, count(*) AS titles FROM champs WHERE year >= (SELECT max(year) FROM champs) - 3
    GROUP BY ALL""",
    **_TITLES,
)
answer(
    "a14_outlook",
    """SELECT round(a, 6) AS retention_rate, round(b, 6) AS recent_rate, round(greatest(a, b), 6) AS probability,
    (SELECT arg_max(driverRef, year) FROM champs) AS current_champion FROM (
      SELECT avg(CAST(retained AS INTEGER)) AS a,
      coalesce(sum(CAST(retained AS INTEGER)) FILTER (WHERE back <= 5), 0) / 5.0::DOUBLE AS b FROM flags WHERE back > 0)""",
    **_TITLES,
)
_AGES = {
    "by_year": """SELECT year, year - year(dob) AS age FROM m
      WHERE position = 1 AND year - year(dob) BETWEEN 18 AND 60""",
    "by_days": """SELECT year, age FROM (SELECT year, date_diff('day', dob, make_date(year, 12, 31)) / 365.25::DOUBLE AS age
      FROM m WHERE position = 1) WHERE age BETWEEN 18 AND 60""",
}
answer(
    "a15_age_year",
    "SELECT round(avg(age), 6) AS average, min(age) AS youngest, max(age) AS oldest FROM by_year",
    **_AGES,
)
answer(
    "a15_age_days",
    """SELECT round(avg(age), 6) AS average, round(min(age), 6) AS youngest, round(max(age), 6) AS oldest,
    round(stddev_samp(age), 6) AS std, round(median(age), 6) AS median FROM by_days""",
    **_AGES,
)
answer(
    "a15_decades",
    """SELECT year // 10 * 10 AS decade, round_even(avg(age) * 10, 0) / 10 AS average, round_even(min(age) * 10, 0) / 10 AS youngest,
    round_even(max(age) * 10, 0) / 10 AS oldest, count(*) AS champions FROM by_days GROUP BY 1""",
    **_AGES,
)
for _name, _source in [("a15_trend", "by_days"), ("a15_trend_year", "by_year")]:
    answer(
        _name,
        f"""SELECT round(regr_slope(age, year), 6) AS slope, round(regr_intercept(age, year), 6) AS intercept,
        round(regr_r2(age, year), 6) AS r2 FROM {_source}""",
        **_AGES,
    )
answer("a15_hist", _histogram("by_days", "age"), **_AGES)
answer(
    "a15_recent",
    """SELECT round(r, 6) AS recent_average, round(a, 6) AS average,
    CASE WHEN round(r, 9) < round(a, 9) THEN 'Younger' ELSE 'Older' END AS trend FROM (
      SELECT avg(age) FILTER (WHERE year >= (SELECT max(year) FROM by_days) - 3) AS r, avg(age) AS a FROM by_days)""",
    **_AGES,
)

# --- A16 -------------------------------------------------------------------

_NEXT = {
    "mine": f"SELECT * FROM m WHERE driverRef = '{DRIVER}'",
    "hist": """SELECT year, constructorRef, sum(points) AS points, avg(position) AS p, min(position) AS best_position,
      count(raceId) AS races FROM mine GROUP BY ALL""",
    "last_year": "SELECT max(year) AS y FROM mine",
    "row_changes": """SELECT *, points / nullif(lag(points) OVER (ORDER BY year, constructorRef), 0) - 1 AS c,
      row_number() OVER (ORDER BY year DESC, constructorRef DESC) AS back FROM hist""",
    "years": "SELECT year, sum(points) AS points FROM mine GROUP BY ALL",
    "year_changes": """SELECT *, points / nullif(lag(points) OVER (ORDER BY year), 0) - 1 AS c,
      row_number() OVER (ORDER BY year DESC) AS back FROM years""",
    "now_first": "SELECT * FROM hist WHERE year = (SELECT y FROM last_year) ORDER BY constructorRef LIMIT 1",
    "now_most": "SELECT * FROM hist WHERE year = (SELECT y FROM last_year) ORDER BY points DESC, constructorRef LIMIT 1",
    "season": """SELECT constructorRef, sum(points) AS points FROM m WHERE year = (SELECT y FROM last_year) GROUP BY ALL""",
    "facts_rows": """SELECT n.constructorRef AS current_team, n.year AS latest_year, n.points AS current_points,
      (SELECT count(DISTINCT constructorRef) FROM hist) AS teams,
      (SELECT (max(year) - min(year)) / count(DISTINCT constructorRef) FROM hist) AS per_team,
      (SELECT avg(c) FROM row_changes WHERE back <= 3) AS trend FROM now_first n""",
    "outlook_rows": """SELECT *, CASE WHEN (coalesce(round(trend, 9) < 0, false) AND per_team < 3) OR per_team >= 4
      THEN 'High' ELSE 'Low' END AS likelihood FROM facts_rows""",
    "facts_years": """SELECT (SELECT y FROM last_year) AS latest_year,
      (SELECT CAST(sum(h.races) AS BIGINT) FROM hist h WHERE h.constructorRef = n.constructorRef) AS races_at_current,
      (SELECT count(DISTINCT h.year) FROM hist h WHERE h.constructorRef = n.constructorRef) AS years_at_current,
      n.constructorRef AS current_team, (SELECT points FROM years WHERE year = (SELECT y FROM last_year)) AS current_points,
      (SELECT avg(c) FROM year_changes WHERE back <= 3) AS trend,
      (SELECT avg(y) FROM (SELECT count(DISTINCT year) AS y FROM hist GROUP BY constructorRef)) AS duration,
      (SELECT median(points) FROM season) AS median_points FROM now_most n""",
}
answer(
    "a16_history",
    "SELECT year, constructorRef, points, round(p, 6) AS avg_position, best_position, races FROM hist",
    **_NEXT,
)
answer(
    "a16_outlook_rows",
    """SELECT current_team, latest_year, current_points, teams, round(per_team, 6) AS avg_years_per_team,
    round(trend, 6) AS recent_trend, CASE WHEN round(trend, 9) > 0 THEN 'Improving' ELSE 'Declining' END AS direction,
    likelihood FROM outlook_rows""",
    **_NEXT,
)
answer(
    "a16_outlook_years",
    """SELECT latest_year, races_at_current, years_at_current, current_team, current_points, round(trend, 6) AS recent_trend,
    round(duration, 6) AS avg_team_duration, round(median_points, 6) AS median_team_points,
    CASE WHEN coalesce(round(trend, 9) < -0.1, false) OR races_at_current > duration OR current_points < median_points
      THEN 'High' ELSE 'Low' END AS likelihood FROM facts_years""",
    **_NEXT,
)
answer(
    "a16_candidates",
    """SELECT constructorRef, points FROM season WHERE points > (SELECT current_points FROM facts_years)
    ORDER BY points DESC, constructorRef LIMIT 3""",
    **_NEXT,
)
answer(
    "a16_candidates_by_name",
    """SELECT constructorRef, points FROM season WHERE points > (SELECT current_points FROM outlook_rows)
    AND (SELECT likelihood FROM outlook_rows) = 'High' ORDER BY constructorRef LIMIT 3""",
    **_NEXT,
)
answer(
    "a16_by_team",
    """SELECT constructorRef, count(DISTINCT year) AS years, round(avg(points), 6) AS avg_points FROM mine GROUP BY ALL""",
    **_NEXT,
)
answer("a16_by_year", "SELECT year, round(avg(points), 6) AS avg_points FROM mine GROUP BY ALL", **_NEXT)

# --- A17, feature table ----------------------------------------------------

answer(
    "a17_rows",
    """SELECT resultId, driverId, grid, CASE WHEN position <= 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS podium,
    round(avg(points) OVER (PARTITION BY driverId), 6) AS points_avg,
    round(avg(grid) OVER (PARTITION BY driverId), 6) AS grid_avg FROM m""",
)
_FEATURES = {
    "fin": """SELECT driverId, round(avg(positionOrder), 6) AS avg_finishing_position,
      round(stddev_samp(positionOrder), 6) AS std_finishing_position FROM m GROUP BY ALL""",
    "qual": "SELECT driverId, round(avg(position), 6) AS avg_qualifying_position FROM qualifying GROUP BY ALL",
    "pts": """SELECT constructorId, round(avg(p), 6) AS avg_constructor_points
      FROM (SELECT constructorId, year, sum(points) AS p FROM m GROUP BY ALL) GROUP BY ALL""",
    "dnf": """SELECT constructorId, round(nullif(count(*) FILTER (WHERE lower(status) LIKE '%did not finish%'), 0) / count(*), 6)
      AS constructor_dnf_rate FROM m GROUP BY ALL""",
    "spr": """SELECT circuitId, round(avg(s), 6) AS avg_position_change
      FROM (SELECT raceId, circuitId, stddev_samp(positionOrder) AS s FROM m GROUP BY ALL) GROUP BY ALL""",
}
for _name, _cte in [
    ("f_driver_finish", "fin"),
    ("f_driver_qual", "qual"),
    ("f_team_points", "pts"),
    ("f_team_dnf", "dnf"),
    ("f_circuit_spread", "spr"),
]:
    answer(_name, f"SELECT * FROM {_cte}", **_FEATURES)
answer(
    "f_engineered",
    """SELECT resultId, raceId, m.driverId, m.constructorId, m.circuitId, positionOrder, avg_finishing_position,
    std_finishing_position, avg_qualifying_position, avg_constructor_points, constructor_dnf_rate, avg_position_change
    FROM m LEFT JOIN fin ON m.driverId = fin.driverId LEFT JOIN qual ON m.driverId = qual.driverId
    LEFT JOIN pts ON m.constructorId = pts.constructorId LEFT JOIN dnf ON m.constructorId = dnf.constructorId
    LEFT JOIN spr ON m.circuitId = spr.circuitId""",
    **_FEATURES,
)

# --- models: what does not depend on the library that fits them -------------


def _inside(key: str = "resultId") -> str:
    """Whether a row is for training, by seven hexadecimal digits of an md5."""
    return f"CAST('0x' || substr(md5('42:' || {key}), 1, 7) AS BIGINT) % 10000 < 8000"


def _regression(rows: str, label: str) -> str:
    y = f"CAST({label} AS DOUBLE)"
    return f"""SELECT any_value(t.n) AS train_rows, round(any_value(t.total), 6) AS train_sum, count(*) AS test_rows,
      round(sum({y}), 6) AS test_sum, round(sqrt(avg(({y} - t.mean) ** 2)), 6) AS constant_rmse, true AS better
      FROM {rows} r, (SELECT count(*) AS n, sum({y}) AS total, avg({y}) AS mean FROM {rows} WHERE {_inside()}) t
      WHERE NOT ({_inside('r.resultId')})"""


_TRAINING = "(SELECT * FROM rows_lagged WHERE recent_form IS NOT NULL)"
for _name in ("a11_fit_rf", "a11_fit_gbt"):
    answer(_name, _regression(_TRAINING, "points"), **_FORECAST)
_INPUTS = """SELECT driverId, driverRef, points AS current_points FROM rows_lagged
  WHERE year = (SELECT max(year) FROM rows_lagged)
  QUALIFY row_number() OVER (PARTITION BY driverId ORDER BY round, resultId) = 1"""
answer("a11_predict", f"SELECT *, 2 AS models, true AS in_range, true AS is_mean FROM ({_INPUTS})", **_FORECAST)
answer(
    "a11_confidence",
    f"SELECT driverId, current_points, true AS bounded, true AS is_change FROM ({_INPUTS})",
    **_FORECAST,
)
_FORECAST_FEATURES = """grid previous_season_points recent_form team_strength career_experience podium_finishes
race_wins did_not_finish""".split()
answer(
    "a11_importance",
    f"""SELECT model, feature, true AS sound, true AS whole
    FROM (SELECT unnest(['random_forest', 'boosted_trees']) AS model), (SELECT unnest({_FORECAST_FEATURES}) AS feature)""",
)


def _podium(usable: str) -> str:
    test, podium = f"NOT ({_inside()})", "coalesce(position <= 3, false)"
    none = f"count(*) FILTER ({test} AND NOT {podium}) / count(*) FILTER ({test})"
    return f"""SELECT count(*) FILTER ({_inside()}) AS train_rows, count(*) FILTER ({_inside()} AND {podium}) AS train_podiums,
      count(*) FILTER ({test}) AS test_rows, count(*) FILTER ({test} AND {podium}) AS test_podiums,
      round(greatest({none}, 1 - {none}), 6) AS constant_accuracy, true AS as_good FROM m WHERE {usable}"""


_KNOWN = """grid IS NOT NULL AND driverId IN (SELECT driverId FROM m GROUP BY ALL HAVING count(points) > 0 AND count(grid) > 0)"""
answer("a17_fit_grid", _podium("grid IS NOT NULL"))
answer("a17_fit_avg", _podium(_KNOWN))
answer(
    "a17_confusion",
    f"""SELECT CAST(coalesce(position <= 3, false) AS DOUBLE) AS podium, count(*) AS n, true AS labels_only FROM m
    WHERE {_KNOWN} AND NOT ({_inside()}) GROUP BY ALL""",
)
answer(
    "a17_predictions",
    f"""SELECT resultId, driverId, CAST(coalesce(position <= 3, false) AS DOUBLE) AS podium, true AS is_label
    FROM m WHERE {_KNOWN}""",
)
answer("a17_importance", "SELECT unnest(['grid', 'points_avg', 'grid_avg']) AS feature, true AS sound")
answer("m_finish_forest", _regression("m", "positionOrder"))
_FINISH_FEATURES = """avg_finishing_position std_finishing_position avg_qualifying_position avg_constructor_points
constructor_dnf_rate avg_position_change""".split()
answer(
    "m_finish_importance",
    f"SELECT unnest({_FINISH_FEATURES}) AS feature, true AS sound, true AS whole",
)
