"""The race tables of ``gridstats.sources.order_tables`` restated in DuckDB SQL."""

POINTS = [25, 18, 15, 12, 10, 8, 6, 4, 2, 1]
_points = " ".join(f"WHEN {i} THEN {p}.0" for i, p in enumerate(POINTS, 1))


def clock(ms: str) -> str:
    return f"printf('%d:%02d.%03d', ({ms}) // 60000, (({ms}) // 1000) % 60, ({ms}) % 1000)"


def long_clock(ms: str) -> str:
    return (
        f"printf('%d:%02d:%02d.%03d', ({ms}) // 3600000, (({ms}) // 60000) % 60,"
        f" (({ms}) // 1000) % 60, ({ms}) % 1000)"
    )


_standing = """
  SELECT raceId * 200000000 + {key} AS {id}, raceId, {key}, sum(points) AS points, min(position) AS position,
    coalesce(CAST(min(position) AS VARCHAR), '-') AS positionText,
    CAST(count(*) FILTER (WHERE position = 1) AS BIGINT) AS wins
  FROM results GROUP BY raceId, {key}"""

TABLES = f"""
WITH lines AS (
  SELECT year(o_orderdate) AS year, month(o_orderdate) AS round, CAST(c_nationkey AS BIGINT) AS circuitId,
    l_suppkey AS driverId, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS constructorId,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_quantity AS BIGINT) AS quantity, l_linenumber AS line,
    (CAST(year(o_orderdate) AS BIGINT) * 12 + month(o_orderdate) - 1) * 1000000 + c_nationkey AS raceId
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
season_sums AS (SELECT driverId, year, constructorId, sum(price) AS revenue FROM lines GROUP BY ALL),
teams AS (
  SELECT driverId, year, constructorId FROM season_sums
  QUALIFY row_number() OVER (PARTITION BY driverId, year ORDER BY revenue DESC, constructorId) = 1),
entries AS (
  SELECT raceId, year, round, circuitId, driverId,
    sum(price) * CASE WHEN driverId % 50 = 0 THEN 8 ELSE 1 END AS revenue, CAST(sum(quantity) AS BIGINT) AS quantity
  FROM lines GROUP BY raceId, year, round, circuitId, driverId),
ranked AS (
  SELECT e.*, t.constructorId,
    row_number() OVER (PARTITION BY raceId ORDER BY revenue DESC, e.driverId) AS positionOrder,
    row_number() OVER (PARTITION BY raceId ORDER BY quantity DESC, e.driverId) AS grid
  FROM entries e JOIN teams t ON e.driverId = t.driverId AND e.year = t.year),
placed AS (
  SELECT *, CASE WHEN (driverId * 7 + round * 3 + circuitId) % 11 <> 0 THEN positionOrder END AS position,
    CAST(5400000 + positionOrder * 1234 AS BIGINT) AS finish_ms, CAST(80000 + quantity * 37 AS BIGINT) AS fast_ms
  FROM ranked),
results AS (
  SELECT raceId * 200000000 + positionOrder AS resultId, raceId, driverId, constructorId, driverId % 100 AS number,
    grid, position, coalesce(CAST(position AS VARCHAR), 'R') AS positionText, positionOrder,
    CAST(CASE position {_points} ELSE 0.0 END AS DOUBLE) AS points,
    CASE WHEN position IS NULL THEN 30 WHEN positionOrder > 20 THEN 59 ELSE 60 END AS laps,
    CASE WHEN position IS NULL THEN NULL WHEN positionOrder > 20 THEN '+1 Lap'
      WHEN positionOrder = 1 THEN {long_clock('finish_ms')}
      ELSE printf('+%d.%03d', ((positionOrder - 1) * 1234) // 1000, ((positionOrder - 1) * 1234) % 1000) END AS time,
    CASE WHEN position IS NOT NULL AND positionOrder <= 20 THEN finish_ms END AS milliseconds,
    quantity % 60 + 1 AS fastestLap, grid AS rank, {clock('fast_ms')} AS fastestLapTime,
    200.0 + quantity / 8.0 AS fastestLapSpeed,
    CASE WHEN position IS NULL THEN 2 WHEN positionOrder > 20 THEN 3 ELSE 1 END AS statusId,
    fast_ms
  FROM placed),
days AS (SELECT DISTINCT raceId, year, round, circuitId, make_date(year, round, 21) AS day FROM entries),
races AS (
  SELECT raceId, year, round, circuitId, printf('Round %d of %d', round, year) AS name, day AS date,
    printf('%02d:00:00', circuitId % 12 + 8) AS time, '/race/' || raceId AS url,
    day - 2 AS fp1_date, '11:30:00' AS fp1_time, day - 2 AS fp2_date, '15:00:00' AS fp2_time,
    day - 1 AS fp3_date, '10:30:00' AS fp3_time, day - 1 AS quali_date, '14:00:00' AS quali_time,
    CASE WHEN round % 4 = 0 THEN day - 1 END AS sprint_date, CASE WHEN round % 4 = 0 THEN '09:30:00' END AS sprint_time
  FROM days),
drivers AS (
  SELECT s_suppkey AS driverId, s_name AS driverRef, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 100 END AS number,
    upper(s_name[1:3]) AS code, split_part(s_name, '#', 1) AS forename, split_part(s_name, '#', 2) AS surname,
    DATE '1950-01-01' + CAST(s_suppkey * 37 % 7000 AS INTEGER) AS dob, 'N' || s_nationkey AS nationality,
    '/driver/' || s_suppkey AS url
  FROM supplier),
constructors AS (
  SELECT id AS constructorId, 'Brand#' || id AS constructorRef, 'Team ' || id AS name, 'N' || (id % 5) AS nationality,
    '/team/' || id AS url
  FROM (SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS id FROM part)),
circuits AS (
  SELECT CAST(n_nationkey AS BIGINT) AS circuitId, n_name AS circuitRef, n_name || ' Circuit' AS name,
    'Town, ' || n_regionkey AS location, n_name AS country, n_nationkey * 3.5::DOUBLE - 40 AS lat,
    n_nationkey * 7.25::DOUBLE - 90 AS lng, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey * 11.0::DOUBLE END AS alt,
    '/circuit/' || n_nationkey AS url
  FROM nation),
seasons AS (SELECT DISTINCT year, '/season/' || year AS url FROM entries),
status AS (SELECT DISTINCT statusId, CASE statusId WHEN 1 THEN 'Finished' WHEN 2 THEN 'Did not finish' ELSE '+1 Lap' END AS status
  FROM results),
qualifying AS (
  SELECT resultId AS qualifyId, raceId, driverId, constructorId, number, grid AS position,
    {clock('75000 + grid * 53')} AS q1,
    CASE WHEN grid <= 15 THEN {clock('74600 + grid * 53')} END AS q2,
    CASE WHEN grid <= 10 THEN {clock('74200 + grid * 53')} END AS q3
  FROM results),
sprint_results AS (
  SELECT * EXCLUDE (rank, fastestLapSpeed) REPLACE (
    CASE WHEN position IS NOT NULL THEN 1500000 + positionOrder * 617 END AS milliseconds,
    CASE WHEN position = 1 THEN {clock('1500000 + positionOrder * 617')} ELSE time END AS time)
  FROM results),
lap_times AS (
  SELECT raceId, driverId, line AS lap, CAST(NULL AS INTEGER) AS position, {clock('CAST(price * 100 AS BIGINT)')} AS time,
    CAST(price * 100 AS BIGINT) AS milliseconds
  FROM lines),
pit_stops AS (
  SELECT raceId, driverId, line AS stop, line * 7 AS lap, printf('%02d:%02d:00', circuitId % 12 + 8, line * 5) AS time,
    CASE WHEN quantity * 1500 < 60000 THEN quantity * 1.5::DOUBLE END AS duration, quantity * 1500 AS milliseconds
  FROM lines),
constructor_results AS (
  SELECT raceId * 200000000 + constructorId AS constructorResultsId, raceId, constructorId, sum(points) AS points,
    CASE WHEN sum(points) = 0 AND (raceId // 1000000) % 2 = 0 THEN 'D' END AS status
  FROM results GROUP BY raceId, constructorId),
constructor_standings AS ({_standing.format(key='constructorId', id='constructorStandingsId')}),
driver_standings AS ({_standing.format(key='driverId', id='driverStandingsId')}),
m AS (
  SELECT r.* EXCLUDE (time, fast_ms), r.time AS result_time, a.year, a.round, a.circuitId, a.name AS race_name,
    a.date AS race_date, a.time AS race_time, a.url AS race_url, a.fp1_date, a.fp1_time, a.fp2_date, a.fp2_time,
    a.fp3_date, a.fp3_time, a.quali_date, a.quali_time, a.sprint_date, a.sprint_time,
    d.driverRef, d.number AS driver_number, d.code, d.forename, d.surname, d.dob,
    d.nationality AS driver_nationality, d.url AS driver_url,
    k.constructorRef, k.name AS constructor_name, k.nationality AS constructor_nationality, k.url AS constructor_url,
    c.circuitRef, c.name AS circuit_name, c.location, c.country, c.lat, c.lng, c.alt, c.url AS circuit_url,
    s.url AS season_url, t.status
  FROM results r LEFT JOIN races a ON r.raceId = a.raceId LEFT JOIN drivers d ON r.driverId = d.driverId
  LEFT JOIN constructors k ON r.constructorId = k.constructorId LEFT JOIN circuits c ON a.circuitId = c.circuitId
  LEFT JOIN seasons s ON a.year = s.year LEFT JOIN status t ON r.statusId = t.statusId),
pits AS (SELECT raceId, driverId, count(*) AS pit_stops FROM pit_stops GROUP BY ALL),
stops AS (
  SELECT m.raceId, m.driverId, position, positionOrder, coalesce(pit_stops, 0) AS pit_stops
  FROM m LEFT JOIN pits p ON m.raceId = p.raceId AND m.driverId = p.driverId)
"""
