"""What is shuffled: copies only, and nothing between tables that are dealt alike."""

import math
import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridstats.operators.cleaning import clean, removed_rows
from gridstats.operators.duplicates import copies_removed, distinct_rows, split_rows
from gridstats.plans import laps, masters, performance
from gridstats.sources import RaceTables, deal, files, keep_bucketed, order_tables

ENTRY = ["raceId", "driverId"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def copied(spark):
    """10,000 rows, of which 30 occur twice and one 500 times."""
    one = spark.range(10_000).select("id", F.concat(F.lit("t"), "id").alias("a.b"), (F.col("id") / 7).alias("x"))
    return one.unionByName(one.where("id < 30")).unionByName(one.where("id = 31").crossJoin(spark.range(499).select()))


def test_only_copies_take_part_in_the_shuffle(copied):
    single, others = split_rows(copied)
    assert others.count() == 30 * 2 + 500
    assert single.count() == 10_000 - 31
    assert "Exchange hashpartitioning" not in plan(single)
    assert distinct_rows(copied).exceptAll(copied.dropDuplicates()).isEmpty()
    assert distinct_rows(copied).count() == 10_000
    assert tuple(copies_removed(copied).first()) == (10_529, 10_000, 529)


def test_whole_rows_are_shuffled_where_the_hashes_are_too_many(copied):
    single, others = split_rows(copied, most=10)
    assert single is None and others is copied
    assert distinct_rows(copied, most=10).count() == 10_000
    assert tuple(copies_removed(copied, most=10).first()) == (10_529, 10_000, 529)


def test_without_copies_nothing_is_shuffled(spark):
    rows = spark.range(50)
    assert "Exchange hashpartitioning" not in plan(split_rows(rows)[0])
    assert distinct_rows(rows).count() == 50
    assert tuple(copies_removed(rows).first()) == (50, 50, 0)
    assert tuple(copies_removed(rows.limit(0)).first()) == (0, 0, 0)
    assert distinct_rows(rows.limit(0)).count() == 0


def test_nulls_zeros_and_nan_are_equal_as_in_the_plain_form(spark):
    data = [(None, 0.0), (None, -0.0), (None, None), (None, None), ("a", None), ("", math.nan), ("", math.nan)]
    rows = spark.createDataFrame(data, "s string, x double")
    assert distinct_rows(rows).count() == rows.dropDuplicates().count() == 4
    swapped = spark.createDataFrame([("a", None), (None, "a")], "s string, t string")
    assert distinct_rows(swapped).count() == 2, "nulls are left out of a hash, so these share one"


def tables(spark):
    races = [(r, d, d % 3, f"team{d % 3}", f"driver{d}", r % 5 + 1, r % 5 + 1) for r in range(20) for d in range(10)]
    names = "raceId long, driverId long, constructorId long, constructorRef string, driverRef string, position int, positionOrder int"
    results = spark.createDataFrame([*races, (None, 1, 1, "team1", "driver1", 1, 1)], names)
    times = [(r, r % 4, d, 1000 + 7 * r + d * lap) for r in range(20) for d in range(9) for lap in range(4)]
    lap_rows = spark.createDataFrame([*times, (99, 1, 1, 5), (None, 1, 1, 5)], "raceId long, circuitId long, driverId long, milliseconds long")
    stops = [(r, d, 20.0 + d) for r in range(20) for d in range(8) for _ in range(r % 3)]
    stop_rows = spark.createDataFrame([*stops, (None, 1, 3.0), (1, 1, None)], "raceId long, driverId long, duration double")
    return results, lap_rows, stop_rows


@pytest.fixture
def without_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_tables_dealt_alike_meet_without_a_shuffle(spark, rows, without_broadcast):
    results, lap_rows, stop_rows = tables(spark)
    drives = keep_bucketed(results, *ENTRY)
    lap_totals = keep_bucketed(laps.lap_totals(lap_rows), *ENTRY)
    pit_totals = keep_bucketed(performance.pit_totals(stop_rows), *ENTRY)

    joined = laps._driven_laps(drives, lap_totals)
    assert "Join" in plan(joined) and "Exchange" not in plan(joined)
    assert "Exchange" in plan(laps._driven_laps(results, lap_rows))
    averages = plan(laps.average_laps(drives, lap_totals))
    assert averages.count("Exchange") == 1, "only that of the averages, above the join"
    assert "Exchange" not in plan(performance.with_pit_counts(drives, pit_totals))
    assert "Exchange" not in plan(performance.pit_duration(drives, pit_totals))
    assert "hashpartitioning" not in plan(performance.pit_corr(drives, pit_totals, 1, 20))

    for find in (laps.average_laps, laps.efficiency, laps.team_efficiency):
        assert rows(find(drives, lap_totals)) == rows(find(results, lap_rows)), find.__name__
    for find in (performance.pits_by_position, performance.pit_duration, performance.pit_corr, performance.pit_trend):
        assert rows(find(drives, pit_totals)) == rows(find(results, stop_rows)), find.__name__
    assert rows(performance.pit_counts(pit_totals)) == rows(performance.pit_counts(stop_rows))


def test_kept_buckets_are_forgotten(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "shared_folder", lambda spark: str(tmp_path / "kept"))
    monkeypatch.setattr(files, "_bucketed_prefix", lambda spark: "kept_of_a_test_")
    names = lambda: [t.name for t in spark.catalog.listTables() if t.name.startswith("kept_of_a_test_")]
    assert keep_bucketed(spark.range(10), "id").count() == 10
    assert len(names()) == 1 and any((tmp_path / "kept").iterdir())
    files.forget(spark)
    assert not names() and not (tmp_path / "kept").exists()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_shared_tables_are_derived_once_and_small_sides_known(spark, monkeypatch):
    """Lines are joined once for all who read them; outcomes are a table whose size is known; the master is not dealt again."""
    found = RaceTables(spark, "/root/testdata/sf0.001")
    assert "Join" not in plan(found.lines) and found.lines is found.lines
    assert "Exchange" not in plan(found.status)
    kept = []
    monkeypatch.setattr(entry, "keep", lambda df, by=None: kept.append((df, by)) or df)
    session = entry.Session(spark, "/root/testdata/sf0.001")
    session.tables = found
    assert session.master.count() == found.results.count()
    assert [by for _, by in kept] == [None]


def test_cells_of_csv_files_are_not_dealt_by_file(spark, tmp_path):
    """The headers are few whatever the size of the files that they come from."""
    spark.range(100_000).selectExpr("id AS k", "id * 2 AS v").write.csv(str(tmp_path / "long.csv"), header=True)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        found = files.scatter_rows(spark, str(tmp_path))
        assert "hashpartitioning(file" not in plan(found)
        assert found.count() == 100_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


LINE = "raceId long, year int, round int, circuitId long, driverId long, constructorId long, line int, cents long, quantity long"


def test_line_items_are_dealt_once_for_sums_teams_and_totals(spark, rows, monkeypatch):
    lines = [
        (1, 1997, 1, 3, 7, 20, 1, 500, 2),
        (1, 1997, 1, 3, 7, 10, 2, 500, 3),  # level with 20 in the season: the lower id is the team
        (2, 1997, 2, 3, 7, None, 1, 100, 1),
        (3, 1998, 1, 3, 7, 20, 1, None, 4),  # no revenue at all
        (1, 1997, 1, 3, 50, None, 1, 10, 5),  # counts eight times; the brand is unknown
        (None, None, None, 3, 7, 10, 1, 9, 9),
        (1, 1997, 1, 3, None, 10, 1, 9, 9),
    ]
    monkeypatch.setattr(order_tables, "keep", lambda df: df)
    found = RaceTables(spark, "nowhere")
    found.__dict__["lines"] = spark.createDataFrame(lines, LINE)
    assert plan(found.entries).count("Exchange") == 1
    columns = ["driverId", "year", "raceId", "constructorId", "revenue", "quantity"]
    assert rows(found.entries, *columns) == [
        (7, 1997, 1, 10, 1000, 5),
        (7, 1997, 2, 10, 100, 1),
        (7, 1998, 3, 20, None, 4),
        (50, 1997, 1, None, 80, 5),
    ]


def test_the_largest_dimension_is_joined_while_rows_are_narrow(spark, rows, without_broadcast):
    fact = spark.createDataFrame([(1, 2, 9), (1, 3, 8), (None, 2, 7)], "raceId long, driverId long, lap int")
    races = spark.createDataFrame([(1, 5, "r")], "raceId long, circuitId long, name string")
    drivers = spark.createDataFrame([(2, "d")], "driverId long, url string")
    circuits = spark.createDataFrame([(5, "c")], "circuitId long, name string")
    found = masters.lap_times(fact.withColumn("time", F.lit("t")), races, drivers, circuits)
    joined = re.findall(r"Join \[(\w+)#", plan(found))
    assert joined[-1] == "driverId", "the innermost join is the last one printed"
    assert found.columns == ["circuitId", "driverId", "raceId", "lap", "lap_time", "race_name", "driver_url", "circuit_name"]
    assert rows(found) == [
        (None, 2, None, 7, "t", None, "d", None),
        (5, 2, 1, 9, "t", "r", "d", "c"),
        (5, 3, 1, 8, "t", "r", None, "c"),
    ]


def test_totals_are_shuffled_once_and_need_no_written_master(spark, monkeypatch):
    results, lap_rows, stop_rows = tables(spark)
    written = []
    monkeypatch.setattr(entry, "keep_bucketed", lambda df, *keys, dealt=False: written.append((df, dealt)) or df)
    monkeypatch.setattr(entry, "keep", lambda df, by=None: pytest.fail("a wide table is written"))
    session = entry.Session(spark, "nowhere")
    monkeypatch.setattr(session, "laps_plan", lambda: lap_rows)
    monkeypatch.setattr(session, "pits_plan", lambda: stop_rows)
    monkeypatch.setattr(session, "master_plan", lambda: results)
    for found in (session.lap_totals, session.pit_totals):
        assert plan(found).count("Exchange") == 1
    assert session.drives.columns == [*ENTRY, "constructorId", "position", "positionOrder"]
    assert [dealt for _, dealt in written] == [True, True, False]


def test_dealt_rows_are_written_as_one_file_a_bucket(spark, rows):
    _, lap_rows, _ = tables(spark)
    once = keep_bucketed(laps.lap_totals(deal(lap_rows, *ENTRY)), *ENTRY, dealt=True)
    twice = keep_bucketed(laps.lap_totals(lap_rows), *ENTRY)
    assert rows(once) == rows(twice)
    assert once.join(twice, ENTRY).count() == once.where("raceId is not null").count()
    assert len(once.inputFiles()) == len(twice.inputFiles())


def test_values_are_read_from_text_once(spark, rows):
    """The typed rows are written, so that looking for copies does not read their text again and again."""
    text = [(f" {i % 40}.0", f"t{i % 40}") for i in range(60)] + [(None, "NULL"), ("abc", "NA"), ("12.5", " x "), ("-0", "x")]
    raw_rows = spark.createDataFrame(text, "statusId string, status string")
    found = clean(raw_rows, "status", few_copies=True)
    assert "regexp_extract" in plan(clean(raw_rows, "status")) and "regexp_extract" not in plan(found)
    assert rows(found) == rows(clean(raw_rows, "status")) and found.count() == 43
    counted = removed_rows(raw_rows, "status", few_copies=True)
    assert "regexp_extract" not in plan(counted) and rows(counted) == rows(removed_rows(raw_rows, "status"))
