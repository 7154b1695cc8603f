import datetime

import pytest
from pyspark.sql import functions as F

from gridstats.functions import seconds_of
from gridstats.operators.cleaning import clean, removed_rows
from gridstats.plans import eda, masters, pipeline
from gridstats.sources import SPECS, first_two_columns, load, raw, save, scatter_rows, scatter_tables, table_paths
from tests import raw_tables


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return raw_tables.write(tmp_path_factory.mktemp("raw"))


@pytest.fixture(scope="module")
def built(spark, root, tmp_path_factory):
    cleaned, made = str(tmp_path_factory.mktemp("clean")), str(tmp_path_factory.mktemp("master"))
    pipeline.clean_tables(spark, root, cleaned)
    pipeline.build_masters(spark, cleaned, made)
    return cleaned, made


def cleaned(spark, root, name):
    return clean(raw(spark, root, name), name)


def test_every_table_has_a_duplicate_and_loses_it(spark, root):
    for name in SPECS:
        found = removed_rows(raw(spark, root, name), name).first()
        if name == "constructor_results":
            assert found["removed"] == 1
        else:
            assert found["removed"] == 1, name
        assert found["rows_after"] == found["rows_before"] - found["removed"]


def test_cleaning_twice_changes_nothing(spark, root, rows):
    for name in SPECS:
        once = cleaned(spark, root, name)
        if name == "constructor_results":
            once = once.distinct()  # the late fill leaves a row and its copy
        spans = [c for c, k in once.dtypes if k.startswith("interval")]
        text = once.select(*[F.col(c).cast("string").alias(c) for c in SPECS[name].columns])
        again = clean(text, name)
        assert rows(again.drop(*spans)) == rows(once.drop(*spans)), name


def test_quotes_and_padded_headers(spark, root, rows):
    found = rows(cleaned(spark, root, "circuits"), "circuitId", "circuitRef", "name", "lat", "alt")
    assert found == [
        (1, "monza", 'Monza, "Temple"', 45.6, 162.0),
        (2, "spa", "Spa", None, None),
        (3, "never", "Never", 0.0, 0.0),
    ]


def test_status_is_filled_after_duplicates_are_removed(spark, root, rows):
    found = rows(cleaned(spark, root, "constructor_results"), "constructorResultsId", "points", "status")
    assert found == [(1, 43.0, "Unknown"), (1, 43.0, "Unknown"), (2, None, "D")]


def test_drivers_and_races(spark, root, rows):
    assert rows(cleaned(spark, root, "drivers"), "driverId", "number", "forename", "dob") == [
        (1, 10, "Al", datetime.date(1970, 6, 30)),
        (2, None, "Be", None),
        (3, 30, "Ga", datetime.date(1965, 1, 1)),
    ]
    assert rows(cleaned(spark, root, "races"), "raceId", "date", "time", "fp1_time") == [
        (1, datetime.date(2000, 3, 12), "14:00:00", None),
        (2, None, None, "10:00:00"),
    ]


def test_times(spark, root, rows):
    assert rows(cleaned(spark, root, "lap_times"), "driverId", "lap", "time_seconds", "milliseconds") == [
        (1, 1, 86.572, 86572),
        (1, 2, None, 3723400),
        (2, 1, 90.0, None),
    ]
    assert rows(cleaned(spark, root, "pit_stops"), "driverId", "stop", "time", "duration", "milliseconds") == [
        (1, 1, "14:05:09", 22.5, 22500),
        (1, 2, "14:45:00", None, 62100),
        (2, 1, None, 30.0, 30000),
    ]
    assert rows(cleaned(spark, root, "qualifying"), "qualifyId", "q1_seconds", "q2_seconds", "q3_seconds") == [
        (1, 75.106, 74.706, 74.306),
        (2, 76.0, None, None),
    ]
    results = cleaned(spark, root, "results").withColumn("s", seconds_of("time_timedelta"))
    assert rows(results, "resultId", "s") == [(1, 5690.616), (2, 5.478), (3, None), (4, None), (5, None)]
    sprints = cleaned(spark, root, "sprint_results").withColumn("s", seconds_of("time_timedelta"))
    assert rows(sprints, "resultId", "s") == [(1, 1538.426), (2, 1.43)]


def test_intervals_survive_parquet_and_become_text_in_csv(spark, root, tmp_path):
    frame = cleaned(spark, root, "lap_times")
    save(frame, str(tmp_path), "laps")
    assert dict(load(spark, str(tmp_path), "laps").dtypes)["time_timedelta"].startswith("interval")
    save(frame, str(tmp_path), "laps.csv", "csv")
    text = spark.read.csv(str(tmp_path / "laps.csv"), header=True)
    assert text.columns == frame.columns and text.count() == frame.count()


def test_folder_listing(spark, root, tmp_path):
    assert {r["name"] for r in table_paths(spark, root).collect()} == set(SPECS)
    (tmp_path / "two.csv").write_text("a, b,c\n1,2,3\n")
    (tmp_path / "one.csv").write_text("a\n1\n")
    (tmp_path / "notes.txt").write_text("no table")
    pairs = scatter_tables(spark, str(tmp_path))
    assert {name: df.columns for name, df in pairs.items()} == {"two": ["a", "b"]}


def test_many_files_in_one_scan(spark, tmp_path):
    """Files of different headers, quoted cells, folders of parts, a narrow file and one without rows."""
    (tmp_path / "two.csv").write_text('a, b,c\n1,2,3\n"x, ""y""",,\n\\N,5\n')
    (tmp_path / "one.csv").write_text("a\n1\n")
    (tmp_path / "none.csv").write_text("p,q\n")
    (tmp_path / "notes.txt").write_text("no,table\n1,2\n")
    spark.range(4).selectExpr("id as k", "id * 2 as v", "id as w").repartition(3).write.csv(
        str(tmp_path / "parts.csv"), header=True
    )
    found = scatter_rows(spark, str(tmp_path))
    assert found.columns == ["name", "x_name", "y_name", "x", "y"]
    assert sorted(map(tuple, found.where("name = 'parts'").collect())) == [
        ("parts", "k", "v", str(i), str(2 * i)) for i in range(4)
    ]
    two = {tuple(r) for r in found.where("name = 'two'").collect()}
    assert two == {("two", "a", "b", "1", "2"), ("two", "a", "b", 'x, "y"', None), ("two", "a", "b", None, "5")}
    assert found.where("name not in ('two', 'parts')").count() == 0


def test_race_results_master(spark, built, rows):
    master = pipeline.master(spark, built[1])
    assert master.columns == list(dict.fromkeys(master.columns))
    found = rows(master, "resultId", "race_name", "driverRef", "constructorRef", "circuit_name", "season_url", "status")
    assert found == [
        (1, "First Race", "alfa", "red", 'Monza, "Temple"', "/2000", "Finished"),
        (2, "First Race", "beta", "blue", 'Monza, "Temple"', "/2000", "Finished"),
        (3, "First Race", "gamma", "blue", 'Monza, "Temple"', "/2000", None),
        (4, "Second Race", "alfa", "blue", "Spa", "/2000", "Finished"),
        (5, "Second Race", "beta", "red", "Spa", "/2000", "Finished"),
    ]


def test_other_masters(spark, built, rows):
    cleaned_root, made = built
    assert load(spark, made, "master_lap_times").count() == 3
    assert load(spark, made, "master_sprint_results").count() == 2
    assert rows(load(spark, made, "master_qualifying"), "qualifyId", "race_name", "driverRef", "constructor_name") == [
        (1, "First Race", "alfa", "Red Team"),
        (2, "First Race", "beta", "Blue Team"),
    ]
    pits = load(spark, made, "master_pit_stops")
    assert "constructorRef" not in pits.columns, "the stops name no constructor"
    t = {n: load(spark, cleaned_root, n) for n in ("pit_stops", "races", "drivers", "constructors")}
    named = t["pit_stops"].withColumn("constructorId", F.lit(1).cast("bigint"))
    joined = masters.pit_stops(named, t["races"], t["drivers"], t["constructors"])
    assert {r["constructorRef"] for r in joined.collect()} == {"red"}


def test_profiles(spark, root, rows):
    table = raw(spark, root, "pit_stops")
    found = rows(eda.profile_before_after(table, clean(table, "pit_stops")), "column", "stage", "type", "rows", "nulls")
    assert ("duration", "after", "double", 3, 1) in found
    assert ("duration", "before", "string", 4, 0) in found
    assert ("time", "after", "string", 3, 1) in found
    assert first_two_columns(table).columns == ["raceId", "driverId"]
    assert first_two_columns(table.select("raceId")) is None
    assert [r["lap"] for r in eda.head(table, "lap", n=2).collect()] == ["10", "10"]
