"""Cases beyond limits that earlier versions had, and what happens outside the repository's folder."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import check_oracle
from gridstats import functions as g
from gridstats.operators.grids import wide
from gridstats.operators.quantiles import box_stats, median_of
from gridstats.plans import rivalry
from gridstats.sources import files, order_tables

ROOT = Path(__file__).resolve().parent.parent


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


def test_a_gap_of_any_length_is_read_whole(spark):
    text = "+" + "0" * 66 + "12.5"
    assert value(spark, g.seconds_of(g.result_time("t")), text) == 12.5
    assert value(spark, g.seconds_of(g.lap_time("t")), "0000000001:02.5") == 62.5
    assert value(spark, g.result_time("t"), "9" * 30 + ":00:00") is None


@pytest.mark.parametrize("text", ["NaN", "Infinity", "-inf", "12d", "1f", "0x10", "1e999", "1,5", "NA", "null", "<NA>", ""])
def test_what_is_no_number_is_null(spark, text):
    assert value(spark, g.to_double("t"), text) is None
    assert value(spark, g.to_whole("t"), text) is None


@pytest.mark.parametrize(
    "text, number", [("1e3", 1000.0), (" -.5 ", -0.5), ("+7.", 7.0), ("12", 12.0)]
)
def test_numbers(spark, text, number):
    assert value(spark, g.to_double("t"), text) == number


def test_long_whole_numbers_with_a_point_are_exact(spark):
    assert value(spark, g.to_whole("t"), "4788000000200000501.0") == 4788000000200000501


def test_markers_of_missing_text_are_null(spark):
    for marker in g.NULL_MARKERS:
        assert value(spark, g.present("t"), marker) is None
        assert value(spark, g.trimmed("t"), f" {marker} ") is None
    assert value(spark, g.present("t"), "Nan") == "Nan"


def test_circuits_beyond_a_hundred_keep_their_races_apart(spark):
    rows = [(1997, 1, 30), (1997, 1, 130), (1997, 2, 30), (1998, 1, 100)]
    frame = spark.createDataFrame(rows, "year int, round int, circuitId bigint")
    assert frame.select(order_tables._race_id()).distinct().count() == 4
    outside = spark.createDataFrame([(1997, 1, order_tables.CIRCUIT_ROOM)], frame.schema)
    with pytest.raises(Exception, match="exceeds its room"):
        outside.select(order_tables._race_id()).collect()


def test_a_matrix_does_not_leave_cells_out(spark):
    cells = spark.createDataFrame([(1, 25, 0.5), (2, 130, 0.25)], "r int, c int, v double")
    assert wide(cells, "r", "c", "v", [25, 130]).count() == 2
    with pytest.raises(Exception, match="outside the columns"):
        wide(cells, "r", "c", "v", [25]).collect()


def test_quantiles_beside_far_outliers(spark):
    draw = np.random.default_rng(1)
    values = [*draw.normal(size=5000).tolist(), 1e300, -1e200]
    frame = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0)], "k string, v double")
    found = {r["k"]: r for r in box_stats(frame, ["k"], "v").collect()}
    assert found["a"]["q1"] == pytest.approx(np.quantile(values, 0.25))
    assert found["a"]["q3"] == pytest.approx(np.quantile(values, 0.75))
    assert (found["b"]["n"], found["b"]["median"]) == (1, 1.0)
    middle = frame.where("k = 'a'").limit(10_000)
    assert middle.limit(1).select(median_of(middle, "v")).first()[0] == pytest.approx(np.median(values))


def test_csv_files_with_other_columns_stop_the_read(spark, tmp_path):
    folder = tmp_path / "status.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("statusId,status\n1,Finished\n")
    (folder / "b.csv").write_text("status,statusId\nRetired,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, str(folder)).collect()
    (tmp_path / "seasons.csv").write_text("url\nx\n")
    with pytest.raises(ValueError, match="has no column year"):
        files.raw(spark, str(tmp_path), "seasons")


def test_rivals_of_one_driver(spark, rows):
    table = [(1, 1, 1), (1, 2, 2), (1, 3, 5), (2, 1, 3), (2, 2, 1), (3, 2, 4), (3, 3, 2), (4, 1, None), (4, 2, 1)]
    frame = spark.createDataFrame(table, "raceId bigint, driverId bigint, position int")
    found = rivalry.rivals_of(frame, 1)
    assert rows(found, "opponent", "races", "correlation", "avg_finish_diff") == [
        (2, 2, -1.0, 1.5),
        (3, 1, None, 4.0),
    ]


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Cluster:
        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        files.shared_folder(Cluster)


def test_workers_need_no_repository_folder(tmp_path):
    """A pair query from another working folder, the entry imported by its path."""
    script = textwrap.dedent(
        f"""
        import importlib.util, sys
        from pyspark.sql import SparkSession
        spec = importlib.util.spec_from_file_location("entry", "{ROOT}/__spark_entry__.py")
        entry = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(entry)
        sys.path.remove("{ROOT}")
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false") \\
            .config("spark.sql.shuffle.partitions", "2").getOrCreate()
        print("ROWS", entry.queries()["a07_h2h_matrix"](spark, "/root/testdata/sf0.001").count())
        """
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    duck = duckdb.connect()
    for name in check_oracle.TABLES:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    expected = len(duck.execute(entry.oracle_sql()["a07_h2h_matrix"]).fetchall())
    assert f"ROWS {expected}\n" in done.stdout, done.stderr[-2000:]


def test_a_constant_fraction_has_no_correlation(spark):
    draw = np.random.default_rng(2)
    rows = [(r, d, 7.1 if d == 1 else float(draw.integers(1, 20))) for r in range(500) for d in (1, 2, 3)]
    frame = spark.createDataFrame(rows, "raceId bigint, driverId bigint, position double")
    found = {(r["a"], r["b"]): r["correlation"] for r in rivalry.pair_table(frame).collect()}
    assert found[1, 2] is None and found[1, 3] is None
    assert abs(found[2, 3]) < 0.2
