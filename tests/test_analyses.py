"""Known answers on a few hand-made seasons.

Alfa retires from race 2. Beta and alfa are level on points in 2001. Team green
skips 2001, nobody races in 2002, team grey never reaches a podium, and delta
enters a single race.
"""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstats.plans import eda, features, laps, next_team, performance, rivalry, scoring, teams, titles, tracks

DRIVERS = {1: ("alfa", "1970-06-30"), 2: ("beta", "1980-01-01"), 3: ("gamma", "1990-01-01"), 4: ("delta", None)}
TEAMS = {1: "red", 2: "blue", 3: "green", 4: "grey"}
STATUS = {False: "Finished", True: "Did Not Finish (engine)"}
# race, year, round, circuit, driver, team, grid, position, order, points
ENTRIES = [
    (1, 2000, 1, 1, 1, 1, 1, 1, 1, 10.0),
    (1, 2000, 1, 1, 2, 2, 2, 2, 2, 6.0),
    (1, 2000, 1, 1, 3, 3, 3, 3, 3, 4.0),
    (2, 2000, 2, 2, 1, 1, 2, None, 3, 0.0),
    (2, 2000, 2, 2, 2, 2, 1, 1, 1, 10.0),
    (2, 2000, 2, 2, 3, 3, 3, 2, 2, 6.0),
    (3, 2001, 1, 1, 1, 2, 1, 1, 1, 10.0),
    (3, 2001, 1, 1, 2, 1, 2, 2, 2, 6.0),
    (4, 2001, 2, 2, 1, 1, 1, 2, 2, 6.0),
    (4, 2001, 2, 2, 2, 1, 2, 1, 1, 10.0),
    (5, 2003, 1, 1, 1, 1, 2, 1, 1, 10.0),
    (5, 2003, 1, 1, 2, 2, 1, 2, 2, 6.0),
    (5, 2003, 1, 1, 3, 3, 3, None, 4, 0.0),
    (5, 2003, 1, 1, 4, 4, 4, 4, 3, 3.0),
]
COLUMNS = """resultId bigint, raceId bigint, year int, round int, circuitId bigint, circuitRef string, circuit_name string,
driverId bigint, driverRef string, forename string, surname string, dob date, constructorId bigint, constructorRef string,
grid int, position int, positionOrder int, points double, status string"""


@pytest.fixture(scope="module")
def df(spark):
    table = []
    for race, year, rnd, circuit, driver, team, grid, position, order, points in ENTRIES:
        name, born = DRIVERS[driver]
        table.append((
            race * 100 + order, race, year, rnd, circuit, f"c{circuit}", f"Circuit {circuit}", driver, name,
            name.title(), name[::-1], born and datetime.date.fromisoformat(born), team, TEAMS[team], grid, position,
            order, points, STATUS[position is None],
        ))
    return spark.createDataFrame(table, COLUMNS).cache()


@pytest.fixture(scope="module")
def pits(spark):
    stops = [(1, 1, 20.0), (1, 1, 22.0), (1, 2, 30.0), (2, 2, None), (5, 4, 25.0), (5, 4, 27.0), (5, 4, 29.0)]
    return spark.createDataFrame(stops, "raceId bigint, driverId bigint, duration double")


def test_a01_wins(df, rows):
    assert [tuple(r) for r in performance.driver_win_ratio(df).collect()] == [
        (1, "alfa", 0.6), (2, "beta", 0.4), (3, "gamma", 0.0), (4, "delta", 0.0)
    ]
    assert [r["wins"] for r in performance.constructor_wins(df).collect()] == [3, 2]
    assert rows(performance.driver_totals(df)) == [(1, 4, 36.0, 5), (2, 5, 38.0, 5), (3, 2, 10.0, 3), (4, 0, 3.0, 1)]
    assert rows(performance.constructor_podiums(df)) == [(1, 5), (2, 4), (3, 2)]


def test_a02_gain_skips_retirements(df, rows):
    found = [tuple(r) for r in performance.position_gain(df).collect()]
    assert found == [(3, "gamma", 0.5), (1, "alfa", 0.0), (2, "beta", 0.0), (4, "delta", 0.0)]
    flagged = performance.grid_points(df, "beta")
    assert flagged.count() == 14 and flagged.where("selected").count() == 5


def test_a03_stops(df, pits, rows):
    assert rows(performance.pit_counts(pits)) == [(1, 1, 2), (1, 2, 1), (2, 2, 1), (5, 4, 3)]
    assert rows(performance.pits_by_position(df, pits)) == [(1, pytest.approx(0.6)), (2, 0.2), (3, 0.0), (4, 3.0)]
    assert rows(performance.pits_by_position_filled(df, pits))[0] == (0, 0.0)
    assert rows(performance.pits_by_position(df, pits, 3, 4)) == [(3, 0.0), (4, 3.0)]
    one_value = performance.pit_corr(df, pits, 2, 2).first()
    assert tuple(one_value) == (None, "negative", "strong")
    assert performance.pit_corr(df, pits, 3, 4).first()["sign"] == "positive"
    filled = performance.pit_corr_filled(df, pits).first()["correlation"]
    assert filled != pytest.approx(performance.pit_corr(df, pits).first()["correlation"])
    duration = {(r[0], r[1]): r[3] for r in rows(performance.pit_duration(df, pits))}
    assert duration[(1, 1)] == 21.0 and duration[(2, 2)] is None and duration[(4, 1)] is None
    trend = performance.pit_trend(df, pits, 3, 4).first()
    assert tuple(trend) == (3.0, -9.0, 1.0)


def test_a04_pairs(df, rows):
    assert rows(rivalry.race_positions(df).where("driverId = 1")) == [(1, 1, 1.0), (1, 3, 1.0), (1, 4, 2.0), (1, 5, 1.0)]
    pairs = rows(rivalry.corr_pairs(df), "driver_1", "driver_2", "correlation")
    assert pairs == [(1, 2, -1.0), (2, 1, -1.0)], "a correlation of exactly 1 is left out"
    closest = [tuple(r) for r in rivalry.rivalries(df).collect()]
    assert [(a, b, name_b, round(c, 9), d) for a, _, b, name_b, c, d in closest] == [
        (1, 2, "beta", -1.0, 1.0),
        (2, 3, "gamma", 1.0, 1.0),
    ]
    assert {r["option"] for r in rivalry.rivalry_drivers(df).collect()} == {"1 - alfa", "2 - beta", "3 - gamma"}
    detail = rivalry.pair_detail(df, 1, 2).first()
    assert (detail["races"], round(detail["correlation"], 9), detail["avg_finish_diff"]) == (4, -1.0, 1.0)
    assert rivalry.pair_detail(df, 1, 3).first()["correlation"] is None
    assert rows(rivalry.pair_races(df, 2, 3)) == [(1, 2.0, 3.0), (2, 1.0, 2.0)]


def test_a05_swap(df, rows):
    assert rows(rivalry.common_seasons(df, "ALFA", "beta")) == [(2000,), (2001,), (2003,)]
    assert rows(rivalry.common_seasons(df, "gamma", "delta")) == [(2003,)]
    assert rows(rivalry.original_average(df, "alfa", "beta"), "side", "original_position") == [(1, 1.25), (2, 1.6)]
    scaled = rows(rivalry.swap_scaled(df, "alfa", "beta"), "side", "swapped_position")
    assert scaled == [(1, None), (2, 0.96)], "a missing finish leaves no mean"
    expected = rows(rivalry.swap_expected(df, "alfa", "beta"), "side", "expected_position")
    assert expected == [(1, 2.125), (2, 0.96)]
    assert rivalry.swap_expected(df, "alfa", "nobody").count() == 0


def test_a06_moves(df, rows):
    steps = rows(teams.team_steps(df), "from_team", "to_team", "steps", "first_year", "last_year")
    assert steps == [
        ("blue", "blue", 1, 2000, 2000),
        ("blue", "red", 2, 2000, 2001),
        ("green", "green", 2, 2000, 2000),
        ("red", "blue", 2, 2000, 2001),
        ("red", "red", 3, 2000, 2001),
    ]
    assert rows(teams.team_moves(df), "from_team", "to_team", "steps") == [("blue", "red", 2), ("red", "blue", 2)]
    moves = [(r["from_team"], r["to_team"], r["year"]) for r in teams.driver_moves(df, "alfa").collect()]
    assert moves == [("red", "blue", 2000), ("blue", "red", 2001)]


def test_a07_teams(df, rows):
    rates = [(r["constructorRef"], r["podium_rate"]) for r in teams.podium_rate(df).collect()]
    assert rates == [("blue", 1.0), ("red", pytest.approx(5 / 6)), ("green", pytest.approx(2 / 3)), ("grey", None)]
    grid = {(r["circuitId"], r["constructorId"]): r["podium_rate"] for r in teams.circuit_rate(df).collect()}
    assert len(grid) == 8 and grid[(2, 4)] == 0.0 and grid[(1, 3)] == 0.5 and grid[(2, 1)] == pytest.approx(2 / 3)
    means = [(r["constructorId"], round(r["mean_circuit_rate"], 6)) for r in teams.circuit_rate_mean(df).collect()]
    assert means == [(2, 1.0), (1, 0.833333), (3, 0.75), (4, 0.0)]
    assert rows(teams.circuit_rate_top(df, 1, 1), "circuitId", "constructorId", "podium_rate") == [(1, 2, 1.0)]
    duels = {(r["team"], r["opponent"]): (r["races"], r["win_ratio"]) for r in teams.team_head_to_head(df).collect()}
    assert duels[(1, 2)] == (4, 0.5) and duels[(2, 1)] == (4, 0.25), "a race without a finish still counts"
    assert all(duels[(a, b)][1] + duels[(b, a)][1] <= 1 for a, b in duels)
    assert teams.team_head_to_head_matrix(df, 2).count() == 2


def test_a08_consistency(df, rows):
    stats = rows(teams.consistency(df, 1), "driverId", "position_std", "avg_position", "races", "top_10_ratio")
    assert stats == [(1, 0.5, 1.25, 4, 80.0), (2, 0.547723, 1.6, 5, 100.0), (3, 0.707107, 2.5, 2, 66.67), (4, None, 4.0, 1, 100.0)]
    assert [r["driverId"] for r in teams.consistent_drivers(df, min_races=1).collect()] == [1]
    assert [r["driverId"] for r in teams.fluctuating_drivers(df, min_races=1).collect()] == [3, 2, 1, 4]


def test_a09_laps(spark, df, rows):
    table = [(1, 1, 1, 100), (1, 1, 1, 120), (1, 1, 2, 110), (5, 1, 1, 90), (9, 1, 1, 10)]
    times = spark.createDataFrame(table, "raceId bigint, circuitId bigint, driverId bigint, milliseconds bigint")
    found = rows(laps.efficiency(df, times), "driverId", "constructorId", "avg_ms", "fastest_ms")
    assert found == [(1, 1, 103.333333, 90), (2, 2, 110.0, 90)], "a lap of an unknown race is left out"
    twice = df.unionByName(df.where("raceId = 1 AND driverId = 1").withColumn("constructorId", F.lit(9).cast("bigint")))
    assert (1, 9, 110.0, 90) in rows(laps.efficiency(twice, times), "driverId", "constructorId", "avg_ms", "fastest_ms")
    assert rows(laps.lap_box(df, times), "n", "median") == [(4, 105.0)]
    assert rows(laps.lap_box(twice, times), "n", "median") == [(6, 105.0)]
    best = laps.team_efficiency(df, times).first()
    assert (best["constructorRef"], round(best["efficiency_ratio"], 6)) == ("red", 0.870968)
    assert laps.driver_efficiency(df, times).count() == 2
    assert laps.team_circuit_efficiency(df, times).count() == 2
    assert rows(laps.team_circuit_display(df, times, 1), "constructorId") == [(1,)]


def test_a10_lineup_window_is_inclusive(df):
    scores = {r["driver_name"]: r for r in scoring.driver_scores(df, 3, 1).collect()}
    assert scores["alfa"]["races"] == 5 and scores["alfa"]["total_points"] == 36.0
    assert scoring.driver_scores(df, 2, 1).where("driver_name = 'alfa'").first()["races"] == 3
    assert scores["delta"]["final_score"] is None, "no deviation, no score"
    assert scoring.driver_scores(df, 3).count() == 0, "too few races"


def test_a11_weights(df):
    first = scoring.weighted_drivers(df, 2000).first()
    assert (first["driverRef"], round(first["weighted_points"], 6)) == ("alfa", 10 * 0.25 + 16 * 0.5 + 10)
    team = scoring.weighted_constructors(df, 2001).first()
    assert (team["constructorRef"], round(team["weighted_points"], 6)) == ("red", round(22 / 3 + 10, 6))


def test_a11_features(df, rows):
    found = rows(features.forecast_rows(df, 2000, lagged_flags=False).where("driverId = 1"), "raceId", "previous_season_points", "recent_form", "career_experience", "did_not_finish")
    assert found == [(1, None, None, 0, 0), (2, 10.0, None, 1, 1), (3, 0.0, 6.666667, 2, 0), (4, 10.0, 5.333333, 3, 0), (5, 6.0, 8.666667, 4, 0)]
    lagged = rows(features.forecast_rows(df, 2000).where("driverId = 1"), "raceId", "recent_form", "did_not_finish")
    assert lagged == [(1, None, None), (2, None, 0), (3, None, 1), (4, 6.666667, 0), (5, 5.333333, 0)]
    strength = features.forecast_rows(df, 2003).where("driverId = 1").first()["team_strength"]
    assert strength == pytest.approx((10 + 1 + 1) / 3)
    inputs = features.forecast_inputs(features.forecast_rows(df, 2000)).where("driverId = 1").first()
    assert (inputs["previous_season_points"], inputs["career_experience"], inputs["current_points"]) == (10.0, 5, 10.0)


def test_a12_growth_and_risk(df, rows):
    growth = {r["constructorId"]: (round(r["point_growth"], 6), r["volatility"]) for r in scoring.team_growth(df).collect()}
    assert growth[1][0] == round((1.2 + 10 / 22 - 1) / 2, 6)
    assert growth[2][0] == -0.3875
    assert growth[3][0] == -0.5, "a missed season keeps the points of the one before"
    assert growth[4] == (0.0, 0.0)
    after_zero = df.unionByName(df.where("raceId = 5").withColumn("year", F.lit(2004)).withColumn("points", F.lit(5.0)))
    assert scoring.team_growth(after_zero).where("constructorId = 3").first()["point_growth"] == -0.5
    risk = {r["constructor_name"]: r for r in scoring.risk_exponential(df).collect()}
    assert risk["grey"]["risk_score"] == 1.0, "no deviation counts as full risk"
    assert [r["constructor_name"] for r in scoring.risk_level(df, 1).collect()] == ["grey"]
    published = {r["constructorId"]: r["risk_score"] for r in scoring.risk_linear(df, growth=False).collect()}
    corrected = {r["constructorId"]: r["risk_score"] for r in scoring.risk_linear(df).collect()}
    assert corrected[2] == pytest.approx(published[2] + 0.3)
    assert scoring.risk_trend(df, 1).count() == 1


def test_a13_tracks(df, rows):
    found = rows(tracks.driver_circuits(df), "driverId", "circuitId", "avg_position", "position_std", "performance_score")
    assert found == [(1, 1, 1.0, 0.0, 0.6), (2, 1, 2.0, 0.0, 1.2)]
    assert [r["circuitId"] for r in tracks.circuit_difficulty(df).collect()] == [1, 2]
    profile = rows(tracks.driver_profile(df, "alfa"), "circuitId", "avg_position", "position_std", "avg_points", "performance_score")
    assert profile == [(1, 1.0, 0.0, 10.0, 3.533), (2, 2.0, 0.0, 3.0, 6.05)]
    summary = tracks.driver_summary(df, "alfa").first()
    assert (summary["avg_finish"], summary["circuits"], summary["strongest"], summary["weakest"]) == (1.5, 2, "c1", "c2")
    assert tracks.selected_grid_points(df, "alfa", 1).count() == 5
    assert rows(tracks.points_box(df, "alfa"), "circuitRef", "median") == [("c1", 10.0), ("c2", 3.0)]
    retired = tracks.driver_worst(df.where("position IS NULL"), "gamma")
    assert retired.first()["performance_score"] is None


def test_a14_titles(df, rows):
    assert rows(titles.champions(df), "year", "driverRef", "points") == [(2000, "beta", 16.0), (2001, "alfa", 16.0), (2003, "alfa", 10.0)]
    assert titles.back_to_back(df).count() == 0
    assert titles.retention_calendar(df).first()["retention_rate"] == 0.0
    assert tuple(titles.retention_consecutive(df).first()) == (1, 2, 0.5)
    assert rows(titles.retention_flags(df)) == [(2000, False), (2001, True)]
    assert tuple(titles.longest_streak(df).first()) == (2, "alfa")
    assert tuple(titles.longest_streak(df.where("year < 2002")).first()) == (1, None)
    assert rows(titles.recent_titles(df, 2)) == [("alfa", 2)]
    outlook = titles.outlook(df).first()
    assert (outlook["retention_rate"], outlook["recent_rate"], outlook["probability"], outlook["current_champion"]) == (0.5, 0.2, 0.5, "alfa")


def test_a15_ages(df, rows):
    assert tuple(titles.age_year_summary(df).first()) == (27.0, 20, 33)
    days = titles.age_days_summary(df).first()
    assert days["youngest"] == pytest.approx(7670 / 365.25) and days["median"] == pytest.approx(11142 / 365.25)
    assert rows(titles.age_decades(df), "decade", "champions") == [(2000, 5)]
    histogram = rows(titles.age_histogram(df), "bin", "n")
    assert len(histogram) == 20 and sum(n for _, n in histogram) == 5 and histogram[-1] == (20, 1)
    assert titles.age_recent(df, 0).first()["trend"] == "Older"
    assert titles.age_trend_by_year(df.where("year = 2000")).first()["slope"] is None


def test_a16_next_team(df, rows):
    assert rows(next_team.history(df, "alfa"), "year", "constructorRef", "points", "best_position", "races") == [
        (2000, "red", 10.0, 1, 2), (2001, "blue", 10.0, 1, 1), (2001, "red", 6.0, 2, 1), (2003, "red", 10.0, 1, 1)
    ]
    by_rows = next_team.outlook_rows(df, "alfa").first()
    assert (by_rows["current_team"], by_rows["teams"], by_rows["avg_years_per_team"]) == ("red", 2, 1.5)
    assert by_rows["recent_trend"] == pytest.approx((0 - 0.4 + 2 / 3) / 3)
    assert (by_rows["direction"], by_rows["likelihood"]) == ("Improving", "Low")
    by_years = next_team.outlook_years(df, "alfa").first()
    assert (by_years["races_at_current"], by_years["years_at_current"], by_years["avg_team_duration"]) == (4, 3, 2.0)
    assert by_years["recent_trend"] == pytest.approx((0.6 - 0.375) / 2)
    assert (by_years["median_team_points"], by_years["likelihood"]) == (4.5, "High")
    assert next_team.candidates_by_points(df, "alfa").count() == 0
    assert rows(next_team.candidates_by_points(df, "beta")) == [("red", 10.0)]
    assert next_team.candidates_by_name(df, "alfa").count() == 0, "a move is not likely"
    assert next_team.outlook_rows(df, "nobody").count() == 0 and next_team.outlook_years(df, "nobody").count() == 0
    assert rows(next_team.by_team(df, "beta")) == [("blue", 2, 7.333333), ("red", 1, 8.0)]
    assert rows(next_team.by_year(df, "alfa")) == [(2000, 5.0), (2001, 8.0), (2003, 10.0)]


def test_eda(df, rows):
    assert [r["driverId"] for r in eda.top_drivers(df).collect()] == [2, 1, 3, 4]
    assert [r["circuit_name"] for r in eda.circuit_points(df, 1).collect()] == ["Circuit 2"]
    assert [tuple(r) for r in eda.status_counts(df).collect()] == [("Finished", 12), ("Did Not Finish (engine)", 2)]
    assert rows(eda.yearly_points(df)) == [(2000, 6.0), (2001, 8.0), (2003, 4.75)]
    curve = eda.density(df, "positionOrder", 400)
    step = 3 / 399
    assert 0.6 < curve.agg(F.sum("density")).first()[0] * step < 1.0
    assert rows(eda.driver_list(df)) == [("alfa",), ("beta",), ("delta",), ("gamma",)]


def test_density_equals_the_direct_sum(spark):
    """Few values exactly; a continuous column within a millionth; one value and no rows without error."""
    for bound, formula in ((1e-12, "cast(id % 7 * id % 11 as double)"), (1e-6, "pow(pmod(hash(id), 1000003) / 1000003D, 2) * 50")):
        frame = spark.range(3000).selectExpr(f"{formula} as x")
        x = np.array([r["x"] for r in frame.collect()])
        width = x.std(ddof=1) * len(x) ** -0.2
        found = eda.density(frame, "x", 50).orderBy("point").collect()
        for r in found:
            direct = np.exp(-0.5 * ((r["x"] - x) / width) ** 2).sum() / (width * len(x) * np.sqrt(2 * np.pi))
            assert abs(r["density"] - direct) <= bound
        assert len(found) == 50
    same = spark.range(5).selectExpr("2.0 as x")
    assert {r["density"] for r in eda.density(same, "x").collect()} == {None}
    assert eda.density(same.limit(0), "x").count() == 0


def test_feature_table(spark, df, rows):
    qualifying = df.select("raceId", "driverId", F.col("grid").alias("position"))
    assert rows(features.team_dnf(df)) == [(1, 0.166667), (2, None), (3, 0.333333), (4, None)]
    assert rows(features.team_points(df))[2] == (3, 5.0)
    assert rows(features.circuit_spread(df))[0] == (1, round((1 + 0.5**0.5 + (5 / 3) ** 0.5) / 3, 6))
    no_status = df.withColumn("status", F.lit(None).cast("string"))
    assert {r[1] for r in rows(features.team_dnf(no_status))} == {None}
    full = features.engineered(df, qualifying)
    assert full.count() == 14
    assert full.where("driverId = 4").first()["std_finishing_position"] is None
