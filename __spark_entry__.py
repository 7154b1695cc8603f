"""Registered queries and their oracle SQL.

Each query runs over the order tables of one folder. The race tables and the
race-results master are derived once per session and folder and then held.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from functools import cached_property
from uuid import uuid4

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from gridstats.functions import seconds_of  # noqa: E402
from gridstats.operators.cleaning import clean, removed_rows  # noqa: E402
from gridstats.operators.grids import wide  # noqa: E402
from gridstats.plans import (  # noqa: E402
    eda,
    features,
    laps,
    masters,
    model_facts,
    models,
    next_team,
    performance,
    rivalry,
    scoring,
    teams,
    titles,
    tracks,
)
from gridstats.sources import (  # noqa: E402
    SPECS,
    RaceTables,
    deal,
    first_two_columns,
    forget,
    keep,
    keep_bucketed,
    load,
    raw,
    save,
    scatter_rows,
    shared_folder,
)
from oracle import ORACLE  # noqa: E402

try:  # the corpus operators may be absent
    import corpus_pipeline
    from gridstats.llm import queries as corpus
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "gridstats.llm"):
        raise
    corpus = corpus_pipeline = None

DRIVER, OTHER = "Supplier#000000001", "Supplier#000000002"
DRIVER_ID, OTHER_ID = 1, 2
START = 1997
ENTRY = ["raceId", "driverId"]


class Session:
    """Race tables and masters of one folder; models are fitted on first use."""

    _held: dict[tuple[str, str], Session] = {}

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.tables = RaceTables(spark, root)

    @classmethod
    def of(cls, spark: SparkSession, root: str) -> Session:
        key = (spark.sparkContext.applicationId, root)
        if key not in cls._held:
            cls._held[key] = cls(spark, root)
        return cls._held[key]

    @cached_property
    def master(self) -> DataFrame:
        return keep(self.master_plan())

    def master_plan(self) -> DataFrame:
        t = self.tables
        return masters.race_results(
            t.results, t.races, t.drivers, t.constructors, t.circuits, t.seasons, t.status
        )

    def qualifying(self) -> DataFrame:
        t = self.tables
        return masters.qualifying(t.qualifying, t.races, t.drivers, t.constructors)

    def sprints(self) -> DataFrame:
        t = self.tables
        return masters.sprint_results(t.sprint_results, t.races, t.drivers, t.constructors)

    def pits_plan(self) -> DataFrame:
        t = self.tables
        return masters.pit_stops(t.pit_stops, t.races, t.drivers, t.constructors)

    def laps_plan(self) -> DataFrame:
        t = self.tables
        return masters.lap_times(t.lap_times, t.races, t.drivers, t.circuits)

    @cached_property
    def circuit_ids(self) -> list[int]:
        """Keys of the circuits table, one per column of a matrix for display."""
        keys = self.tables.circuits.select("circuitId").orderBy("circuitId").collect()
        return [r["circuitId"] for r in keys]

    def pits(self) -> DataFrame:
        return self.pits_plan().select("raceId", "driverId", "duration")

    def laps(self) -> DataFrame:
        return self.laps_plan().select("raceId", "driverId", "circuitId", "milliseconds")

    @cached_property
    def drives(self) -> DataFrame:
        """Entries, dealt like the totals of laps and stops; the wide master need not be written for them."""
        figures = ["constructorId", "position", "positionOrder"]
        return keep_bucketed(self.master_plan().select(*ENTRY, *figures), *ENTRY)

    @cached_property
    def pit_totals(self) -> DataFrame:
        return keep_bucketed(performance.pit_totals(deal(self.pits(), *ENTRY)), *ENTRY, dealt=True)

    @cached_property
    def lap_totals(self) -> DataFrame:
        return keep_bucketed(laps.lap_totals(deal(self.laps(), *ENTRY)), *ENTRY, dealt=True)

    def cleaned(self, name: str, few_copies: bool = False) -> DataFrame:
        return clean(self.tables.as_text(name), name, few_copies)

    def new_folder(self) -> str:
        """A fresh folder for files that driver and executors share."""
        return f"{shared_folder(self.spark)}/files-{uuid4().hex}"

    def from_csv(self, name: str) -> DataFrame:
        """A table written as a raw CSV file, read back and cleaned."""
        folder = self.new_folder()
        write_text(self.tables.as_text(name), f"{folder}/{name}.csv")
        return clean(raw(self.spark, folder, name), name)

    def through_csv(self, name: str) -> DataFrame:
        """A cleaned table saved as CSV and read and cleaned again."""
        folder = self.new_folder()
        save(self.cleaned(name), folder, f"{name}.csv", fmt="csv")
        return clean(raw(self.spark, folder, name), name)

    def padded_names(self, name: str) -> DataFrame:
        """A table from a CSV file whose column names have blanks around them."""
        folder, text = self.new_folder(), self.tables.as_text(name)
        write_text(text.toDF(*[f"  {c} " for c in text.columns]), f"{folder}/{name}.csv")
        return clean(raw(self.spark, folder, name), name)

    def many_files(self, *names: str) -> DataFrame:
        """First two columns of several cleaned tables, saved as CSV files of one folder."""
        folder = self.new_folder()
        for name in names:
            save(self.cleaned(name), folder, f"{name}.csv", fmt="csv")
        return scatter_rows(self.spark, folder)

    def close(self) -> None:
        """Remove what was kept for this session."""
        forget(self.spark)
        Session._held = {k: s for k, s in Session._held.items() if s.spark is not self.spark}

    def through_parquet(self, name: str) -> DataFrame:
        """A cleaned table written and loaded by name."""
        folder = self.new_folder()
        save(self.cleaned(name), folder, f"{name}_clean")
        return load(self.spark, folder, f"{name}_clean")

    def engineered(self) -> DataFrame:
        return features.engineered(self.master, self.qualifying())

    @cached_property
    def forecast(self) -> DataFrame:
        return keep(features.forecast_rows(self.master, START))

    @cached_property
    def training(self) -> DataFrame:
        return features.forecast_training(self.forecast)

    @cached_property
    def forest(self):
        return models.fit_forecast_forest(self.training)

    @cached_property
    def boosted(self):
        return models.fit_forecast_boosted(self.training)

    @property
    def both_models(self) -> dict:
        return {"random_forest": self.forest, "boosted_trees": self.boosted}

    def predictions(self) -> DataFrame:
        return models.predict_season(self.both_models, features.forecast_inputs(self.forecast))

    @cached_property
    def finish_rows(self) -> DataFrame:
        return keep(self.engineered())

    @cached_property
    def finish(self):
        return models.fit_finish(self.finish_rows)

    @cached_property
    def podiums(self) -> DataFrame:
        return keep(models.podium_rows(self.master))

    @cached_property
    def podium_grid(self):
        return models.fit_podium(self.podiums, models.GRID_ONLY)

    @cached_property
    def podium_means(self):
        return models.fit_podium(self.podiums, models.GRID_AND_MEANS, min_rows=100)


def write_text(df: DataFrame, path: str) -> None:
    """A CSV folder with the blanks that the values have."""
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(**blanks).csv(path, header=True, escape='"')


def comparable(df: DataFrame) -> DataFrame:
    """Doubles at six digits, days as text, intervals in seconds."""
    shown = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind == "double":
            column = F.round(column, 6)
        elif kind == "date":
            column = column.cast("string")
        elif kind.startswith("interval"):
            column = F.round(seconds_of(column), 6)
        shown.append(column.alias(name))
    return df.select(*shown)


PLANS: dict[str, Callable[[Session], DataFrame]] = {
    # files
    "src_csv": lambda s: s.from_csv("circuits"),
    "snk_csv": lambda s: s.through_csv("circuits"),
    "cols_strip": lambda s: s.padded_names("circuits"),
    "src_csv_nulls": lambda s: s.from_csv("qualifying"),
    "src_named": lambda s: s.through_parquet("lap_times"),
    "src_glob": lambda s: s.many_files("constructor_standings", "driver_standings", "results"),
    # cleaning
    **{f"clean_{name}": lambda s, name=name: s.cleaned(name) for name in SPECS},
    "dst_rows": lambda s: removed_rows(s.tables.as_text("lap_times"), "lap_times"),
    "dst_rows_few_copies": lambda s: removed_rows(s.tables.as_text("lap_times"), "lap_times", few_copies=True),
    "clean_results_few_copies": lambda s: s.cleaned("results", few_copies=True),
    # profiles and charts
    "profile_table": lambda s: eda.profile_table(s.tables.results),
    "profile_before_after": lambda s: eda.profile_before_after(
        s.tables.as_text("constructor_results"), s.cleaned("constructor_results")
    ),
    "profile_head": lambda s: eda.head(s.tables.circuits, "circuitId"),
    "profile_first_two": lambda s: first_two_columns(s.tables.lap_times),
    "eda_position_hist": lambda s: eda.histogram(s.master, "positionOrder"),
    "eda_position_density": lambda s: eda.density(s.master, "positionOrder"),
    "eda_grid_finish": lambda s: eda.grid_finish(s.master),
    "eda_grid_finish_corr": lambda s: eda.grid_finish_corr(s.master),
    "eda_top_drivers": lambda s: eda.top_drivers(s.master),
    "eda_circuit_points": lambda s: eda.circuit_points(s.master),
    "eda_status_counts": lambda s: eda.status_counts(s.master),
    "eda_yearly_points": lambda s: eda.yearly_points(s.master),
    "dst_names": lambda s: eda.driver_list(s.master),
    # masters
    "master_race_results": lambda s: s.master_plan(),
    "master_qualifying": lambda s: s.qualifying(),
    "master_sprint_results": lambda s: s.sprints(),
    "master_pit_stops": lambda s: s.pits_plan(),
    "master_lap_times": lambda s: s.laps_plan(),
    # A1, A2, A3
    "a01_driver_win_ratio": lambda s: performance.driver_win_ratio(s.master),
    "a01_driver_win_ratio_order": lambda s: performance.driver_win_ratio(
        s.master, 10, "positionOrder"
    ),
    "a01_constructor_wins": lambda s: performance.constructor_wins(s.master),
    "a01_podiums_points": lambda s: performance.driver_totals(s.master),
    "a01_constructor_podiums": lambda s: performance.constructor_podiums(s.master),
    "a02_position_gain": lambda s: performance.position_gain(s.master),
    "a02_grid_points": lambda s: performance.grid_points(s.master, DRIVER),
    "a03_pit_counts": lambda s: performance.pit_counts(s.pit_totals),
    "a03_pit_corr_filled": lambda s: performance.pit_corr_filled(s.drives, s.pit_totals),
    "a03_pit_corr": lambda s: performance.pit_corr(s.drives, s.pit_totals, 1, 20),
    "a03_pits_by_position": lambda s: performance.pits_by_position(s.drives, s.pit_totals),
    "a03_pits_by_position_filled": lambda s: performance.pits_by_position_filled(s.drives, s.pit_totals),
    "a03_pit_trend": lambda s: performance.pit_trend(s.drives, s.pit_totals),
    "a03_pit_duration": lambda s: performance.pit_duration(s.drives, s.pit_totals),
    # A4, A5
    "a04_driver_race_pos": lambda s: rivalry.race_positions(s.master),
    "a04_pair_table": lambda s: rivalry.pair_table(s.master),
    "a04_corr_pairs": lambda s: rivalry.corr_pairs(s.master),
    "a04_rivalries": lambda s: rivalry.rivalries(s.master),
    "a04_rivalry_drivers": lambda s: rivalry.rivalry_drivers(s.master),
    "a04_pair_detail": lambda s: rivalry.pair_detail(s.master, DRIVER_ID, OTHER_ID),
    "a04_rivals_of": lambda s: rivalry.rivals_of(s.master, DRIVER_ID),
    "a04_pair_races": lambda s: rivalry.pair_races(s.master, DRIVER_ID, OTHER_ID),
    "a05_common_seasons": lambda s: rivalry.common_seasons(s.master, DRIVER, OTHER),
    "a05_team_perf": lambda s: rivalry.team_performance(s.master),
    "a05_original_avg": lambda s: rivalry.original_average(s.master, DRIVER, OTHER.upper()),
    "a05_swap_scaled": lambda s: rivalry.swap_scaled(s.master, DRIVER, OTHER),
    "a05_swap_expected": lambda s: rivalry.swap_expected(s.master, DRIVER, OTHER),
    # A6, A7, A8
    "a06_steps_all": lambda s: teams.team_steps(s.master),
    "a06_moves": lambda s: teams.team_moves(s.master),
    "a06_moves_driver": lambda s: teams.driver_moves(s.master, DRIVER),
    "a07_podium_rate": lambda s: teams.podium_rate(s.master),
    "a07_circuit_rate": lambda s: teams.circuit_rate(s.master),
    "a07_circuit_rate_mean": lambda s: teams.circuit_rate_mean(s.master),
    "a07_circuit_rate_top": lambda s: teams.circuit_rate_top(s.master),
    "a07_h2h_team": lambda s: teams.team_head_to_head(s.master),
    "a07_h2h_team_circuit": lambda s: teams.team_head_to_head(s.master, by_circuit=True),
    "a07_h2h_matrix": lambda s: teams.team_head_to_head_matrix(s.master),
    "a08_consistency": lambda s: teams.consistency(s.master),
    "a08_consistent": lambda s: teams.consistent_drivers(s.master, below=100),
    "a08_fluctuating": lambda s: teams.fluctuating_drivers(s.master),
    # A9
    "a09_avg_laps": lambda s: laps.average_laps(s.drives, s.lap_totals),
    "a09_efficiency": lambda s: laps.efficiency(s.drives, s.lap_totals),
    "a09_team_eff": lambda s: laps.team_efficiency(s.drives, s.lap_totals, names=s.master_plan()),
    "a09_driver_eff": lambda s: laps.driver_efficiency(s.drives, s.lap_totals, names=s.master_plan()),
    "a09_team_circuit": lambda s: laps.team_circuit_efficiency(s.drives, s.lap_totals),
    "a09_team_circuit_display": lambda s: laps.team_circuit_display(s.drives, s.lap_totals),
    "rs_unstack": lambda s: tracks.circuit_wins(s.master).frame(),
    "rs_unstack_mean": lambda s: tracks.circuit_wins(s.master).by_row(),
    "rs_unstack_chosen": lambda s: tracks.circuit_wins(s.master).dense(rivalry.busiest(s.master, 5)),
    "rs_pivot_agg": lambda s: wide(
        laps.efficiency(s.drives, s.lap_totals),
        "constructorId",
        "circuitId",
        "efficiency_ratio",
        s.circuit_ids,
    ),
    "a09_lap_box": lambda s: laps.lap_box(s.master, s.laps()),
    # A10, A11, A12
    "a10_driver_scores": lambda s: scoring.driver_scores(s.master),
    "a10_lineup": lambda s: scoring.lineup(s.master),
    "a10_pair": lambda s: scoring.lineup_pair(s.master),
    "a10_pair_stats": lambda s: scoring.lineup_pair_stats(s.master),
    "a11_weighted_drivers": lambda s: scoring.weighted_drivers(s.master, START),
    "a11_weighted_constructors": lambda s: scoring.weighted_constructors(s.master, START),
    "a11_features": lambda s: s.training,
    "a11_features_lagged": lambda s: features.forecast_training(
        features.forecast_rows(s.master, START, lagged_flags=True)
    ),
    "a11_features_same_race": lambda s: features.forecast_training(
        features.forecast_rows(s.master, START, lagged_flags=False)
    ),
    "a11_inputs": lambda s: features.forecast_inputs(s.forecast),
    "a11_fit_rf": lambda s: model_facts.regression_facts(s.forest, s.training, "points"),
    "a11_fit_gbt": lambda s: model_facts.regression_facts(s.boosted, s.training, "points"),
    "a11_predict": lambda s: model_facts.prediction_facts(
        s.predictions(), models.split(s.training)[0], "random_forest", list(s.both_models)
    ),
    "a11_confidence": lambda s: model_facts.confidence_facts(
        models.forecast_confidence(s.predictions(), list(s.both_models))
    ),
    "a11_importance": lambda s: model_facts.share_facts(
        models.forecast_importance(s.both_models, s.training), "model"
    ),
    "a12_growth": lambda s: scoring.team_growth(s.master),
    "a12_risk_linear": lambda s: scoring.risk_linear(s.master),
    "a12_risk_linear_published": lambda s: scoring.risk_linear(s.master, growth=False),
    "a12_risk_exp": lambda s: scoring.risk_exponential(s.master),
    "a12_risk_level": lambda s: scoring.risk_level(s.master),
    "a12_trend": lambda s: scoring.risk_trend(s.master),
    # A13
    "a13_driver_circuit": lambda s: tracks.driver_circuits(s.master),
    "a13_worst": lambda s: tracks.worst_combinations(s.master),
    "a13_best": lambda s: tracks.best_combinations(s.master),
    "a13_difficulty": lambda s: tracks.circuit_difficulty(s.master),
    "a13_driver_profile": lambda s: tracks.driver_profile(s.master, DRIVER),
    "a13_driver_best": lambda s: tracks.driver_best(s.master, DRIVER),
    "a13_driver_worst": lambda s: tracks.driver_worst(s.master, DRIVER),
    "a13_driver_summary": lambda s: tracks.driver_summary(s.master, DRIVER),
    "a13_points_box": lambda s: tracks.points_box(s.master, DRIVER),
    "a13_grid_points": lambda s: tracks.selected_grid_points(s.master, DRIVER),
    # A14, A15
    "a14_champions": lambda s: titles.champions(s.master),
    "a14_back_to_back": lambda s: titles.back_to_back(s.master),
    "a14_retention_calendar": lambda s: titles.retention_calendar(s.master, 3),
    "a14_retention_flags": lambda s: titles.retention_flags(s.master),
    "a14_retention_consecutive": lambda s: titles.retention_consecutive(s.master),
    "a14_streak": lambda s: titles.longest_streak(s.master),
    "a14_recent_titles": lambda s: titles.recent_titles(s.master, 3),
    "a14_outlook": lambda s: titles.outlook(s.master),
    "a15_age_year": lambda s: titles.age_year_summary(s.master),
    "a15_age_days": lambda s: titles.age_days_summary(s.master),
    "a15_decades": lambda s: titles.age_decades(s.master),
    "a15_trend": lambda s: titles.age_trend(s.master),
    "a15_trend_year": lambda s: titles.age_trend_by_year(s.master),
    "a15_hist": lambda s: titles.age_histogram(s.master),
    "a15_recent": lambda s: titles.age_recent(s.master, 3),
    # A16
    "a16_history": lambda s: next_team.history(s.master, DRIVER),
    "a16_outlook_rows": lambda s: next_team.outlook_rows(s.master, DRIVER),
    "a16_outlook_years": lambda s: next_team.outlook_years(s.master, DRIVER),
    "a16_candidates": lambda s: next_team.candidates_by_points(s.master, DRIVER),
    "a16_candidates_by_name": lambda s: next_team.candidates_by_name(s.master, DRIVER),
    "a16_by_team": lambda s: next_team.by_team(s.master, DRIVER),
    "a16_by_year": lambda s: next_team.by_year(s.master, DRIVER),
    # A17
    "a17_fit_grid": lambda s: model_facts.podium_facts(s.podium_grid, s.podiums),
    "a17_fit_avg": lambda s: model_facts.podium_facts(s.podium_means, s.podiums),
    "a17_confusion": lambda s: model_facts.confusion_facts(
        models.podium_confusion(s.podium_means, s.podiums)
    ),
    "a17_predictions": lambda s: models.podium_predictions(s.podium_means, s.podiums).select(
        "resultId", "driverId", "podium", F.col("prediction").isin(0.0, 1.0).alias("is_label")
    ),
    "a17_importance": lambda s: model_facts.importance_facts(
        models.podium_importance(s.podium_means, s.podiums)
    ),
    "a17_rows": lambda s: s.podiums,
    # features and finish model
    "f_driver_finish": lambda s: features.driver_finish(s.master),
    "f_driver_qual": lambda s: features.driver_qualifying(s.tables.qualifying),
    "f_team_points": lambda s: features.team_points(s.master),
    "f_team_dnf": lambda s: features.team_dnf(s.master),
    "f_circuit_spread": lambda s: features.circuit_spread(s.master),
    "f_engineered": lambda s: s.engineered(),
    "m_finish_forest": lambda s: model_facts.regression_facts(s.finish[0], s.finish_rows, "positionOrder"),
    "m_finish_importance": lambda s: model_facts.share_facts(models.finish_importance(*s.finish)),
}


def entry(spark: SparkSession) -> DataFrame:
    """Win ratio per driver at the smallest scale."""
    return queries()["a01_driver_win_ratio"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(plan: Callable[[Session], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: comparable(plan(Session.of(spark, str(sf_dir).rstrip("/"))))

    found = {name: runner(plan) for name, plan in PLANS.items()}
    if corpus:
        found |= corpus.QUERIES | {"pipeline": corpus_pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    found = dict(ORACLE)
    if corpus:
        found |= corpus.ORACLE
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
