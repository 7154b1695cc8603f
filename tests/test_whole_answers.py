"""Queries answer for every member, not for a chosen one."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def asked(spark, name):
    return entry.queries()[name](spark, FOLDER)


def test_pair_table_has_every_pair_that_met(spark):
    finishes = asked(spark, "a04_driver_race_pos").select("driverId", "raceId")
    met = finishes.toDF("a", "raceId").join(finishes.toDF("b", "raceId"), "raceId").where("a < b")
    found = {(r["a"], r["b"]) for r in asked(spark, "a04_pair_table").collect()}
    assert found == {tuple(r) for r in met.select("a", "b").distinct().collect()}


@pytest.mark.parametrize("name", ["a07_h2h_team", "a07_h2h_team_circuit"])
def test_head_to_head_has_every_team(spark, name):
    master = asked(spark, "master_race_results")
    teams = {r[0] for r in master.select("constructorId").distinct().collect()}
    found = asked(spark, name).collect()
    assert {r["team"] for r in found} == teams
    assert {(r["opponent"], r["team"], r["races"]) for r in found} == {(r["team"], r["opponent"], r["races"]) for r in found}


@pytest.mark.parametrize("name", ["a07_circuit_rate", "a09_team_circuit"])
def test_grids_have_every_cell_and_no_row_of_a_key_alone(spark, name):
    found = [(r["constructorId"], r["circuitId"]) for r in asked(spark, name).collect()]
    cells = {(a, b) for a, _ in found for _, b in found}
    assert len(found) == len(set(found)) == len(cells)
    assert not any(None in cell for cell in found)
