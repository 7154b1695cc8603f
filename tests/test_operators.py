import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstats.operators.grids import SparseMatrix, dense_grid, wide
from gridstats.operators.pairs import SUMS, _meetings, best_pairs, correlation_of, pair_correlation, pair_sums
from gridstats.operators.quantiles import box_stats, median_of, quantiles, ranged, value_counts
from gridstats.operators.sequences import numbered, shifted, value_stretch


def skewed(spark, n=3000):
    """Entries in which one driver and one race hold a third of the rows each."""
    rng = random.Random(7)
    table = []
    for i in range(n):
        driver = 1 if rng.random() < 0.33 else rng.randint(2, 40)
        race = 100 if rng.random() < 0.33 else rng.randint(101, 160)
        table.append((i, driver, race, 1990 + rng.randint(0, 5), rng.randint(1, 12), float(rng.randint(0, 30))))
    return spark.createDataFrame(table, "id bigint, driver bigint, race bigint, year int, round int, v double")


def test_numbered_equals_one_window(spark, rows):
    df = skewed(spark)
    ranked = numbered(
        df.withColumn("s", value_stretch(df, "v")), ["race"], "s", [F.col("v").desc(), F.col("id")], "n"
    )
    plain = df.withColumn("n", F.row_number().over(W.partitionBy("race").orderBy(F.col("v").desc(), "id")))
    assert rows(ranked, "id", "n") == rows(plain, "id", "n")


@pytest.mark.parametrize("ahead", [False, True])
def test_shifted_equals_one_window(spark, rows, ahead):
    df = skewed(spark)
    along = W.partitionBy("driver").orderBy("year", "round", "id")
    step = F.lead if ahead else F.lag
    plain = df.select("id", *[step("v", k).over(along).alias(f"v{k}") for k in (1, 2, 3)])
    moved = shifted(df, "driver", "year", ["round", "id"], {f"v{k}": ("v", k) for k in (1, 2, 3)}, ahead=ahead)
    assert rows(moved, "id", "v1", "v2", "v3") == rows(plain)


def test_shifted_with_one_row_per_season(spark, rows):
    df = spark.createDataFrame([(i, 1, 1990 + i, 1, float(i)) for i in range(6)], "id int, d int, year int, round int, v double")
    moved = shifted(df, "d", "year", ["round", "id"], {"a": ("v", 1), "b": ("v", 3)})
    assert rows(moved, "id", "a", "b") == [
        (0, None, None), (1, 0.0, None), (2, 1.0, None), (3, 2.0, 0.0), (4, 3.0, 1.0), (5, 4.0, 2.0),
    ]


@pytest.mark.parametrize("block, chunk", [(256, 4096), (12, 20)])
def test_pair_sums_equal_a_self_join(spark, rows, block, chunk):
    df = skewed(spark, 1500).groupBy("race", "driver").agg(F.avg("v").alias("v"))
    df = df.withColumn("v", F.when(F.col("driver") % 5 != 0, F.col("v")))
    a = df.toDF("race", "a", "x")
    b = df.toDF("race", "b", "y")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()

    def total(value):
        return F.coalesce(F.sum(F.when(both, value)), F.lit(0.0))

    plain = (
        a.join(b, "race")
        .where("a < b")
        .groupBy("a", "b")
        .agg(
            total(F.lit(1.0)),
            total(F.col("x")),
            total(F.col("y")),
            total(F.col("x") * F.col("x")),
            total(F.col("y") * F.col("y")),
            total(F.col("x") * F.col("y")),
            total(F.abs(F.col("x") - F.col("y"))),
            total((F.col("x") < F.col("y")).cast("double")),
            total((F.col("x") > F.col("y")).cast("double")),
            F.count("*").cast("double"),
        )
    )
    found = pair_sums(df, "race", "driver", "v", block=block, chunk=chunk)
    assert rows(found, digits=4) == rows(plain, digits=4)


def test_pair_correlation(spark):
    table = [(r, d, v) for d, vs in {1: [1, 2, 3, 4], 2: [2, 1, 4, 3], 3: [5, 5, 5, 5], 4: [9]}.items() for r, v in enumerate(vs)]
    df = spark.createDataFrame([(r, d, float(v)) for r, d, v in table], "race int, driver int, v double")
    found = {(r["a"], r["b"]): r["c"] for r in pair_sums(df, "race", "driver", "v").select("a", "b", pair_correlation().alias("c")).collect()}
    assert found[(1, 2)] == pytest.approx(np.corrcoef([1, 2, 3, 4], [2, 1, 4, 3])[0, 1])
    assert found[(1, 3)] is None, "constant side"
    assert found[(1, 4)] is None, "one common race"
    assert (3, 4) in found


def test_quantiles_equal_numpy(spark):
    df = skewed(spark)
    exact = {r["race"]: (r["n"], r["a"], r["b"]) for r in quantiles(value_counts(df, ["race"], "v"), ["race"], {"a": 0.25, "b": 0.9}, buckets=8).collect()}
    groups: dict = {}
    for r in df.collect():
        groups.setdefault(r["race"], []).append(r["v"])
    assert set(exact) == set(groups)
    for race, values in groups.items():
        assert exact[race] == (len(values), pytest.approx(np.quantile(values, 0.25)), pytest.approx(np.quantile(values, 0.9)))


def test_median_of_whole_frame_with_an_outlier(spark):
    values = [0.1, 0.2, 0.3, 0.4, 0.5, 1e9]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert df.limit(1).select(median_of(df, "v").alias("m")).first()["m"] == pytest.approx(0.35)


def test_box_stats(spark, rows):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0)], "k string, v double")
    assert rows(box_stats(df, ["k"], "v"), "k", "n", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers") == [
        ("a", 6, 2.25, 3.5, 4.75, 1.0, 5.0, 1),
        ("b", 1, 7.0, 7.0, 7.0, 7.0, 7.0, 0),
    ]


def test_weighted_box_counts_a_value_several_times(spark, rows):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1)], "v double, w int").withColumn("k", F.lit("a"))
    assert rows(box_stats(df, ["k"], "v", "w"), "n", "q1", "median", "q3") == [(4, 1.0, 1.0, 1.25)]


def test_dense_grid_fills_every_combination(spark, rows):
    cells = spark.createDataFrame([(1, 10, 0.5), (2, 20, 0.25)], "r int, c int, v double")
    grid = dense_grid(cells, cells.select("r"), cells.select("c"), {"v": 0.0})
    assert rows(grid, "r", "c", "v") == [(1, 10, 0.5), (1, 20, 0.0), (2, 10, 0.0), (2, 20, 0.25)]
    assert rows(wide(cells, "r", "c", "v", [10, 20])) == [(1, 0.5, 0.0), (2, 0.0, 0.25)]


def pair_scores(sums):
    return -correlation_of(sums)


@pytest.mark.parametrize("block, chunk", [(4, 3), (256, 4096)])
def test_best_pairs_are_the_best_of_all(spark, block, chunk):
    draw = np.random.default_rng(12)
    # Two eras that share no race, and one driver who is in every race.
    table = [(r, d, float(draw.normal())) for r in range(40) for d in range(30) if d == 0 or (d < 15) == (r < 20) and draw.random() < 0.5]
    df = spark.createDataFrame([*table, (1, None, 3.0), (None, 3, 1.0), (2, 29, None)], "race bigint, driver bigint, v double")
    every = pair_sums(df, "race", "driver", "v").toPandas()
    every["key"] = pair_scores(every)
    wanted = every.dropna(subset=["key"]).sort_values(["key", "a", "b"]).head(6)
    found = best_pairs(df, "race", "driver", "v", pair_scores, 6, block=block, chunk=chunk).toPandas()

    found["key"] = pair_scores(found)
    found = found.sort_values(["key", "a", "b"]).head(6)
    assert found[["a", "b"]].to_numpy().tolist() == wanted[["a", "b"]].to_numpy().tolist()
    np.testing.assert_allclose(found[SUMS].to_numpy(float), wanted[SUMS].to_numpy(float), atol=1e-9)


def test_no_more_than_k_rows_leave_a_task(spark):
    table = [(r, d, float((r * 7 + d * 13) % 17)) for r in range(30) for d in range(60)]
    df = spark.createDataFrame(table, "race bigint, driver bigint, v double")
    found = best_pairs(df, "race", "driver", "v", pair_scores, 3, block=5)
    per_task = found.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in per_task) <= 3
    assert best_pairs(df.limit(0), "race", "driver", "v", pair_scores, 3).count() == 0


def test_blocks_that_share_no_group_do_not_meet(spark):
    table = [(r, d, 1.0) for r in range(200) for d in range(r // 10 * 10, r // 10 * 10 + 10)]
    df = spark.createDataFrame(table, "grp bigint, member bigint, value double")
    met = _meetings(df, 10, 4096).select("low", "high").distinct().count()
    blocks = _meetings(df, 10, 4096).select("block").distinct().count()
    assert met < blocks * (blocks + 1) / 4


def test_quantiles_of_a_hot_group_and_a_hot_value(spark):
    """One group holds most rows and one value a third of them; the ranges are cut between values."""
    draw = np.random.default_rng(13)
    values = [("hot", float(v)) for v in draw.integers(0, 3000, 6000)] + [("hot", 7.0)] * 3000
    values += [(f"g{i}", float(v)) for i in range(30) for v in draw.integers(0, 50, 5)]
    df = spark.createDataFrame(values, "k string, v double")
    found = {r["k"]: r for r in box_stats(df, ["k"], "v").collect()}
    for key in ("hot", "g0", "g29"):
        own = [v for k, v in values if k == key]
        low, middle, high = np.quantile(own, [0.25, 0.5, 0.75])
        assert tuple(found[key])[1:5] == (len(own), low, middle, high)
    counts = ranged(value_counts(df, ["k"], "v"), ["k"], 8)
    sizes = [r["count"] for r in counts.where("k = 'hot'").groupBy("_p").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 0.5 * sum(sizes)
    assert quantiles(value_counts(df.limit(0), ["k"], "v"), ["k"], {"m": 0.5}).count() == 0


def test_sparse_matrix_knows_absent_cells(spark, rows):
    cells = spark.createDataFrame([(1, 10, 0.5), (1, 20, 0.25), (2, 20, 1.0)], "r int, c int, v double")
    matrix = SparseMatrix.of(cells, "r", "c", "v", default=0.1)
    assert rows(matrix.frame(), "r", "c", "v") == [
        (None, 10, 0.1), (None, 20, 0.1), (1, None, 0.1), (1, 10, 0.5), (1, 20, 0.25), (2, None, 0.1), (2, 20, 1.0),
    ]
    assert rows(matrix.by_row()) == [(1, 2, 0, 0.375), (2, 1, 1, 0.55)]
    full = rows(matrix.dense(cells.select("r")), "r", "c", "v")
    assert full == [(1, 10, 0.5), (1, 20, 0.25), (2, 10, 0.1), (2, 20, 1.0)]
    assert full == rows(dense_grid(cells, cells.select("r"), cells.select("c"), {"v": 0.1}), "r", "c", "v")
    assert rows(matrix.dense(cells.select("r").where("r = 2"), cells.select("c").where("c = 10")), "r", "c", "v") == [(2, 10, 0.1)]
    wider = SparseMatrix(cells, "r", "c", "v", spark.range(1, 4).selectExpr("int(id) r"), spark.range(1, 5).selectExpr("int(id * 10) c"))
    assert rows(wider.by_row()) == [(1, 2, 2, 0.1875), (2, 1, 3, 0.25), (3, 0, 4, 0.0)]


def test_sparse_matrix_forms_no_combinations(spark):
    """A diagonal of 3,000 cells: the frame has the cells and the keys, not nine million rows."""
    cells = spark.range(3000).selectExpr("id AS r", "id AS c", "1.0D AS v")
    matrix = SparseMatrix.of(cells, "r", "c", "v")
    assert matrix.frame().count() == 9000
    plan = matrix.frame()._jdf.queryExecution().toString() + matrix.by_row()._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_pair_sums_split_by_a_column_add_up(spark):
    df = skewed(spark, 800).groupBy("race", "driver").agg(F.avg("v").alias("v")).withColumn("place", F.col("race") % 3)
    whole = {(r["a"], r["b"]): (r["together"], r["a_ahead"]) for r in pair_sums(df, "race", "driver", "v").collect()}
    split = pair_sums(df, "race", "driver", "v", by="place", block=12, chunk=20)
    found = split.groupBy("a", "b").agg(F.sum("together"), F.sum("a_ahead"), F.max("place")).collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in found} == whole
    assert max(r[4] for r in found) == 2


def test_best_pairs_shuffle_no_row_per_block(spark):
    """Rows are written once and read by block; the plan deals names of blocks only."""
    table = [(r, d, float((r * 5 + d * 11) % 13)) for r in range(20) for d in range(40)]
    df = spark.createDataFrame(table, "race bigint, driver bigint, v double")
    found = best_pairs(df, "race", "driver", "v", pair_scores, 3, block=5)
    assert "value" not in found._jdf.queryExecution().executedPlan().toString().split("MapInPandas")[-1]
    every = pair_sums(df, "race", "driver", "v").toPandas()
    every["key"] = pair_scores(every)
    best = found.toPandas().assign(key=lambda f: pair_scores(f)).sort_values(["key", "a", "b"]).head(3)
    assert best[["a", "b"]].to_numpy().tolist() == every.dropna(subset=["key"]).sort_values(["key", "a", "b"]).head(3)[["a", "b"]].to_numpy().tolist()


def test_no_row_of_a_pair_is_shuffled(spark):
    table = [(r, d, float((r * 7 + d * 3) % 11)) for r in range(30) for d in range(40) if (r + d) % 3]
    df = spark.createDataFrame([*table, (None, 3, 1.0), (None, 4, 3.0), (2, None, 1.0)], "race bigint, driver bigint, v double")
    found = pair_sums(df, "race", "driver", "v", block=5, chunk=7)
    above = found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert "Exchange" not in above and "Aggregate" not in above
    assert found.count() == found.select("a", "b").distinct().count() == 40 * 39 / 2
    few = pair_sums(df, "race", "driver", "v", sums=["sx", "distance"], block=5, chunk=7)
    assert few.columns == ["a", "b", "n", "sx", "sy", "distance"]
    assert few.exceptAll(found.select(few.columns)).isEmpty() and few.count() == found.count()
    assert found.where("a = 3 and b = 4").first()["n"] == 1 + sum((r + 3) % 3 > 0 and (r + 4) % 3 > 0 for r in range(30))


def test_best_pairs_by_some_sums_alone(spark):
    table = [(r, d, float((r * r * 7 + d * 13 + r * d) % 17)) for r in range(30) for d in range(60)]
    df = spark.createDataFrame(table, "race bigint, driver bigint, v double")
    some = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    every, found = (best_pairs(df, "race", "driver", "v", pair_scores, 3, sums=s, block=16).toPandas() for s in (SUMS, some))
    assert list(found.columns) == ["a", "b", *some]
    assert found.to_numpy().tolist() == every[found.columns].to_numpy().tolist()
