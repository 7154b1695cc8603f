"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstats.sources import keep


def _state(links: DataFrame) -> tuple:
    return tuple(
        links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first()
    )


def components(links: DataFrame) -> DataFrame:
    """Smallest id reachable from each linked id.

    ``links`` has ``a`` and ``b`` (bigint); loops and repeated links do no
    harm, links with a null end are left out. Returns ``id`` and ``component``
    for ids with a link to another one. Per round every id joins the smallest
    neighbour of its neighbours: minima are aggregated before the shuffle and
    joined back, so that a hub's links are spread. Rounds grow with the
    logarithm of the longest chain; each ends in a written table.
    """
    now = keep(
        links.where("a != b")
        .select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
        .distinct()
    )
    state = _state(now)
    while True:
        both = now.unionAll(now.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = with_least(both)
        large = (
            both.join(least, both["high"] == least["node"])
            .where(F.col("low") > F.col("high"))
            .select(F.col("low").alias("high"), F.col("least").alias("low"))
            .distinct()
        )
        large = keep(large)
        below = large.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
        small = (
            large.join(below, large["high"] == below["node"])
            .where(F.col("low") != F.col("least"))
            .select(F.col("low").alias("high"), F.col("least").alias("low"))
            .unionAll(below.select(F.col("node").alias("high"), F.col("least").alias("low")))
            .distinct()
        )
        now = keep(small)
        before, state = state, _state(now)
        if state == before:
            break
    # Every id but the roots has one link now, to its root.
    roots = now.select(F.col("low").alias("id"), F.col("low").alias("component")).distinct()
    return keep(now.select(F.col("high").alias("id"), F.col("low").alias("component")).unionAll(roots))


def with_least(both: DataFrame) -> DataFrame:
    """Per id, the smallest of itself and its neighbours."""
    return both.groupBy(F.col("high").alias("node")).agg(
        F.least(F.first("high"), F.min("low")).alias("least")
    )
