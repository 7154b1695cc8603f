"""Exact top-k search by inner product, columnar branch and bound.

Candidates lie in tiles in vertical layout: one row per dimension. A query
adds up its scores block of dimensions by block of dimensions. After each
block, the product of what is left of the lengths of query and candidate bounds
what a candidate can still gain; candidates that cannot reach the k-th best
lower bound are dropped and the others compacted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstats.llm.vectors import as_rows
from gridstats.shipping import ship
from gridstats.sources import keep

#: Queries and candidates of one tile, about, and dimensions of one block.
QUERIES, CANDIDATES, DIMENSIONS = 512, 2048, 16
#: Below this, sums of whole numbers are exact as doubles.
_EXACT = float(1 << 53)
#: The largest score; greater ones, and those below its negative, are given as these.
LONGEST = 2**63 - 1


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """``vec_id`` and ``units`` (``floor(scale * x)``, as doubles) of the usable vectors."""
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, usable = as_rows(batch.column("embedding"))
            units = [row.tobytes() for row in np.floor(scale * rows[usable])]
            ids = batch.column("vec_id").filter(pa.array(usable))
            yield pa.RecordBatch.from_arrays([ids, pa.array(units, pa.binary())], ["vec_id", "units"])

    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("bigint"), "embedding")
    return rows.mapInArrow(run, "vec_id bigint, units binary")


def matrix(units: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(units), width))
    for row, raw in zip(out, units, strict=True):
        values = np.frombuffer(raw, dtype=np.float64)
        row[: len(values)] = values
    return out


def search(query: np.ndarray, tile: np.ndarray, rest: np.ndarray, own: list[int], k: int):
    """The k best candidates of a tile and their scores, ties included.

    ``tile`` has a row per dimension; ``rest`` has, per block boundary, the
    candidates' lengths in the dimensions from there on. Those at ``own`` are left out.
    """
    width, count = tile.shape
    alive = np.delete(np.arange(count), own)
    score = np.zeros(len(alive))
    for number, start in enumerate(range(0, width, DIMENSIONS)):
        stop = min(start + DIMENSIONS, width)
        score = score + query[start:stop] @ tile[start:stop, alive]
        if stop == width or len(alive) <= k:
            continue
        reach = np.sqrt((query[stop:] ** 2).sum()) * rest[number + 1][alive]
        reach = reach * (1 + 1e-9) + 1e-6  # the bound itself is rounded
        floor = np.partition(score - reach, len(score) - k)[len(score) - k]
        stays = score + reach >= floor
        alive, score = alive[stays], score[stays]
    return alive, score


def exact_search(query: np.ndarray, tile: np.ndarray, own: list[int]):
    """As ``search`` without bounds, for numbers too large for exact doubles."""
    alive = np.delete(np.arange(tile.shape[1]), own)
    whole = [int(q) for q in query]
    score = [sum(q * int(v) for q, v in zip(whole, tile[:, c], strict=True)) for c in alive]
    return alive, np.array([min(max(s, -LONGEST), LONGEST) for s in score], dtype=object)


def _tile(k: int):
    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        if queries.empty or rows.empty:
            return empty
        width = max(map(len, [*queries["units"], *rows["units"]])) // 8
        if not width:
            width = 1
        asked, found = matrix(queries["units"], width), matrix(rows["units"], width)
        exact = np.abs(asked).max() * np.abs(found).max() * width < _EXACT
        order = np.argsort(-(found * found).sum(axis=0), kind="stable")  # the heaviest dimensions first
        asked, tile = asked[:, order], np.ascontiguousarray(found[:, order].T)
        squares = tile * tile
        rest = [np.sqrt(squares[start:].sum(axis=0)) for start in range(0, width, DIMENSIONS)]
        ids = rows["vec_id"].to_numpy()
        places: dict[int, list[int]] = {}
        for place, i in enumerate(ids.tolist()):
            places.setdefault(i, []).append(place)
        out = []
        for query_id, query in zip(queries["vec_id"].tolist(), asked, strict=True):
            own = places.get(query_id, [])
            if exact:
                alive, score = search(query, tile, rest, own, k)
            else:
                alive, score = exact_search(query, tile, own)
            hits = sorted(zip((-score).tolist(), ids[alive].tolist(), strict=True))
            best = [(int(-s), i) for s, i in hits[:k]]
            out += [(query_id, i, s) for s, i in best]
        if not out:
            return empty
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """The k highest integer inner products of each query among all other vectors.

    Components are ``floor(scale * x)``; ``is_query`` is a condition on
    ``vec_id``. Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``;
    equal scores go by the smaller id. Vectors that are null or hold null or
    non-finite components, and rows without id, take no part. Shorter vectors
    are padded with zeros. A repeated row is a candidate of its own, but not
    for the query of its id; queries that share an id are one, the smallest by
    bytes. A score beyond a long counts as the longest one of its sign.
    Queries and candidates meet tile by tile, candidates dealt over the tiles
    by their place in the written table, and a tile returns at most k rows per
    query.
    """
    rows = keep(quantised(vectors, scale))
    queries = keep(rows.where(is_query).groupBy("vec_id").agg(F.min("units").alias("units")))
    columns = max(1, -(-rows.count() // CANDIDATES))
    lines = max(1, -(-queries.count() // QUERIES))
    # A row's place does not change, as the table is written; rows that share an id come apart.
    column = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(columns)).cast("int")
    line = F.pmod(F.xxhash64("vec_id"), F.lit(lines)).cast("int")
    asked = queries.select(
        "vec_id", "units", line.alias("line"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column")
    )
    found = rows.select("vec_id", "units", column.alias("column"))
    found = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("line"))
    tiles = (
        asked.groupBy("line", "column")
        .cogroup(found.groupBy("line", "column"))
        .applyInPandas(_tile(k), "query_id bigint, vec_id bigint, score bigint")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        tiles.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
