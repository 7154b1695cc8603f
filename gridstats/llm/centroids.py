"""Centroid clustering with exact integers, by Shallot search.

Lloyd's rounds over rows that remember their nearest and second nearest
centroid, an upper bound of the distance to the first and a lower bound of the
distance to every other one. A row whose bounds still tell the two apart is
not looked at. For another row both remembered centroids are measured and the
search starts from the closer one: its neighbours are met in the order of
their distance to it, inside a ball of the distance to it plus the distance
of the second best found so far, so that the ball shrinks while the search
goes on. Bounds are doubles, widened by a margin; whatever they leave open is
compared in integers, so that results do not depend on rounding.

A round is one pass over a written table. Tasks return the rows with their new
bounds and one row of sums per cluster; only the centroids, ``k`` rows, come to
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from math import isqrt, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstats.shipping import ship
from gridstats.sources import keep

#: Components of this size or more count as not finite.
HUGE = 1e25
#: The largest long, which stands for distances and sums beyond it.
LONGEST = 2**63 - 1
#: Relative margin of the bounds, far above the error of the doubles.
MARGIN = 1e-9
#: Rows that are searched at once.
ROWS = 4096

STATE = "vec_id bigint, whole array<string>, narrow binary, near int, second int, upper double, lower double"
SUMS = "cluster int, at int, total string, members bigint"


def narrow_to(dim: int) -> int:
    """The largest component for which a squared distance surely fits a long."""
    return min(2**30, isqrt(2**60 // dim))


def whole_numbers(column: pa.ListArray, dim: int, scale: int) -> tuple[list[np.ndarray], np.ndarray]:
    """floor(scale * x) of every usable vector as integers, and which rows are usable.

    Usable are vectors of ``dim`` components, none of them null or non-finite.
    The integers of a row are 64-bit where all are narrow, else Python's own.
    """
    lengths = np.array([-1 if n is None else n for n in column.value_lengths().to_pylist()], int)
    usable = lengths == dim
    rows = column.filter(pa.array(usable))
    values = rows.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    finite = (np.isfinite(values) & (np.abs(np.nan_to_num(values)) < HUGE)).all(axis=1)
    usable[np.flatnonzero(usable)[~finite]] = False
    values = np.floor(values[finite] * scale)
    narrow = np.abs(values).max(axis=1, initial=0.0) <= narrow_to(dim)
    return [
        row.astype(np.int64) if small else np.array([int(v) for v in row], object)
        for row, small in zip(values, narrow, strict=True)
    ], usable


def squared(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centroid."""
    if rows.dtype != object and centroid.dtype == object:
        rows = rows.astype(object)
    gap = rows - centroid
    return (gap * gap).sum(axis=1)


def root(exact: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(exact.astype(float), 0.0))


def apart(p: np.ndarray, q: np.ndarray) -> float:
    """Distance of two centroids; the squares are added as integers."""
    return sqrt(sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)))


@dataclass
class Centroids:
    """Centroids with, for every one, the others by distance."""

    points: list[np.ndarray]

    def __post_init__(self):
        k = len(self.points)
        between = np.array([[apart(p, q) for q in self.points] for p in self.points]).reshape(k, k)
        self.order = [[int(j) for j in np.argsort(row, kind="stable") if j != i] for i, row in enumerate(between)]
        self.between = between
        others = between + np.diag(np.full(k, np.inf))
        # Half the distance to the nearest other centroid: a row closer than that stays.
        self.half = others.min(axis=1, initial=np.inf) / 2

    def moved_from(self, before: Centroids) -> np.ndarray:
        moves = [apart(p, q) for p, q in zip(self.points, before.points, strict=True)]
        return np.array(moves) * (1 + MARGIN)


def searched(rows: np.ndarray, start: np.ndarray, first: np.ndarray, centroids: Centroids, held: tuple):
    """Nearest and second nearest centroid of rows, scanned from ``start``.

    ``first`` holds the squared distances to the start; ``held`` the other
    remembered centroids and their squared distances (-1: none). Returns the
    nearest, its squared distance, the second nearest and its squared distance;
    a tie goes to the smaller number.
    """
    best, best_sq = start.copy(), first.copy()
    second, second_sq = held[0].copy(), held[1].copy()
    swap = (second >= 0) & ((second_sq < best_sq) | ((second_sq == best_sq) & (second < best)))
    best[swap], second[swap] = second[swap], best[swap].copy()
    best_sq[swap], second_sq[swap] = second_sq[swap], best_sq[swap].copy()
    own = root(first) * (1 + MARGIN)
    for centre in np.unique(start):
        active = np.flatnonzero(start == centre)
        for other in centroids.order[centre]:
            # The ball: no centroid beyond it can be nearer than the second best so far.
            reach = np.where(second[active] >= 0, root(second_sq[active]) * (1 + MARGIN), np.inf)
            active = active[centroids.between[centre, other] * (1 - MARGIN) <= own[active] + reach]
            if not len(active):
                break
            todo = active[(best[active] != other) & (second[active] != other)]
            if not len(todo):
                continue
            found = squared(rows[todo], centroids.points[other])
            nearer = (found < best_sq[todo]) | ((found == best_sq[todo]) & (other < best[todo]))
            up = todo[nearer]
            second[up], second_sq[up] = best[up], best_sq[up]
            best[up], best_sq[up] = other, found[nearer]
            rest, found = todo[~nearer], found[~nearer]
            closer = (second[rest] < 0) | (found < second_sq[rest])
            second[rest[closer]], second_sq[rest[closer]] = other, found[closer]
    return best, best_sq, second, second_sq


def assigned(rows: np.ndarray, near, second, upper, lower, centroids: Centroids):
    """One round for a block of rows: their new nearest, second nearest and bounds."""
    near, second, upper, lower = near.copy(), second.copy(), upper.copy(), lower.copy()
    if any(p.dtype == object for p in centroids.points):
        rows = rows.astype(object)
    open_ = np.flatnonzero(upper >= np.maximum(lower, centroids.half[near] * (1 - MARGIN)))
    if len(open_):
        # Tighten the upper bound first; many rows are settled by that.
        exact = np.empty(len(open_), rows.dtype if rows.dtype == object else np.int64)
        for c in np.unique(near[open_]):
            mine = near[open_] == c
            exact[mine] = squared(rows[open_[mine]], centroids.points[c])
        upper[open_] = root(exact) * (1 + MARGIN)
        left = upper[open_] >= np.maximum(lower[open_], centroids.half[near[open_]] * (1 - MARGIN))
        open_, exact = open_[left], exact[left]
    if len(open_):
        a, b = near[open_], second[open_]
        to_b = np.full_like(exact, -1)
        for c in np.unique(b[b >= 0]):
            mine = b == c
            to_b[mine] = squared(rows[open_[mine]], centroids.points[c])
        flip = (b >= 0) & (to_b < exact)
        start, first = np.where(flip, b, a), np.where(flip, to_b, exact)
        held = np.where(flip, a, b), np.where(flip, exact, to_b)
        best, best_sq, next_, next_sq = searched(rows[open_], start, first, centroids, held)
        near[open_], second[open_] = best, next_
        upper[open_] = root(best_sq) * (1 + MARGIN)
        lower[open_] = np.where(next_ >= 0, root(next_sq) * (1 - MARGIN), np.inf)
    return near, second, upper, lower


def _rows_of(batch: pa.RecordBatch, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and rows of a batch in blocks: those of 64-bit integers, and those of Python's integers."""
    narrow = batch.column("narrow")
    plain = narrow.is_valid().to_numpy(zero_copy_only=False)
    blocks = []
    places = np.flatnonzero(plain)
    for start in range(0, len(places), ROWS):
        at = places[start : start + ROWS]
        data = b"".join(narrow.take(pa.array(at)).to_pylist())
        blocks.append((at, np.frombuffer(data, np.int32).reshape(-1, dim).astype(np.int64)))
    places = np.flatnonzero(~plain)
    for start in range(0, len(places), ROWS):
        at = places[start : start + ROWS]
        texts = batch.column("whole").take(pa.array(at)).to_pylist()
        blocks.append((at, np.array([[int(v) for v in t] for t in texts], object).reshape(-1, dim)))
    return blocks


def _prepared(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, usable = whole_numbers(batch.column("embedding"), dim, scale)
            n = len(rows)
            columns = [
                batch.column("vec_id").filter(pa.array(usable)),
                pa.array([[str(v) for v in r] if r.dtype == object else None for r in rows], pa.list_(pa.string())),
                pa.array([None if r.dtype == object else r.astype(np.int32).tobytes() for r in rows], pa.binary()),
                pa.array(np.zeros(n, np.int32)),
                pa.array(np.full(n, -1, np.int32)),
                pa.array(np.full(n, np.inf)),
                pa.array(np.zeros(n)),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, ["vec_id", "whole", "narrow", "near", "second", "upper", "lower"]
            )

    return vectors.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(run, STATE)


def _point(row, dim: int) -> np.ndarray:
    if row["narrow"] is not None:
        return np.frombuffer(bytes(row["narrow"]), np.int32).astype(np.int64)
    return np.array([int(v) for v in row["whole"]], object)


def _round(state: DataFrame, dim: int, centroids: Centroids, moved: np.ndarray | None) -> DataFrame:
    """Rows with new bounds, and rows with the sums of each cluster of a task (``cluster`` is set in those)."""
    names = [f.split()[0] for f in f"{STATE}, {SUMS}".replace("array<string>", "a").split(", ")]
    types = [pa.int64(), pa.list_(pa.string()), pa.binary(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
    types += [pa.int32(), pa.int32(), pa.string(), pa.int64()]
    k = len(centroids.points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(dim, object) for _ in range(k)]
        members = np.zeros(k, np.int64)
        for batch in batches:
            near, second = (batch.column(c).to_numpy().astype(int) for c in ("near", "second"))
            upper, lower = (batch.column(c).to_numpy().copy() for c in ("upper", "lower"))
            if moved is not None:
                # The lower bound covers all but the nearest: it gives way by the largest move of those.
                upper += moved[near]
                largest = np.array([np.delete(moved, c).max(initial=0.0) for c in range(k)])
                lower = np.maximum(lower - largest[near], 0.0)
            for at, rows in _rows_of(batch, dim):
                found = assigned(rows, near[at], second[at], upper[at], lower[at], centroids)
                near[at], second[at], upper[at], lower[at] = found
                for c in np.unique(near[at]):
                    mine = rows[near[at] == c]
                    totals[c] = totals[c] + mine.sum(axis=0).astype(object)
                    members[c] += len(mine)
            columns = [batch.column(c) for c in ("vec_id", "whole", "narrow")]
            columns += [pa.array(near.astype(np.int32)), pa.array(second.astype(np.int32)), pa.array(upper), pa.array(lower)]
            columns += [pa.nulls(len(batch), t) for t in types[7:]]
            yield pa.RecordBatch.from_arrays(columns, names)
        some = [(c, at, str(totals[c][at]), int(members[c])) for c in range(k) if members[c] for at in range(dim)]
        columns = [pa.nulls(len(some), t) for t in types[:7]]
        columns += [pa.array([s[i] for s in some], types[7 + i]) for i in range(4)]
        yield pa.RecordBatch.from_arrays(columns, names)

    return state.mapInArrow(run, f"{STATE}, {SUMS}")


def _updated(after: DataFrame, centroids: Centroids) -> Centroids:
    """Centroids as exact floor(sum / count); those without rows stay. At most ``k`` rows a component come here."""
    sums = after.where("cluster is not null").groupBy("cluster", "at").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"), F.sum("members").alias("n")
    )
    points = [[int(v) for v in p] for p in centroids.points]
    for row in sums.collect():
        points[row["cluster"]][row["at"]] = int(row["total"]) // row["n"]
    return Centroids([_narrowed(p) for p in points])


def _narrowed(point: list[int]) -> np.ndarray:
    small = all(abs(v) <= narrow_to(len(point)) for v in point)
    return np.array(point, np.int64 if small else object)


def first_centroids(state: DataFrame, k: int, seed: int, dim: int) -> Centroids:
    """The ``k`` rows with the smallest sha256 of ``seed:vec_id``, in that order.

    Rows without id are no starting points. Rows that share an id come in the
    order of their packed components.
    """
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("vec_id").cast("string")), 256)
    rows = (
        state.where("vec_id is not null")
        .select(digest.alias("digest"), "whole", "narrow")
        .orderBy("digest", F.hex("narrow"), F.array_join("whole", ","))
        .limit(k)
        .collect()
    )
    return Centroids([_point(r, dim) for r in rows])


def clustered(
    vectors: DataFrame, *, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3
) -> DataFrame:
    """Clusters of the vectors of ``dim`` components after ``rounds`` rounds and a last assignment.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are not read.
    Every component x becomes floor(scale * x). Returns per kept row: ``vec_id``,
    ``cluster``, ``distance`` (squared, to its final centroid), ``cluster_inertia``
    and ``inertia`` (the distances' sums) and ``centroid_sha256``.

    Vectors that are null, of another length, or hold null or non-finite
    components (or one of 1e25 or more) are left out. Equal distances go to the
    smaller cluster number. Repeated rows count as often as they occur. With
    fewer rows than ``k`` there are fewer clusters, with none (or none with an
    id to start from) there is no row. Distances and sums beyond a long are
    given as the largest long.
    """
    ship(vectors.sparkSession)
    state = keep(_prepared(vectors, dim, scale))
    centroids, moved = first_centroids(state, k, seed, dim), None
    empty = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not centroids.points:
        return vectors.sparkSession.createDataFrame([], empty)
    for _ in range(rounds):
        after = keep(_round(state, dim, centroids, moved))
        before, centroids = centroids, _updated(after, centroids)
        moved = centroids.moved_from(before)
        state = after.where("cluster is null").drop("cluster", "at", "total", "members")
    last = keep(_measured(_round(state, dim, centroids, moved).where("cluster is null"), dim, centroids))

    wide = F.col("exact").cast("decimal(38,0)")
    own = last.groupBy("cluster").agg(F.sum(wide).alias("own"))
    everything = last.agg(F.sum(wide).alias("all")).scalar()
    digests = _digests(centroids)
    digest = F.element_at(F.array(*[F.lit(d) for d in digests]), F.col("cluster") + 1)
    return last.join(F.broadcast(own), "cluster").select(  # at most k rows
        "vec_id",
        "cluster",
        _long(wide).alias("distance"),
        _long(F.col("own")).alias("cluster_inertia"),
        _long(everything).alias("inertia"),
        digest.alias("centroid_sha256"),
    )


def _long(value):
    return F.least(value, F.lit(LONGEST).cast("decimal(38,0)")).cast("bigint")


def _digests(centroids: Centroids) -> list[str]:
    return [sha256(",".join(str(int(v)) for v in p).encode()).hexdigest() for p in centroids.points]


def _measured(state: DataFrame, dim: int, centroids: Centroids) -> DataFrame:
    """Exact squared distance of every row to its cluster's centroid, as decimal digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("near").to_numpy()
            exact = np.empty(len(batch), object)
            for at, rows in _rows_of(batch, dim):
                for c in np.unique(near[at]):
                    mine = near[at] == c
                    found = squared(rows[mine], centroids.points[c])
                    exact[at[mine]] = [min(int(v), LONGEST) for v in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("near"), pa.array([str(v) for v in exact], pa.string())],
                ["vec_id", "cluster", "exact"],
            )

    return state.mapInArrow(run, "vec_id bigint, cluster int, exact string")
