"""Near-duplicate vectors by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard
transform; its hash is the nearest of the 2 d signed unit vectors. HASHES of
them make a table's bucket, and there are TABLES tables. A vector also probes
the PROBES buckets that it missed by the least. Pairs that meet in a bucket,
not both as probes, are verified by their cosine in double precision.

A bucket is cut into blocks of bounded size, and a task compares two blocks as
matrices. It returns no pairs, but for every vector the number of its links
and one link into its group, so the output grows with the vectors. A pair
counts in the first table where it meets only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstats.llm.components import components
from gridstats.shipping import ship
from gridstats.sources import keep

TABLES, HASHES, PROBES = 10, 2, 2
#: Rows of a bucket that one block holds, about.
BLOCK = 1024
#: Linked pairs of two blocks whose codes are compared at once.
PAIRS = 1 << 16


def as_rows(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, padded with zeros, and which are usable.

    Null vectors and those with null or non-finite components are not usable.
    """
    lengths = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], int)
    width = max([1, *lengths.tolist()])
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    rows = np.zeros((len(column), width))
    inside = np.arange(width) < lengths[:, None]
    rows[inside] = values
    usable = column.is_valid().to_numpy(zero_copy_only=False) & np.isfinite(rows).all(axis=1)
    rows[~usable] = 0.0
    return rows, usable


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = rows.shape
    half = 1
    while half < width:
        cut = rows.reshape(n, width // (2 * half), 2, half)
        rows = np.stack([cut[:, :, 0] + cut[:, :, 1], cut[:, :, 0] - cut[:, :, 1]], axis=2)
        rows = rows.reshape(n, width)
        half *= 2
    return rows / np.sqrt(width)


def codes(units: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Per row and table its bucket, then the buckets it probes: (rows, TABLES, 1 + PROBES)."""
    width = max(2, 1 << (dim - 1).bit_length())
    padded = np.zeros((len(units), width))
    padded[:, : units.shape[1]] = units
    rows = np.arange(len(units))
    out = np.empty((len(units), TABLES, 1 + PROBES), dtype=np.int64)
    for table in range(TABLES):
        best, second, margin = [], [], []
        for k in range(HASHES):
            signs = np.random.default_rng([seed, table, k]).choice([-1.0, 1.0], size=(3, width))
            turned = padded
            for s in signs:
                turned = hadamard(turned * s)
            size = np.abs(turned)
            first = size.argmax(axis=1)
            top = size[rows, first]
            size[rows, first] = -1.0
            next_ = size.argmax(axis=1)
            best.append(2 * first + (turned[rows, first] < 0))
            second.append(2 * next_ + (turned[rows, next_] < 0))
            margin.append(top - size[rows, next_])
        base = sum(b * (2 * width) ** k for k, b in enumerate(best))
        # A probe takes the second nearest vertex in one hash, where that misses by the least.
        order = np.argsort(np.stack(margin), axis=0, kind="stable")
        steps = np.stack([(s - b) * (2 * width) ** k for k, (b, s) in enumerate(zip(best, second, strict=True))])
        out[:, table, 0] = base
        for p in range(PROBES):
            out[:, table, 1 + p] = base + steps[order[p], rows]
    return out


def hashed(vectors: DataFrame, seed: int) -> DataFrame:
    """Usable vectors with ``vec_id``, ``same``, ``unit`` (doubles of length 1) and ``codes``."""
    ship(vectors.sparkSession)
    dim = vectors.agg(F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()[0]
    dim = max(1, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows, usable = as_rows(batch.column("embedding"))
            largest = np.abs(rows).max(axis=1, initial=0.0)
            usable &= largest > 0
            rows = rows[usable] / largest[usable][:, None]  # so that no square overflows
            units = rows / np.sqrt((rows * rows).sum(axis=1))[:, None] + 0.0
            if units.shape[1] < dim:
                units = np.pad(units, ((0, 0), (0, dim - units.shape[1])))
            found = codes(units, dim, seed)
            columns = [
                batch.column("vec_id").filter(pa.array(usable)),
                pa.array([xxhash.xxh3_128_digest(u.tobytes()) for u in units], pa.binary()),
                pa.array([u.tobytes() for u in units], pa.binary()),
                pa.array([c.tobytes() for c in found], pa.binary()),
                pa.array(found.reshape(len(found), -1).tolist(), pa.list_(pa.int64())),
            ]
            names = ["vec_id", "same", "unit", "packed", "codes"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("bigint"), "embedding")
    return rows.mapInArrow(
        run, "vec_id bigint, same binary, unit binary, packed binary, codes array<bigint>"
    )


def group_labels(linked: np.ndarray) -> np.ndarray:
    """Per row of a symmetric link matrix, the smallest row reachable."""
    labels = np.arange(len(linked))
    while True:
        low = labels.copy()
        for start in range(0, len(labels), 256):  # rows at a time: the matrix of labels is eight times the links'
            some = np.where(linked[start : start + 256], labels, len(labels)).min(axis=1, initial=len(labels))
            low[start : start + 256] = np.minimum(low[start : start + 256], some)
        low = low[low]
        if (low == labels).all():
            return labels
        labels = low


def compare(rows: pd.DataFrame, threshold: float) -> pd.DataFrame | None:
    """Links of one block pair: per vector their number, and the root of its group here."""
    low, high, table = rows["low"].iloc[0], rows["high"].iloc[0], int(rows["tab"].iloc[0])
    bucket = rows["code"].iloc[0]
    ids, block = rows["id"].to_numpy(), rows["block"].to_numpy()
    primary = rows["primary"].to_numpy()
    units = np.frombuffer(b"".join(rows["unit"]), dtype=np.float64).reshape(len(rows), -1)
    cosine = units @ units.T
    linked = cosine >= threshold
    linked &= primary[:, None] | primary[None, :]
    linked &= ids[:, None] != ids[None, :]
    if low != high:
        linked &= block[:, None] != block[None, :]
    del cosine
    i, j = (found.astype(np.int32) for found in np.nonzero(np.triu(linked, 1)))
    if not len(i):
        return None
    every = np.frombuffer(b"".join(rows["packed"]), dtype=np.int64).reshape(len(rows), TABLES, -1)
    weight = rows["copies"].to_numpy()
    links = np.zeros(len(rows), dtype=np.int64)
    linked[:] = False
    for start in range(0, len(i), PAIRS):
        some_i, some_j = i[start : start + PAIRS], j[start : start + PAIRS]
        # The first table where the two meet, and there the bucket of the smaller id if it will do.
        a = np.where(ids[some_i] < ids[some_j], some_i, some_j)
        b = some_i + some_j - a
        of_a, of_b = every[a], every[b]
        a_in_b = (of_a[:, :, :1] == of_b).any(axis=2)  # b goes to a's own bucket
        b_in_a = (of_b[:, :, :1] == of_a).any(axis=2)
        first = (a_in_b | b_in_a).argmax(axis=1)
        at = np.arange(len(a))
        place = np.where(a_in_b[at, first], of_a[at, first, 0], of_b[at, first, 0])
        mine = (first == table) & (place == bucket)
        a, b = a[mine], b[mine]
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        linked[a, b] = linked[b, a] = True
    if not links.any():
        return None
    root = group_labels(linked)
    some = links > 0
    return pd.DataFrame({"id": ids[some], "links": links[some], "root": ids[root[some]]})


def _search(threshold: float):
    keys = ["tab", "code", "low", "high"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if rows.empty:
                continue
            marks = rows[keys].to_numpy()
            starts = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]).any(axis=1)])
            for start, stop in zip(starts, starts[1:], strict=False):
                if stop - start > 1:
                    found = compare(rows.iloc[start:stop], threshold)
                    if found is not None:
                        yield found
            rest = rows.iloc[starts[-1] :].reset_index(drop=True)
        if rest is not None and len(rest) > 1:
            found = compare(rest, threshold)
            if found is not None:
                yield found

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, seed: int = 11) -> DataFrame:
    """Vectors linked by a cosine of ``threshold`` or more.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are not read.
    Returns a row per row: ``vec_id``, ``n_links`` (other rows linked directly),
    ``component_id`` (smallest id reachable) and ``kept``. Vectors that are
    null, zero, or hold null or non-finite components link with nothing, and
    neither do rows without id, whose component is null and which are kept.
    Shorter vectors are padded with zeros. Equal vectors count as links and
    are compared as one. Rows that share an id have the links of all of them.
    """
    rows = keep(hashed(vectors, seed))
    nodes = keep(
        rows.groupBy("same").agg(
            F.min("vec_id").alias("id"),
            F.count(F.lit(1)).alias("copies"),
            F.first("unit").alias("unit"),
            F.first("packed").alias("packed"),
            F.first("codes").alias("codes"),
        )
    )
    width = 1 + PROBES
    places = nodes.select("id", F.posexplode("codes").alias("at", "code")).select(
        "id",
        F.expr(f"at div {width}").cast("int").alias("tab"),
        "code",
        (F.col("at") % width == 0).alias("primary"),
    )
    buckets = (
        places.groupBy("tab", "code")
        .agg(F.count(F.lit(1)).alias("size"), F.count_if("primary").alias("own"))
        .where("size > 1 and own > 0")
        .select("tab", "code", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    )
    placed = places.join(buckets, ["tab", "code"]).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    )
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = placed.select(
        "id",
        "tab",
        "code",
        "primary",
        "block",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
    ).join(nodes.drop("codes", "same"), "id")
    keys = ["tab", "code", "low", "high"]
    ordered = units.repartition(*keys).sortWithinPartitions(*keys)
    found = keep(ordered.mapInPandas(_search(threshold), "id bigint, links bigint, root bigint"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    own = nodes.select("same", F.col("id").alias("node"), "copies")
    members = rows.select("vec_id", "same").join(own, "same")
    ties = members.where("vec_id != node").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    edges = found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    parts = components(edges.unionAll(ties))
    counted = members.join(links, F.col("node") == F.col("id"), "left").select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n")
    )
    counted = counted.groupBy("vec_id").agg(F.max("n").alias("n_links"))
    everyone = vectors.select(F.col("vec_id").cast("bigint"))
    joined = everyone.join(counted, "vec_id", "left").join(
        parts.withColumnRenamed("id", "vec_id"), "vec_id", "left"
    )
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
