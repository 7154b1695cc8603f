"""Pack token pieces into sequences of fixed capacity by bin completion.

A bin is built around the largest piece left: the fillings of its room are
enumerated, larger pieces first, until one without waste is found. A filling is
not tried if one tried before it dominates it (has one piece in place of several
smaller ones that fit in it). Best fit gives the first incumbent. Over whole bins the search is branch and bound: if the waste
of the bins closed so far exceeds what a better solution than the incumbent
may waste, the last bins are opened again and their next fillings tried.

Pieces are dealt to buckets by hash, equal ones in turn, and packed there; the emptiest sequences of
every bucket are opened and packed again together, up a reduction tree.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstats.llm.encoders import spaced_ids
from gridstats.shipping import ship, small_batches
from gridstats.sources import keep

#: Pieces that one task packs together, about.
BUCKET = 8192
#: Buckets that meet in one bucket of the next level, and open sequences that each may send there.
FAN_IN, SENT = 256, 16
#: Search steps per bin for a filling, and bins that may be opened again per bucket.
FILL_STEPS, REOPENED = 400, 2000
#: Search steps to show that a filling is dominated; one that is not shown to be stays.
SHOWN_STEPS = 200
_PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PACKED = f"{_PIECE}, bucket bigint, sequence_id bigint, offset bigint, open boolean"


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = True
) -> DataFrame:
    """Token pieces of every whole text, with ``end_id`` after its ids.

    Only a document of more than ``capacity`` ids is cut: into pieces of
    ``capacity``, the first of which holds what is left over. A null text is
    empty: one piece with the end id. Returns ``doc_id``, ``piece``, ``start``,
    ``length``, ``ids_crc32`` and, unless ``with_ids`` is off, ``ids``
    (little-endian unsigned 32-bit).
    """
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = spaced_ids(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            row, number, starts, lengths, sums, ids = [], [], [], [], [], []
            texts = batch.column("text").to_pylist()
            for at, coded in enumerate(encoder.encode(texts)):
                coded += end
                total = len(coded) // 4
                head = total % capacity or min(total, capacity)
                for k, start in enumerate([0, *range(head, total, capacity)]):
                    stop = head if k == 0 else start + capacity
                    row.append(at)
                    number.append(k)
                    starts.append(start)
                    part = coded[4 * start : 4 * stop]
                    lengths.append(stop - start)
                    sums.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = [
                batch.column("doc_id").take(pa.array(row, pa.int64())),
                pa.array(number, pa.int32()),
                pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array(sums, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"{_PIECE}, ids binary" if with_ids else _PIECE
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, schema)


def best_filling(sizes: list[int], counts: dict[int, int], room: int) -> list[list[int]]:
    """Fillings of a room, the least waste first; ``sizes`` has those left, ascending.

    All that are found within FILL_STEPS steps, up to one without waste; best
    fit (the largest that fits, again and again) is among them.
    """
    found: list[tuple[int, list[int]]] = []
    steps = 0

    def fill(room: int, top: int, chosen: list[int]) -> bool:
        nonlocal steps
        at = bisect_right(sizes, min(room, top))
        closed = True
        while at > 0:
            at -= 1
            size = sizes[at]
            if counts[size] <= chosen.count(size):
                continue
            closed = False
            steps += 1
            if size == room:
                found.append((0, [*chosen, size]))
                return True
            if fill(room - size, size, [*chosen, size]):
                return True
            if steps > FILL_STEPS:
                return False
        if closed:
            found.append((room, chosen))
        return False

    fill(room, room, [])
    found.sort(key=lambda x: (x[0], len(x[1])))
    return [chosen for _, chosen in found] or [[]]


def dominates(one: list[int], two: list[int]) -> bool:
    """Whether all pieces of ``two`` fit in pieces of ``one``, several in one too; both descend."""
    if sum(one) < sum(two) or len(two) > SHOWN_STEPS:
        return False
    rooms, steps = list(one), 0

    def fits(k: int) -> bool:
        nonlocal steps
        if k == len(two):
            return True
        for room in sorted({r for r in rooms if r >= two[k]}):
            steps += 1
            if steps > SHOWN_STEPS:
                return False
            i = rooms.index(room)
            rooms[i] -= two[k]
            if fits(k + 1):
                return True
            rooms[i] += two[k]
        return False

    return fits(0)


def bin_completion(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of positions in ``lengths``; every length is in 1..capacity."""
    at: dict[int, list[int]] = {}
    for position, length in enumerate(lengths):
        at.setdefault(length, []).append(position)
    least = -(-sum(lengths) // capacity)
    best: list[list[int]] | None = None
    counts = {size: len(where) for size, where in at.items()}
    sizes = sorted(counts)
    # Bins tried, the last of them taken; bins not tried; waste so far.
    path: list[tuple[list[list[int]], list[list[int]], int]] = []
    waste, reopened = 0, 0

    def take(bin_sizes: list[int], sign: int) -> None:
        for size in bin_sizes:
            if sign < 0 and counts[size] == 1:
                sizes.pop(bisect_right(sizes, size) - 1)
            elif sign > 0 and counts[size] == 0:
                sizes.insert(bisect_right(sizes, size), size)
            counts[size] += sign

    while True:
        before: list[list[int]] = []
        allowed = None if best is None else (len(best) - 1) * capacity - sum(lengths)
        if sizes and (allowed is None or waste <= allowed):
            largest = sizes[-1]
            take([largest], -1)
            fillings = best_filling(sizes, counts, capacity - largest)
            take([largest], 1)
            tried = [[largest, *f] for f in fillings]
        elif not sizes and (best is None or len(path) < len(best)):
            best = [b[-1] for b, _, _ in path]
            if len(best) == least:
                break
            tried = []
        else:
            tried = []
        while not tried and path and reopened < REOPENED:  # open bins until one has another filling
            before, tried, waste = path.pop()
            take(before[-1], 1)
            reopened += 1
            while tried and any(dominates(b[1:], tried[0][1:]) for b in before):
                tried = tried[1:]
        if not tried or (best is not None and reopened >= REOPENED):
            break
        first, *others = tried
        path.append(([*before, first], others, waste))
        take(first, -1)
        waste += capacity - sum(first)
    return [[at[size].pop() for size in one] for one in best]


def _pack(capacity: int, level: int):
    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        order = ["draw", "doc_id", "piece", "ids_crc32"]
        rows = rows.take(np.repeat(np.arange(len(rows)), rows.column("times").to_numpy()))
        rows = rows.sort_by([(name, "ascending") for name in order]).drop_columns(["draw", "times"])
        lengths, bucket = rows.column("length").to_pylist(), key[0].as_py()
        whole = [i for i, n in enumerate(lengths) if n == capacity]
        parts = [i for i, n in enumerate(lengths) if n != capacity]
        packed = bin_completion([lengths[i] for i in parts], capacity) if parts else []
        bins = [[i] for i in whole] + [[parts[i] for i in one] for one in packed]
        used = [sum(lengths[i] for i in one) for one in bins]
        emptiest = sorted((n, k) for k, n in enumerate(used) if n < capacity)[:SENT]
        sent = {k for _, k in emptiest}
        n_rows = len(lengths)
        sequence, offset, is_open = [0] * n_rows, [0] * n_rows, [False] * n_rows
        for k, one in enumerate(bins):
            place = 0
            for i in one:
                sequence[i] = (level << 58) | (bucket << 24) | k
                offset[i], is_open[i] = place, k in sent
                place += lengths[i]
        return (
            rows.append_column("sequence_id", pa.array(sequence, pa.int64()))
            .append_column("offset", pa.array(offset, pa.int64()))
            .append_column("open", pa.array(is_open, pa.bool_()))
        )

    return pack


def pack(piece_rows: DataFrame, capacity: int = 1024) -> DataFrame:
    """Sequences for pieces with ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    Adds ``sequence_id`` and ``offset``: pieces of a sequence lie one after the
    other from 0 and take at most ``capacity`` tokens together. Every row stays,
    repeated ones too; a null ``doc_id`` is kept. An empty table gives none.
    """
    ship(piece_rows.sparkSession)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = keep(piece_rows.select(columns))
    width = max(1, -(-rows.count() // BUCKET))
    spread = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "piece", "ids_crc32")
    # Equal rows cannot be told apart: they are counted, and dealt over the buckets a few at a time.
    few = max(1, BUCKET // 32)
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))
    dealt = counted.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / few))).alias("turn"))
    rows = dealt.select(
        *columns,
        F.least(F.lit(few), F.col("rows") - few * F.col("turn")).alias("times"),
        F.pmod(F.pmod(spread, F.lit(width)) + F.col("turn"), F.lit(width)).alias("bucket"),
    )
    done, level = None, 0
    while True:
        drawn = rows.select(*columns, "times", "bucket", spread.alias("draw"))
        out = keep(drawn.groupBy("bucket").applyInArrow(_pack(capacity, level), _PACKED))
        last = width == 1
        closed = out if last else out.where(~F.col("open"))
        closed = closed.select(*columns, "sequence_id", "offset")
        done = closed if done is None else done.unionAll(closed)
        if last:
            return done
        width, level = -(-width // FAN_IN), level + 1
        rows = out.where("open").select(
            *columns, F.lit(1).cast("bigint").alias("times"), F.pmod("bucket", F.lit(width)).alias("bucket")
        )


def packed(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2
) -> DataFrame:
    """``pack`` over the ``pieces`` of documents."""
    return pack(pieces(docs, tokenizer, capacity, end_id, with_ids=False), capacity)
