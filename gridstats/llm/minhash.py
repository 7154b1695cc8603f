"""Near-duplicate texts by HyperMinHash.

A text's set of word shingles is hashed; the upper bits of a hash choose one of
REGISTERS buckets, and a bucket keeps its smallest hash as a floating number:
the count of leading zeros and MANTISSA bits after the leading one, 16 bits in
all. Four registers make a band, packed into one 64-bit number, and texts that
agree in a band are candidates. The share of equal registers, corrected for
registers that are equal by chance, estimates the Jaccard similarity; pairs
whose estimate is not far below the threshold are verified on the full sets.

Texts with the same words are one node. Within a band's bucket, every member
is verified against the smallest and the largest id of the bucket, which joins
groups of any size with work in proportion to their members. Only where
members of a bucket are still in different components afterwards are the
pairs between components compared, register by register in blocks. The texts
that may reach the threshold meet their family, block by block, and are
verified there, the likeliest pairs first, unless their components are linked
already. So no link is lost that could join two components, and no group is
expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstats.llm import caches
from gridstats.llm.components import components
from gridstats.llm.names import fresh
from gridstats.shipping import ship, small_batches
from gridstats.sources import keep

SHINGLE = 5
REGISTERS, MANTISSA, ROWS = 128, 10, 4
BANDS = REGISTERS // ROWS
#: An estimate this far below the threshold (four standard errors) still leads to verification.
MARGIN = 0.16
#: Members of a bucket, and texts of a family, that one block holds, about.
BLOCK, FAMILY = 1024, 512
#: Pairs whose registers are compared at once.
PAIRS = 1 << 15
#: Classes of ids by which texts are filtered before they are shuffled: the broadcast rows are no more.
MARKS = 1 << 20
#: Word hashes that a worker remembers, until its task ends.
_WORDS = 200_000
_words: dict[bytes, int] = {}
caches.held("words", _words.clear)
_EMPTY = np.uint16(0)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, remembered per worker process."""
    import xxhash

    if len(_words) > _WORDS:
        _words.clear()
    try:
        return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    except KeyError:
        for word in words:
            if word not in _words:
                _words[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words make one shingle."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = word_hashes(words)
    count = max(1, len(words) - width + 1)
    total = np.full(count, min(len(words), width), dtype=np.uint64)
    for k in range(min(len(words), width)):
        total = mixed_bits(total + hashes[k : k + count])
    return np.unique(total)


def registers(sorted_hashes: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of a set; 0 marks an empty one."""
    shift = np.uint64(64 - (REGISTERS - 1).bit_length())
    bucket = (sorted_hashes >> shift).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    low = sorted_hashes[first] & ((np.uint64(1) << shift) - np.uint64(1))
    # 52 bits are exact as a floating number, whose exponent tells the leading zeros.
    fraction, exponent = np.frexp((low >> (shift - np.uint64(52))).astype(np.float64))
    zeros = np.where(fraction == 0, 52, 52 - exponent).astype(np.uint16)
    mantissa = ((fraction * 2 - 1).clip(0) * (1 << MANTISSA)).astype(np.uint16)
    out = np.zeros(REGISTERS, dtype=np.uint16)
    out[bucket[first]] = (zeros << np.uint16(MANTISSA)) + mantissa + np.uint16(1)
    return out


def chance_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected registers that two disjoint sets of n and m elements share by chance.

    The closed approximation of the expected number of collisions, scaled to
    the registers that hold something in either set.
    """
    large, small = np.maximum(n, m), np.minimum(n, m)
    ratio = large / np.maximum(small, 1)
    phi = 4 * ratio / (1 + ratio) ** 2
    return 0.169919487159739093975315012348630288992889 * REGISTERS * phi / 2**MANTISSA


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of register rows ``x`` against ``y``."""
    filled = ((x != _EMPTY) | (y != _EMPTY)).sum(axis=-1)
    equal = ((x == y) & (x != _EMPTY)).sum(axis=-1)
    by_chance = np.minimum(chance_collisions(n, m), equal)
    # What is shared already cannot be shared by chance.
    corrected = equal - by_chance * (1 - equal / np.maximum(filled, 1))
    return corrected / np.maximum(filled, 1)


def unpacked(bands: pa.Array) -> np.ndarray:
    """Register rows of an array of band lists."""
    flat = np.asarray(bands.flatten(), dtype=np.int64)
    return flat.view(np.uint16).reshape(-1, REGISTERS)


def sketches(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Per row ``doc_id``, ``n_shingles``, ``same`` (a hash of the words) and ``bands``."""
    ship(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        caches.only("words")
        for batch in batches:
            counts, same, bands = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                found = shingles(words, width)
                counts.append(len(found))
                same.append(xxhash.xxh3_128_digest(b" ".join(words)))
                bands.append(registers(found).view(np.int64))
            flat = pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64))
            ends = pa.array(np.arange(len(bands) + 1) * BANDS, pa.int32())
            columns = [
                batch.column("doc_id"),
                pa.array(counts, pa.int64()),
                pa.array(same, pa.binary()),
                pa.ListArray.from_arrays(ends, flat),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "same", "bands"])
        caches.only()

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(
        sketch, "doc_id bigint, n_shingles bigint, same binary, bands array<bigint>"
    )


def shingle_sets(docs: DataFrame, ids: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``id`` and ``hashes`` (the full set, 64 bits each) of the documents in ``ids``."""
    ship(docs.sparkSession)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only("words")
        for batch in batches:
            found = [shingles(words_of(t.as_py()), width).tobytes() for t in batch.column("text")]
            columns = [batch.column("id"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "hashes"])
        caches.only()

    # A filter of bounded size in front of the shuffle: few texts without a wanted id pass it.
    mark = F.pmod(F.xxhash64("id"), F.lit(MARKS)).cast("int").alias("mark")
    marks = ids.select(mark).distinct()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    near = rows.withColumn("mark", mark).join(F.broadcast(marks), "mark", "left_semi")
    return near.select("id", "text").join(ids, "id", "left_semi").mapInArrow(sets, "id bigint, hashes binary")


def close_pairs(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a``, ``b`` whose estimate leaves the threshold possible."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = unpacked(batch.column("x")), unpacked(batch.column("y"))
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            near = estimate(left, right, n, m) >= threshold - MARGIN
            yield batch.select(["a", "b"]).filter(pa.array(near))

    one = nodes.select(F.col("id").alias("a"), F.col("bands").alias("x"), F.col("n").alias("n"))
    two = nodes.select(F.col("id").alias("b"), F.col("bands").alias("y"), F.col("n").alias("m"))
    # Sets whose sizes are too far apart cannot reach the threshold.
    near = F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9
    with_sketches = pairs.join(one, "a").join(two, "b").where(near)
    return with_sketches.select("a", "b", "x", "y", "n", "m").mapInArrow(close, "a bigint, b bigint")


def verified(pairs: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs with ``100 * |A and B| >= percent * |A or B|`` on the full sets."""
    pairs = keep(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = keep(shingle_sets(docs, ids, width))

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for left, right in zip(x, y, strict=True):
            one, two = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            common = len(np.intersect1d(one, two, assume_unique=True))
            out.append(100 * common >= percent * (len(one) + len(two) - common))
        return pd.Series(out, dtype=bool)

    one = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    return keep(pairs.join(two, "b").join(one, "a").where(linked("x", "y")).select("a", "b"))


def in_blocks(keys: list[str], work) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Apply ``work`` to whole blocks of rows with equal keys, which come in order.

    It gets one or more neighbouring blocks at once, and the batch it returns
    is passed on unless it is None.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rows = table if rest is None else pa.concat_tables([rest, table])
            if not rows.num_rows:
                continue
            marks = block_marks(rows, keys)
            last = int((marks == marks[-1]).argmax())  # where the last block starts
            rest = rows.slice(last)
            if last and (found := work(rows.slice(0, last))) is not None:
                yield found
        if rest is not None and (found := work(rest)) is not None:
            yield found

    return run


def block_marks(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """The number of the block of each row."""
    change = np.zeros(rows.num_rows, dtype=bool)
    for key in keys:
        values = rows.column(key).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.cumsum(change)


def joined_parts(parts: np.ndarray) -> np.ndarray:
    """Positions of the pairs of parts (two rows) that a spanning forest needs."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    used = []
    for at, (a, b) in enumerate(parts.T.tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[a] = b
            used.append(at)
    return np.array(used, dtype=int)


def _promising(threshold: float):
    """Rows of torn buckets to pairs that connect all components with a promising pair.

    Of all pairs between components whose estimate leaves the threshold
    possible, a task returns one per text in any of them and those that a
    spanning forest of the components needs: no more than three per row.
    """

    def compare(rows: pa.Table) -> pa.RecordBatch | None:
        ids, part, block, low, high, n = (
            rows.column(c).to_numpy() for c in ("id", "component", "block", "low", "high", "n")
        )
        group = block_marks(rows, ["band", "value", "low", "high"])
        lists = rows.column("bands").combine_chunks()
        bands = np.asarray(lists.flatten(), dtype=np.int64).reshape(-1, BANDS)
        found = []
        for step in range(1, int(np.bincount(group).max())):
            i = np.flatnonzero(group[step:] == group[:-step])
            j = i + step
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            wanted = (part[i] != part[j]) & (small >= threshold * large - 1e-9)
            wanted &= (low[i] == high[i]) | (block[i] != block[j])
            i, j = i[wanted], j[wanted]
            for start in range(0, len(i), PAIRS):
                a, b = i[start : start + PAIRS], j[start : start + PAIRS]
                x, y = (bands[k].view(np.uint16).reshape(-1, REGISTERS) for k in (a, b))
                near = estimate(x, y, n[a], n[b]) >= threshold - MARGIN
                found.append(np.stack([a[near], b[near]]))
        pairs = np.concatenate(found, axis=1) if found else np.empty((2, 0), dtype=int)
        if not pairs.shape[1]:
            return None
        parts = np.sort(part[pairs], axis=0)
        _, some = np.unique(parts, axis=1, return_index=True)
        forest = some[joined_parts(parts[:, some])]
        _, of_each = np.unique(ids[pairs.ravel()], return_index=True)
        use = np.unique(np.concatenate([forest, of_each % pairs.shape[1]]))
        a, b = pairs[:, use]
        columns = [pa.array(x) for x in (ids[a], ids[b], part[a], part[b])]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "part_a", "part_b"])

    return in_blocks(["band", "value", "low", "high"], compare)


def promising(nodes: DataFrame, members: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a``, ``b`` of one bucket but different components, with these.

    Buckets whose members are all in one component send nothing. The others
    are cut into blocks by id, and every pair of blocks is one unit of work.
    """
    parts = members.join(known, "id", "left").withColumn(
        "component", F.coalesce("component", F.col("id"))
    )
    torn = (
        parts.groupBy("band", "value")
        .agg(
            F.min("component").alias("least"),
            F.max("component").alias("most"),
            F.count(F.lit(1)).alias("size"),
        )
        .where("least != most")
        .select("band", "value", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    )
    rows = parts.join(torn, ["band", "value"]).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    )
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "id",
        "component",
        "band",
        "value",
        "block",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
    ).join(nodes.select("id", "n", "bands"), "id")
    keys = ["band", "value", "low", "high"]
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "id")
    return ordered.mapInArrow(_promising(threshold), "a bigint, b bigint, part_a bigint, part_b bigint")


def common(one: np.ndarray, two: np.ndarray) -> int:
    """How many hashes two sorted sets share."""
    both = np.concatenate([one, two])
    both.sort(kind="stable")  # merges the two runs
    return int((both[1:] == both[:-1]).sum())


def _verify(threshold: float, percent: int):
    """Blocks of a family to links between their components, verified on the full sets.

    The likeliest pairs come first, and pairs of components that are already
    linked are left out: at most one link per component is returned.
    """

    def compare(rows: pa.Table) -> pa.RecordBatch | None:
        found = []
        group = block_marks(rows, ["family", "low", "high"])
        starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), rows.num_rows]
        for start, stop in zip(starts, starts[1:], strict=False):
            found += links_of(rows.slice(start, stop - start))
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    def links_of(rows: pa.Table) -> list[tuple[int, int]]:
        ids, part, n = (rows.column(c).to_numpy() for c in ("id", "component", "n"))
        bands = np.asarray(rows.column("bands").combine_chunks().flatten(), dtype=np.int64)
        regs = bands.view(np.uint16).reshape(-1, REGISTERS)
        order, promise = [], []
        for i in range(len(ids) - 1):
            others = np.flatnonzero(part[i + 1 :] != part[i]) + i + 1
            small, large = np.minimum(n[others], n[i]), np.maximum(n[others], n[i])
            others = others[small >= threshold * large - 1e-9]
            if len(others):
                near = estimate(regs[others], regs[i], n[others], n[i])
                some = near >= threshold - MARGIN
                order.append(np.stack([np.full(some.sum(), i), others[some]]))
                promise.append(near[some])
        if not order:
            return []
        pairs, likely = np.concatenate(order, axis=1), np.concatenate(promise)
        sets, root, links = rows.column("hashes"), {}, []

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        held: dict[int, np.ndarray] = {}
        for i, j in pairs[:, np.argsort(-likely, kind="stable")].T.tolist():
            a, b = find(int(part[i])), find(int(part[j]))
            if a == b:
                continue
            one, two = (
                held[k] if k in held else held.setdefault(k, np.frombuffer(sets[k].as_buffer(), np.uint64))
                for k in (i, j)
            )
            shared = common(one, two)
            if 100 * shared >= percent * (len(one) + len(two) - shared):
                root[a] = b
                links.append((int(ids[i]), int(ids[j])))
        return links

    return in_blocks(["family", "low", "high"], compare)


def links_between(
    nodes: DataFrame, pairs: DataFrame, docs: DataFrame, percent: int, width: int
) -> DataFrame:
    """Verified links between components that ``promising`` pairs connect to families.

    Every text of a promising pair goes to the blocks of its family with its
    full set. A component of more than BLOCK texts has blocks of its own, which
    are not compared with each other.
    """
    pairs = keep(pairs)
    families = components(pairs.select(F.col("part_a").alias("a"), F.col("part_b").alias("b")))
    sides = F.array(
        F.struct(F.col("a").alias("id"), F.col("part_a").alias("component")),
        F.struct(F.col("b").alias("id"), F.col("part_b").alias("component")),
    )
    texts = pairs.select(F.inline(sides)).distinct()
    named = families.select(F.col("id").alias("component"), F.col("component").alias("family"))
    texts = texts.join(named, "component")
    sizes = texts.groupBy("family", "component").agg(F.count(F.lit(1)).alias("size"))
    small = F.col("size") <= FAMILY
    rest = sizes.groupBy("family").agg(F.sum(F.when(small, F.col("size"))).alias("rest"))
    whole = F.when(~small, F.col("component")).otherwise(F.lit(-1)).cast("bigint")
    chunk = F.when(small, F.pmod(F.xxhash64("component"), F.ceil(F.col("rest") / FAMILY))).otherwise(
        F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / FAMILY))
    )
    placed = keep(
        texts.join(sizes, ["family", "component"])
        .join(rest, "family")
        .select(
            "id",
            "component",
            "family",
            whole.alias("whole"),
            small.alias("small"),
            F.concat_ws("/", whole.cast("string"), chunk.cast("string")).alias("block"),
        )
    )
    blocks = placed.select(
        F.col("family").alias("_family"), F.col("whole").alias("_whole"), F.col("block").alias("_block")
    ).distinct()
    apart = F.col("small") | (F.col("whole") != F.col("_whole"))
    met = placed.join(blocks, (F.col("family") == F.col("_family")) & apart).select(
        "id",
        "component",
        "family",
        F.least("block", "_block").alias("low"),
        F.greatest("block", "_block").alias("high"),
    )
    sets = keep(shingle_sets(docs, placed.select("id").distinct(), width))
    rows = met.join(nodes.select("id", "n", "bands"), "id").join(sets, "id")
    keys = ["family", "low", "high"]
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "id")
    return ordered.mapInArrow(_verify(percent / 100, percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = SHINGLE) -> DataFrame:
    """Groups of documents linked by ``100 * |A and B| >= percent * |A or B|``.

    Returns a row per row of ``docs``: ``doc_id``, ``n_shingles`` (distinct word
    shingles), ``component_id`` (smallest id reachable by links) and ``kept``.
    A text without words, or null, has 0 shingles and no links. Rows with one
    id are one node with the links of all of them. A row without id takes no
    part: its component is null and it is kept. Empty tables give no rows.
    """
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    rows = keep(sketches(docs, width))
    threshold = percent / 100
    nodes = keep(
        rows.where("n_shingles > 0 and doc_id is not null")
        .groupBy("same")
        .agg(
            F.min("doc_id").alias("id"),
            F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"),
        )
    )
    members = nodes.select("id", F.posexplode("bands").alias("band", "value")).where("value != 0")
    ends = (
        members.groupBy("band", "value")
        .agg(F.min("id").alias("least"), F.max("id").alias("most"))
        .where("least != most")
    )
    shared = keep(members.join(ends, ["band", "value"]))
    stars = shared.select("id", F.explode(F.array("least", "most")).alias("end")).where("id != end")
    stars = stars.select(F.least("id", "end").alias("a"), F.greatest("id", "end").alias("b"))
    links = verified(close_pairs(stars.distinct(), nodes, threshold), docs, percent, width)
    known = components(links)
    left = promising(nodes, shared.select("id", "band", "value"), known, threshold)
    more = links_between(nodes, left, docs, percent, width)
    # Rows of one id whose words differ are one node.
    own = nodes.select(F.col("id").alias("node"), "same")
    copies = rows.where("n_shingles > 0 and doc_id is not null").join(own, "same")
    ties = copies.where("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    twice = known.select(F.col("id").alias("a"), F.col("component").alias("b"))
    found = components(more.unionAll(twice).unionAll(ties)).withColumnRenamed("id", "doc_id")
    return rows.join(found, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def own_keys(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a bigint ``key`` that only equal texts of one id share.

    It is the id itself, but for rows without id and for ids with several
    texts: of those all but one text get a hash of id and text, 2**62 or more,
    so that of a group a document with an id of its own stays.
    """
    ident, mark = F.col("doc_id").cast("bigint"), F.xxhash64("text")
    first, again = fresh(docs, "_first"), fresh(docs, "_again")
    several = (
        docs.where(ident.isNotNull())
        .groupBy(ident.alias(again))
        .agg(F.min(mark).alias(first), F.max(mark).alias("_last"))
        .where(F.col(first) != F.col("_last"))
        .select(again, first)
    )
    hashed = F.xxhash64("doc_id", "text").bitwiseAND((1 << 62) - 1) + F.lit(1 << 62)
    own = F.when(ident.isNull() | (F.col(first) != mark), hashed).otherwise(ident)
    return docs.join(keep(several), ident == F.col(again), "left").withColumn(key, own).drop(first, again)


def one_of_each(docs: DataFrame, percent: int = 75, width: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each group, all columns; a repeated row counts as a copy.

    Rows that share an id but not the text are documents of their own, and rows
    without id take part in the search.
    """
    key = fresh(docs, "_kept")
    keyed = keep(own_keys(docs, key))
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), percent, width)
    ids = found.where("kept").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(ids, key, "left_semi").dropDuplicates([key]).drop(key)
