"""Mix sources to target weights by pivotal dependent rounding.

Every document is to be taken ``target / source_size`` times, a whole number of
times and a fractional rest. Two documents with fractional rests duel: words
move from one to the other until one rest is 0 or 1. Either direction is drawn
so that both keep their expected rest, and what one gains in words the other
loses, so a source's words stay the same through all duels. At most one
document per bucket keeps a rest; these meet in the next level of a reduction
tree until one document per source is left, which a draw decides. A source
thus misses its target by less than one document. Rows that repeat id, source
and text are one item that takes the whole part of its rests outright and duels
over the last one; its extra copies go to its first rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstats.llm.names import fresh
from gridstats.operators.sequences import numbered
from gridstats.shipping import ship
from gridstats.sources import keep

WORDS = r"[^\x20\x09-\x0D]+"
#: Documents or rests that one task of the tree has in one bucket, about.
BUCKET = 4096
_ITEM = "src bigint, bucket bigint, ident bigint, size bigint, rest double, open boolean"


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def identity() -> Column:
    """A hash of id, source and text."""
    return F.xxhash64(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("-")),
        F.coalesce(F.col("source"), F.lit("\0")),
        F.coalesce(F.col("text"), F.lit("\0")),
    )


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2
) -> DataFrame:
    """Words to take of each source.

    ``sizes`` has ``source`` and ``size``. Sources in code point order, null
    last, have the weights in turn and share ``share`` times all words. No
    target exceeds ``most`` times its source; what is over is shared by weight
    among the others, until none is above. Returns ``src`` (from 0), ``source``,
    ``docs``, ``source_size`` and ``target``; no row for an empty table.
    """
    totals = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")
    )
    # One row per source. Their ranks are counted per range, so any number of them will do.
    ordered = F.col("source").asc_nulls_last()
    ranges = keep(totals.repartitionByRange(ordered).withColumn("part", F.spark_partition_id()))
    ranked = numbered(ranges, [], "part", [ordered], "rank").withColumns(
        {
            "src": F.col("rank") - 1,
            "weight": F.element_at(
                F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")
            ),
            "bound": F.lit(most) * F.col("source_size"),
        }
    )
    sources = keep(ranked.select("src", "source", "docs", "source_size", "weight", "bound"))
    level, full = 0.0, -1
    while True:
        above = F.col("bound") <= F.lit(level) * F.col("weight")
        state = sources.agg(
            F.sum("source_size").alias("words"),
            F.coalesce(F.sum(F.when(above, F.col("bound"))), F.lit(0)).alias("bounded"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("free"),
            F.count_if(above).alias("full"),
        ).first()
        if not state["free"] or state["full"] == full:
            break
        level, full = (share * state["words"] - state["bounded"]) / state["free"], state["full"]
    target = F.when(above, F.col("bound").cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return sources.select("src", "source", "docs", "source_size", target.alias("target"))


def duels(src: int, bucket: int, sizes: list[int], rests: list[float], seed: int) -> list[float]:
    """Rests after all duels: 0 or 1 for all but one at most."""
    draws = np.random.default_rng([seed, src, bucket]).random(len(sizes)).tolist()
    rests, held = list(rests), None
    for other in range(len(sizes)):
        if held is None:
            held = other
            continue
        a, b, p, q = sizes[held], sizes[other], rests[held], rests[other]
        gain = min(1.0 - p, q * b / a)  # the held one takes from the other
        loss = min(p, (1.0 - q) * b / a)
        if draws[other] * (gain + loss) < loss:
            full = 1.0 - p <= q * b / a
            rests[held], rests[other] = (1.0, q - gain * a / b) if full else (p + gain, 0.0)
        else:
            gone = p <= (1.0 - q) * b / a
            rests[held], rests[other] = (0.0, q + loss * a / b) if gone else (p - loss, 1.0)
        open_ones = [i for i in (held, other) if 0.0 < rests[i] < 1.0]
        held = open_ones[0] if open_ones else None
    return rests


def _settle(seed: int):
    def settle(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # From large to small: the one whose rest is left over in the end is a small one.
        order = {"size": False, "draw": True, "ident": True}
        rows = rows.sort_values(list(order), ascending=list(order.values()), ignore_index=True)
        rests = duels(int(key[0]), int(key[1]), rows["size"].tolist(), rows["rest"].tolist(), seed)
        return rows.assign(rest=rests, open=[0.0 < r < 1.0 for r in rests]).drop(columns="draw")

    return settle


def copies(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: int = 7,
) -> DataFrame:
    """How often the mix takes each document.

    Returns ``doc_id``, ``ident`` (a hash of id, source and text), ``source``,
    ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (size times
    copies), a row per row of ``docs``. Reruns agree: draws follow from the
    seed and from ids. Size is 0 for a null text, and such documents are taken
    a whole number of times without words. Rows that repeat id, source and
    text share their extra copies, one a row. A null source is a source.
    """
    ship(docs.sparkSession)
    sizes = keep(
        docs.select("doc_id", "source", word_count("text").alias("size"), identity().alias("ident")).withColumn(
            "part", F.spark_partition_id()
        )
    )
    sources = keep(source_targets(sizes, weights, share, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).select(
        "doc_id",
        "ident",
        "part",
        sizes["source"],
        "size",
        "src",
        "docs",
        "source_size",
        "target",
        F.floor(rate).alias("whole"),
        (rate - F.floor(rate)).alias("rest"),
    )
    items = (
        rated.where((F.col("rest") > 0) & (F.col("size") > 0))
        .groupBy("src", "ident")
        .agg(
            F.first("size").alias("size"),
            (F.first("rest") * F.count(F.lit(1))).alias("share"),
            F.first("docs").alias("docs"),
        )
    )
    items = keep(items.withColumn("outright", F.floor("share")).withColumn("rest", F.col("share") - F.col("outright")))
    outright = items.where("outright > 0").select("src", "ident", F.col("outright").alias("extra"))
    items = items.where("rest > 0").drop("share", "outright")
    buckets = F.ceil(F.col("docs") / BUCKET)
    level = items.withColumn("bucket", F.pmod(F.xxhash64("ident", F.lit(seed)), buckets)).drop("docs")
    width = sources.agg(F.coalesce(F.max(F.ceil(F.col("docs") / BUCKET)), F.lit(1))).first()[0]
    decided = outright
    while True:
        drawn = level.withColumn("draw", F.xxhash64("ident", F.lit(seed), F.lit(width)))
        settled = keep(drawn.groupBy("src", "bucket").applyInPandas(_settle(seed), _ITEM))
        last = width <= 1
        rest = F.when(F.col("open"), (F.col("rest") > chance(seed)).cast("double")).otherwise(
            F.col("rest")
        )
        closed = settled if last else settled.where(~F.col("open"))
        closed = closed.select("src", "ident", rest.cast("bigint").alias("extra"))
        decided = decided.unionAll(closed)
        if last:
            break
        width = -(-width // BUCKET)
        level = settled.where("open").withColumn("bucket", F.pmod("bucket", F.lit(width))).drop("open")
    decided = decided.groupBy(F.col("src").alias("_src"), F.col("ident").alias("_ident")).agg(
        F.sum("extra").alias("extra")
    )
    # Rows of one item are alike here, so any of them may be the first.
    rated = numbered(rated, ["src", "ident"], "part", [F.col("doc_id")], "row", sizes_of=rated)
    same = (F.col("src") == F.col("_src")) & (F.col("ident") == F.col("_ident"))
    times = F.col("whole") + (F.col("row") <= F.coalesce(F.col("extra"), F.lit(0))).cast("int")
    return rated.join(decided, same, "left").select(
        "doc_id",
        "ident",
        "source",
        "size",
        "source_size",
        "target",
        times.cast("int").alias("copies"),
        (times * F.col("size")).alias("taken"),
    )


def chance(seed: int) -> Column:
    """A number in [0, 1) that follows from the document and the seed."""
    return F.pmod(F.xxhash64("ident", F.lit(seed + 1)), F.lit(1 << 52)) / float(1 << 52)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix: each row as often as ``copies`` says, with all its columns."""
    own, key, times, copy = (fresh(docs, n) for n in ("_own", "_ident", "_times", "_copy"))
    more = fresh(docs, "_more")
    total, rows_of = F.sum("copies"), F.count(F.lit(1))
    taken = keep(
        copies(docs, **how)
        .groupBy(F.col("ident").alias(key))
        .agg(F.floor(total / rows_of).cast("int").alias(times), (total % rows_of).alias(more))
        .where((F.col(times) > 0) | (F.col(more) > 0))
    )
    named = [F.col(f"`{c}`") for c in docs.columns]
    found = docs.withColumn(own, identity()).join(taken, F.col(own) == F.col(key))
    rows = found.where(F.col(more) == 0).select(*named, times)
    if not taken.where(F.col(more) > 0).isEmpty():  # the first rows of an item once more than the others
        some = found.where(F.col(more) > 0).select(
            F.struct(*named).alias("doc"), F.col(key).alias("item"), F.col(times).alias("times"), F.col(more).alias("more")
        )
        some = numbered(keep(some.withColumn("part", F.spark_partition_id())), ["item"], "part", [F.col("item")], "row")
        dealt = (F.col("times") + (F.col("row") <= F.col("more")).cast("int")).cast("int")
        some = some.select(*(F.col("doc")[c].alias(c) for c in docs.columns), dealt.alias(times))
        rows = rows.unionAll(some.where(F.col(times) > 0))
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return rows.select(*named)
