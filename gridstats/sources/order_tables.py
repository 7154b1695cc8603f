"""The fourteen race tables, derived from order tables.

A supplier is a driver, a customer's nation a circuit, a brand a constructor,
and all line items ordered from one nation in one month are a race.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstats.functions import NULL_MARKERS
from gridstats.operators.sequences import numbered, value_stretch
from gridstats.sources.files import keep
from gridstats.sources.schemas import SPECS

# Points for finishing first to tenth.
POINTS = [25.0, 18.0, 15.0, 12.0, 10.0, 8.0, 6.0, 4.0, 2.0, 1.0]

# Outcome of a race entry.
STATUS = {1: "Finished", 2: "Did not finish", 3: "+1 Lap"}

LAPPED_FROM = 21
#: Every FAVOURITE-th driver counts STRENGTH times its revenue, so that some titles are kept.
FAVOURITE, STRENGTH = 50, 8
TIE_RANGE = 1 << 20
ENTRY = ["raceId", "driverId"]


#: Circuits, and rows of a race or keys, that packed ids have room for.
CIRCUIT_ROOM, KEY_ROOM = 1_000_000, 200_000_000


def _packed(high: Column, low: Column, room: int) -> Column:
    """Two numbers as one; it fails where the low one is out of its room."""
    fits = low.between(0, room - 1)
    return F.when(fits, high * room + low).otherwise(F.raise_error("a key exceeds its room in a packed id"))


def _race_id() -> Column:
    month = F.col("year").cast("bigint") * 12 + F.col("round") - 1
    return _packed(month, F.col("circuitId"), CIRCUIT_ROOM)


def _points(position: str) -> Column:
    table = F.array(*[F.lit(p) for p in POINTS])
    scored = F.col(position).between(1, len(POINTS))
    return F.when(scored, F.get(table, F.col(position) - 1)).otherwise(0.0)


def _clock(milliseconds: Column, hours: bool) -> Column:
    ms = milliseconds
    tail = [F.floor(ms / 1000) % 60, ms % 1000]
    if hours:
        return F.format_string(
            "%d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, *tail
        )
    return F.format_string("%d:%02d.%03d", F.floor(ms / 60000), *tail)


class RaceTables:
    """Typed race tables over one folder of order tables; every table is lazy."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        """One row per line item with its race, driver and constructor.

        Kept: entries, laps and stops all start from it, and joining the line
        items to their orders and parts shuffles more than any later step.
        """
        items = self._read("lineitem").select(
            "l_orderkey",
            "l_partkey",
            F.col("l_suppkey").alias("driverId"),
            F.col("l_linenumber").alias("line"),
            F.rint(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
        )
        orders = self._read("orders").select(
            F.col("o_orderkey").alias("l_orderkey"),
            "o_custkey",
            F.year("o_orderdate").alias("year"),
            F.month("o_orderdate").alias("round"),
        )
        homes = self._read("customer").select(
            F.col("c_custkey").alias("o_custkey"),
            F.col("c_nationkey").cast("bigint").alias("circuitId"),
        )
        brands = self._read("part").select(
            F.col("p_partkey").alias("l_partkey"),
            F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("bigint").alias("constructorId"),
        )
        return keep(
            items.join(orders.join(homes, "o_custkey"), "l_orderkey")
            .join(brands, "l_partkey")
            .withColumn("raceId", _race_id())
            .drop("l_orderkey", "l_partkey", "o_custkey")
        )

    @cached_property
    def entries(self) -> DataFrame:
        """One row per race and driver, with the driver's team of the season.

        The line items are dealt by driver and season once. Their sums per
        race, driver and brand, the team (the brand of most revenue in the
        season) and the race totals all stay where the line items went.
        """
        season = ["driverId", "year"]
        dealt = self.lines.dropna(subset=season).repartition(*season)
        parts = dealt.groupBy("raceId", "year", "round", "circuitId", "driverId", "constructorId").agg(
            F.sum("cents").alias("revenue"), F.sum("quantity").alias("quantity")
        )
        brand = F.struct(
            F.sum("revenue").over(W.partitionBy(*season, "constructorId")).alias("revenue"),
            (-F.col("constructorId")).alias("_minus_id"),
        )
        best = F.max("_brand").over(W.partitionBy(*season))
        led = parts.withColumn("_brand", brand).withColumn("_team", -best.getField("_minus_id"))
        strength = F.when(F.col("driverId") % FAVOURITE == 0, STRENGTH).otherwise(1)
        totals = led.groupBy("raceId", "year", "round", "circuitId", "driverId", "_team").agg(
            (F.sum("revenue") * strength).alias("revenue"), F.sum("quantity").alias("quantity")
        )
        columns = [*season, "raceId", "round", "circuitId", "revenue", "quantity"]
        return keep(totals.select(*columns, F.col("_team").alias("constructorId")))

    @cached_property
    def _ranked(self) -> DataFrame:
        # Revenues differ, so ranges of revenue split a race. Quantities are small
        # whole numbers with many ties, which are split by ranges of the driver id.
        tied = F.struct((-F.col("quantity")).alias("q"), F.floor(F.col("driverId") / TIE_RANGE).alias("d"))
        placed = numbered(
            self.entries.withColumn("_by_revenue", value_stretch(self.entries, "revenue")),
            ["raceId"],
            "_by_revenue",
            [F.col("revenue").desc(), F.col("driverId")],
            "positionOrder",
        )
        started = numbered(
            placed.drop("_by_revenue").withColumn("_by_quantity", tied),
            ["raceId"],
            "_by_quantity",
            [F.col("quantity").desc(), F.col("driverId")],
            "grid",
            sizes_of=self.entries.withColumn("_by_quantity", tied),
        )
        return keep(started.drop("_by_quantity"))

    @property
    def results(self) -> DataFrame:
        retired = (F.col("driverId") * 7 + F.col("round") * 3 + F.col("circuitId")) % 11 == 0
        lapped = F.col("positionOrder") >= LAPPED_FROM
        finish_ms = F.lit(5400000).cast("bigint") + F.col("positionOrder") * 1234
        order, place = F.col("positionOrder"), F.col("position")
        gap_ms = (order - 1) * 1234
        gap = F.format_string("+%d.%03d", F.floor(gap_ms / 1000), gap_ms % 1000)
        time = (
            F.when(place.isNull(), None)
            .when(lapped, F.lit(STATUS[3]))
            .when(order == 1, _clock(finish_ms, hours=True))
            .otherwise(gap)
        )
        fastest_ms = F.lit(80000).cast("bigint") + F.col("quantity") * 37
        return (
            self._ranked.withColumn("position", F.when(~retired, order.cast("int")))
            .select(
                _packed(F.col("raceId"), order, KEY_ROOM).alias("resultId"),
                F.col("raceId").cast("bigint").alias("raceId"),
                "driverId",
                "constructorId",
                (F.col("driverId") % 100).cast("int").alias("number"),
                F.col("grid").cast("int").alias("grid"),
                "position",
                F.coalesce(place.cast("string"), F.lit("R")).alias("positionText"),
                order.cast("int").alias("positionOrder"),
                _points("position").alias("points"),
                F.when(place.isNull(), 30).when(lapped, 59).otherwise(60).alias("laps"),
                time.alias("time"),
                F.when(place.isNotNull() & ~lapped, finish_ms).alias("milliseconds"),
                (F.col("quantity") % 60 + 1).cast("int").alias("fastestLap"),
                F.col("grid").cast("int").alias("rank"),
                _clock(fastest_ms, hours=False).alias("fastestLapTime"),
                F.round(F.lit(200.0) + F.col("quantity") / 8, 3).alias("fastestLapSpeed"),
                F.when(place.isNull(), 2).when(lapped, 3).otherwise(1).cast("bigint").alias("statusId"),
            )
        )

    @cached_property
    def races(self) -> DataFrame:
        """One row per race, with practice and sprint days in the race month.

        Kept, so that joins know how small the table is.
        """
        race = self.entries.select("raceId", "year", "round", "circuitId").distinct()
        day = F.make_date("year", "round", F.lit(21))
        days = {
            f"{session}_date": F.date_sub(day, back)
            for session, back in [("fp1", 2), ("fp2", 2), ("fp3", 1), ("quali", 1)]
        }
        clocks = {
            f"{session}_time": F.lit(at)
            for session, at in [("fp1", "11:30:00"), ("fp2", "15:00:00"), ("fp3", "10:30:00"), ("quali", "14:00:00")]
        }
        sprint = F.col("round") % 4 == 0
        table = race.select(
            F.col("raceId").cast("bigint").alias("raceId"),
            "year",
            "round",
            "circuitId",
            F.format_string("Round %d of %d", "round", "year").alias("name"),
            day.alias("date"),
            F.format_string("%02d:00:00", F.col("circuitId") % 12 + 8).alias("time"),
            F.format_string("/race/%d", "raceId").alias("url"),
            *[c.alias(n) for pair in zip(days.items(), clocks.items()) for n, c in pair],
            F.when(sprint, F.date_sub(day, 1)).alias("sprint_date"),
            F.when(sprint, F.lit("09:30:00")).alias("sprint_time"),
        )
        return keep(table)

    @property
    def drivers(self) -> DataFrame:
        key = F.col("s_suppkey")
        name = F.split("s_name", "#")
        return self._read("supplier").select(
            key.alias("driverId"),
            F.col("s_name").alias("driverRef"),
            F.when(key % 3 != 0, (key % 100).cast("int")).alias("number"),
            F.upper(F.substring("s_name", 1, 3)).alias("code"),
            F.get(name, F.lit(0)).alias("forename"),
            F.get(name, F.lit(1)).alias("surname"),
            F.date_add(F.lit("1950-01-01").cast("date"), ((key * 37) % 7000).cast("int")).alias("dob"),
            F.concat(F.lit("N"), "s_nationkey").alias("nationality"),
            F.concat(F.lit("/driver/"), key).alias("url"),
        )

    @cached_property
    def constructors(self) -> DataFrame:
        """One row per brand; kept for the same reason."""
        number = F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("bigint")
        brands = self._read("part").select("p_brand").distinct()
        table = brands.select(
            number.alias("constructorId"),
            F.col("p_brand").alias("constructorRef"),
            F.concat(F.lit("Team "), number).alias("name"),
            F.concat(F.lit("N"), number % 5).alias("nationality"),
            F.concat(F.lit("/team/"), number).alias("url"),
        )
        return keep(table)

    @property
    def circuits(self) -> DataFrame:
        key = F.col("n_nationkey").cast("bigint")
        return self._read("nation").select(
            key.alias("circuitId"),
            F.col("n_name").alias("circuitRef"),
            F.concat(F.col("n_name"), F.lit(" Circuit")).alias("name"),
            F.concat(F.lit("Town, "), "n_regionkey").alias("location"),
            F.col("n_name").alias("country"),
            (key * 3.5 - 40.0).alias("lat"),
            (key * 7.25 - 90.0).alias("lng"),
            F.when(key % 4 != 0, key * 11.0).alias("alt"),
            F.concat(F.lit("/circuit/"), key).alias("url"),
        )

    @property
    def seasons(self) -> DataFrame:
        return self.races.select("year").distinct().withColumn("url", F.concat(F.lit("/season/"), "year"))

    @cached_property
    def status(self) -> DataFrame:
        """The outcomes that occur among the results, one row each.

        Kept: planned by the size of the results, its join would deal all of
        them to as many tasks as there are outcomes.
        """
        text = F.lit(None).cast("string")
        for key, name in STATUS.items():
            text = F.when(F.col("statusId") == key, name).otherwise(text)
        return keep(self.results.select("statusId").distinct().withColumn("status", text))

    @property
    def qualifying(self) -> DataFrame:
        """Same grain as the results; the grid decides who runs in q2 and q3."""
        base = F.lit(75000).cast("bigint") + F.col("grid") * 53
        return self.results.select(
            F.col("resultId").alias("qualifyId"),
            *ENTRY,
            "constructorId",
            "number",
            F.col("grid").alias("position"),
            _clock(base, hours=False).alias("q1"),
            F.when(F.col("grid") <= 15, _clock(base - 400, hours=False)).alias("q2"),
            F.when(F.col("grid") <= 10, _clock(base - 800, hours=False)).alias("q3"),
        )

    @property
    def sprint_results(self) -> DataFrame:
        """The results of a short race: times below an hour have one colon."""
        short = F.lit(1500000).cast("bigint") + F.col("positionOrder") * 617
        winner = F.col("position").isNotNull() & (F.col("positionOrder") == 1)
        return (
            self.results.withColumn("milliseconds", F.when(F.col("position").isNotNull(), short))
            .withColumn("time", F.when(winner, _clock(short, hours=False)).otherwise(F.col("time")))
            .drop("rank", "fastestLapSpeed")
        )

    @property
    def lap_times(self) -> DataFrame:
        """One lap per line item; the price in cents is the time."""
        ms = F.col("cents")
        return self.lines.select(
            F.col("raceId").cast("bigint").alias("raceId"),
            "driverId",
            F.col("line").alias("lap"),
            F.lit(None).cast("int").alias("position"),
            _clock(ms, hours=False).alias("time"),
            ms.alias("milliseconds"),
        )

    @property
    def pit_stops(self) -> DataFrame:
        """One stop per line item, 1.5 seconds per unit of quantity.

        A stop of a minute or more has no duration, only milliseconds: the raw
        files write it with a colon, which cleaning reads as no number.
        """
        ms = F.col("quantity") * 1500
        return self.lines.select(
            F.col("raceId").cast("bigint").alias("raceId"),
            "driverId",
            F.col("line").alias("stop"),
            (F.col("line") * 7).alias("lap"),
            F.format_string("%02d:%02d:00", F.col("circuitId") % 12 + 8, F.col("line") * 5).alias("time"),
            F.when(ms < 60000, ms / 1000.0).alias("duration"),
            ms.alias("milliseconds"),
        )

    @property
    def constructor_results(self) -> DataFrame:
        """Points per race and team; disqualified if it scored none in an odd round."""
        scored = self.results.groupBy("raceId", "constructorId").agg(F.sum("points").alias("points"))
        odd_round = F.floor(F.col("raceId") / CIRCUIT_ROOM) % 2 == 0  # months are counted from 0
        lost = (F.col("points") == 0) & odd_round
        return scored.select(
            _packed(F.col("raceId"), F.col("constructorId"), KEY_ROOM).alias("constructorResultsId"),
            "raceId",
            "constructorId",
            "points",
            F.when(lost, F.lit("D")).alias("status"),
        )

    def _standings(self, key: str, id_name: str) -> DataFrame:
        table = self.results.groupBy("raceId", key).agg(
            F.sum("points").alias("points"),
            F.min("position").alias("position"),
            F.count_if(F.coalesce(F.col("position") == 1, F.lit(False))).cast("int").alias("wins"),
        )
        return table.select(
            _packed(F.col("raceId"), F.col(key), KEY_ROOM).alias(id_name),
            "raceId",
            key,
            "points",
            "position",
            F.coalesce(F.col("position").cast("string"), F.lit("-")).alias("positionText"),
            "wins",
        )

    @property
    def constructor_standings(self) -> DataFrame:
        return self._standings("constructorId", "constructorStandingsId")

    @property
    def driver_standings(self) -> DataFrame:
        return self._standings("driverId", "driverStandingsId")

    def as_text(self, name: str) -> DataFrame:
        """A table the way raw CSV files hold it: as untidy text.

        Values are padded with blanks, whole numbers partly have a decimal
        point, nulls are any of the usual markers or unreadable text, and rows
        whose first column is a multiple of ten occur twice. Durations of a
        minute or more are written with a colon.
        """
        frame = getattr(self, name)
        if name == "pit_stops":
            colon = _clock(F.col("milliseconds"), hours=False)
            frame = frame.withColumn(
                "duration", F.coalesce(F.col("duration").cast("string"), colon)
            )
        kinds, first = SPECS[name].columns, frame.columns[0]
        rough = [_untidy(c, kinds[c]).alias(c) for c in frame.columns]
        copies = F.when(F.col(first) % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return frame.select(*rough, F.explode(copies).alias("_copy")).drop("_copy")


def _untidy(column: str, kind: str) -> Column:
    """A value as padded text, a null as a marker or, where numbers are expected, as other text."""
    value = F.col(column).cast("string")
    draw = F.pmod(F.xxhash64(F.lit(column), column), F.lit(60)).cast("int")
    if kind in ("whole", "small"):
        value = F.when(draw % 5 == 0, F.concat(value, F.lit(".0"))).otherwise(value)
    if kind != "text":
        value = F.concat(F.repeat(F.lit(" "), draw % 3), value, F.repeat(F.lit(" "), draw % 2))
    missing = NULL_MARKERS + (["12d", "1f", "abc", "Infinity", "1,5"] if kind in ("whole", "small", "real") else [])
    row = F.pmod(F.monotonically_increasing_id(), F.lit(len(missing))).cast("int")
    return F.coalesce(value, F.get(F.array(*map(F.lit, missing)), row))
