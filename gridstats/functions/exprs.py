"""Column expressions shared by the operators.

Spark 4 runs in ANSI mode: a bad cast, a zero denominator or ``corr`` on a
constant column fails the whole query. Everything here returns NULL instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- text to value ---------------------------------------------------------


# Texts that stand for a missing value in the raw files.
NULL_MARKERS = [
    "", r"\N", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def present(text: ColumnLike) -> Column:
    """The text; NULL where it is a marker of a missing value."""
    body = _c(text)
    return F.when(~body.isin(NULL_MARKERS), body)


def trimmed(text: ColumnLike) -> Column:
    """Text without surrounding blanks; markers of missing values are NULL."""
    return present(F.trim(_c(text)))


def to_double(text: ColumnLike) -> Column:
    """Decimal number; any other text, ``NaN`` and ``12d`` too, and what is too large is NULL."""
    body = trimmed(text)
    number = F.when(body.rlike(NUMBER), body).try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def to_whole(text: ColumnLike) -> Column:
    """Whole number; ``12.0`` counts as 12, anything with a fraction is NULL."""
    body = trimmed(text)
    number = to_double(text)
    via_double = F.when(number == F.floor(number), number.try_cast("bigint"))
    digits = F.regexp_extract(body, r"^([+-]?\d+)(\.0*)?$", 1)  # exact beyond what a double holds
    return F.coalesce(digits.try_cast("bigint"), via_double)


def to_day(text: ColumnLike) -> Column:
    return F.try_to_date(trimmed(text), "yyyy-MM-dd")


def clock_time(text: ColumnLike) -> Column:
    """Time of day as normalised ``HH:mm:ss`` text; hour 24 and later is NULL."""
    return F.date_format(F.try_to_timestamp(trimmed(text), F.lit("HH:mm:ss")), "HH:mm:ss")


def _span(hours: Column, minutes: Column, seconds: Column) -> Column:
    total = hours.try_cast("int") * 3600.0 + minutes.try_cast("int") * 60.0
    whole = total.try_cast("decimal(18,6)") + seconds.try_cast("decimal(18,6)")
    return F.make_dt_interval(secs=whole.try_cast("decimal(18,6)"))


def _clock_span(text: Column, pattern: str, *, hours: int | None, minutes: int, seconds: int) -> Column:
    """Interval from the groups of a pattern; text that does not match has no minutes."""
    hour_part = F.lit("0") if hours is None else F.regexp_extract(text, pattern, hours)
    return _span(
        F.when(hour_part == "", "0").otherwise(hour_part),
        F.regexp_extract(text, pattern, minutes),
        F.regexp_extract(text, pattern, seconds),
    )


MINUTES_SECONDS = r"^(\d+):(\d+(?:\.\d+)?)$"
HOURS_MINUTES_SECONDS = r"^(\d+):(\d+):(\d+(?:\.\d+)?)$"
OPTIONAL_HOURS = r"^(?:(\d+):)?(\d+):(\d+(?:\.\d+)?)$"


def lap_time(text: ColumnLike) -> Column:
    """``m:ss.fff`` as an interval; text with two colons is NULL."""
    return _clock_span(trimmed(text), MINUTES_SECONDS, hours=None, minutes=1, seconds=2)


def fastest_lap_time(text: ColumnLike) -> Column:
    """``m:ss.fff`` or ``h:mm:ss.fff`` as an interval."""
    return _clock_span(trimmed(text), OPTIONAL_HOURS, hours=1, minutes=2, seconds=3)


def _gap(text: Column) -> Column:
    return F.make_dt_interval(secs=text.substr(F.lit(2), F.length(text)).try_cast("decimal(18,6)"))


def result_time(text: ColumnLike) -> Column:
    """``+s.fff`` gap or ``h:mm:ss.fff``; a gap is not added to the winner's time."""
    body = trimmed(text)
    clock = _clock_span(body, HOURS_MINUTES_SECONDS, hours=1, minutes=2, seconds=3)
    return F.when(body.startswith("+"), _gap(body)).otherwise(clock)


def sprint_time(text: ColumnLike) -> Column:
    """As ``result_time``, and one-colon text is read as ``m:ss.fff``."""
    body = trimmed(text)
    return F.when(body.startswith("+"), _gap(body)).otherwise(fastest_lap_time(text))


def seconds_of(interval: ColumnLike) -> Column:
    """Length of a day-time interval in seconds."""
    span = _c(interval)
    parts = (
        F.extract(F.lit("DAY"), span) * 86400
        + F.extract(F.lit("HOUR"), span) * 3600
        + F.extract(F.lit("MINUTE"), span) * 60
        + F.extract(F.lit("SECOND"), span)
    )
    return parts.cast("double")


# --- null-aware arithmetic -------------------------------------------------


def ratio(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """Quotient, NULL where the denominator is zero or NULL."""
    return F.try_divide(_c(numerator).cast("double"), _c(denominator).cast("double"))


def is_true(condition: Column) -> Column:
    """A comparison in which NULL counts as false."""
    return F.coalesce(condition, F.lit(False))


def count_where(condition: Column) -> Column:
    """Number of rows in the group that meet the condition."""
    return F.count_if(is_true(condition))


def half_even(value: Column, digits: int) -> Column:
    """Round the way the reports do: scaled, halves to the even neighbour, scaled back."""
    scale = 10.0**digits
    return F.rint(value * scale) / scale


def clip(value: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Clamp a value; NULL stays NULL."""
    bounded = value
    if lower is not None:
        bounded = F.greatest(bounded, F.lit(lower))
    if upper is not None:
        bounded = F.least(bounded, F.lit(upper))
    return F.when(value.isNotNull(), bounded)


def pearson(x: ColumnLike, y: ColumnLike) -> Column:
    """Aggregate correlation over rows where both are present; NULL if undefined."""
    left, right = _c(x).cast("double"), _c(y).cast("double")
    both = left.isNotNull() & right.isNotNull()
    a, b = F.when(both, left), F.when(both, right)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


# --- calendar --------------------------------------------------------------


def decade(year: ColumnLike) -> Column:
    return (F.floor(_c(year) / 10) * 10).cast("int")


def linear_weight(year: ColumnLike, start: Column, stop: Column) -> Column:
    """Recency weight: 0 at ``start``, 1 at ``stop``."""
    return ratio(_c(year) - start, stop - start)


def age_at_year_end(year: ColumnLike, birth: ColumnLike) -> Column:
    last_day = F.make_date(_c(year), F.lit(12), F.lit(31))
    return F.date_diff(last_day, _c(birth)) / 365.25


# --- ordering --------------------------------------------------------------


def top_k(
    df: DataFrame, n: int | None, value: str, *ties: str, ascending: bool = False, digits: int = 9
) -> DataFrame:
    """The n best rows. Nulls come last both ways, and every tie is broken by key.

    The value is compared at ``digits`` decimals, since the last bits of a
    distributed floating sum depend on the order in which partitions merge.
    """
    shown = F.round(F.col(value).cast("double"), digits)
    first = shown.asc_nulls_last() if ascending else shown.desc_nulls_last()
    ordered = df.orderBy(first, *[F.col(t).asc_nulls_last() for t in ties])
    return ordered if n is None else ordered.limit(n)
