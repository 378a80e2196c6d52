"""Calendar and clock functions; ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("Mar", "Jun", "Sep", "Dec")
BUCKETS = tuple(f"{h:02d}-{h + 3:02d}" for h in range(0, 24, 3))


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def quarter_index(day: Column) -> Column:
    """Quarters counted from year 0: calendar arithmetic on them is exact."""
    return (F.year(day) * 4 + F.quarter(day)).cast("int")


def quarter_label(index: Column) -> Column:
    """``2026/Jun`` of an index."""
    year = F.floor((index - 1) / 4).cast("int")
    name = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), (F.pmod(index - 1, F.lit(4)) + 1).cast("int"))
    return F.concat(year.cast("string"), F.lit("/"), name)


def parse_quarter(label: Column) -> Column:
    """The index of ``2026/Jun``; null for anything else."""
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(label, r"^\d{4}/(Mar|Jun|Sep|Dec)$", 1))
    return F.when(month > 0, F.substring(label, 1, 4).cast("int") * 4 + month).cast("int")


def quarter_end(index: Column) -> Column:
    year = F.floor((index - 1) / 4).cast("int")
    return F.last_day(F.make_date(year, (F.pmod(index - 1, F.lit(4)) * 3 + 3).cast("int"), F.lit(1)))


def hour_bucket(hour: Column) -> Column:
    """Three-hour bucket label of an hour."""
    first = (F.floor(hour / 3) * 3).cast("int")
    return F.format_string("%02d-%02d", first, first + 3)


def bucket_order(bucket: Column) -> Column:
    """Place of a bucket; unknown ones last."""
    at = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), bucket)
    return F.when(at > 0, at - 1).otherwise(len(BUCKETS)).cast("int")


def to_24h(clock: Column) -> Column:
    """``8:05 PM`` as ``20:05``; null if unreadable."""
    hour = F.regexp_extract(clock, r"^\s*(\d{1,2}):(\d{2})\s*([AaPp])[Mm]", 1)
    minute = F.regexp_extract(clock, r"^\s*(\d{1,2}):(\d{2})\s*([AaPp])[Mm]", 2)
    late = F.lower(F.regexp_extract(clock, r"^\s*(\d{1,2}):(\d{2})\s*([AaPp])[Mm]", 3)) == "p"
    return F.when(hour != "", F.format_string("%02d:%s", F.pmod(hour.cast("int"), F.lit(12)) + F.when(late, 12).otherwise(0), minute))


def minutes_of(clock: Column) -> Column:
    return F.substring(clock, 1, 2).cast("int") * 60 + F.substring(clock, 4, 2).cast("int")


def day_shift(from_month: Column, from_day: Column, to_month: Column, to_day: Column) -> Column:
    """Days between month/day labels on 31-day months; a negative shift counts as 1 (an oddity kept on purpose)."""
    shift = (to_month * 31 + to_day) - (from_month * 31 + from_day)
    return F.when(shift < 0, 1).otherwise(shift).cast("int")


def duration(depart: Column, arrive: Column, days: Column) -> Column:
    return minutes_of(arrive) - minutes_of(depart) + days * 1440


def add_minutes(clock: Column, minutes: Column) -> Column:
    at = F.pmod(minutes_of(clock) + minutes, F.lit(1440)).cast("int")
    return F.format_string("%02d:%02d", F.floor(at / 60).cast("int"), F.pmod(at, F.lit(60)))


def nights(depart: Column, back: Column) -> Column:
    return F.datediff(back, depart)


def parse_local(value: Column, zone: str) -> Column:
    """(local timestamp_ntz, utc timestamp_ntz) of epoch seconds, ISO with an offset, or naive local time."""
    epoch = F.when(value.rlike(r"^\d+$"), F.timestamp_seconds(value.cast("long")))
    zoned = F.when(value.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(value))
    moment = F.coalesce(epoch, zoned)
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment.cast("timestamp_ntz"))
    naive = F.when(moment.isNull(), F.to_timestamp_ntz(F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"), F.replace(value, F.lit("T"), F.lit(" ")))))
    local = F.coalesce(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc), naive)
    return F.struct(local.alias("local"), F.coalesce(utc, F.convert_timezone(F.lit(zone), F.lit("UTC"), naive)).alias("utc"))


def vendor_time(value: Column) -> Column:
    """Vendor time stamps in their known shapes; null, never now, where unreadable."""
    compact = F.when(value.rlike(r"^\d{8}T\d{6}$"), F.try_to_timestamp(value, F.lit("yyyyMMdd'T'HHmmss")))
    short = F.when(value.rlike(r"^\d{8}T\d{4}$"), F.try_to_timestamp(value, F.lit("yyyyMMdd'T'HHmm")))
    epoch = F.when(value.rlike(r"^\d{9,11}$"), F.timestamp_seconds(value.cast("long")))
    return F.coalesce(compact, short, epoch, F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(value)))


def overdue(index: Column, today: Column, grace_days: int = 100) -> Column:
    """Whether the quarter after ``index`` should have been published by ``today``."""
    return today > F.date_add(quarter_end(index + 1), grace_days)


def in_window(ts: Column, days: list[int], start_minute: int, end_minute: int) -> Column:
    """Weekday (Monday 0) and time of day within a window, ends included, past midnight if it wraps."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    lo, hi = start_minute * 60, end_minute * 60
    inside = seconds.between(lo, hi) if lo <= hi else (seconds >= lo) | (seconds <= hi)
    return F.weekday(ts).isin(days) & inside
