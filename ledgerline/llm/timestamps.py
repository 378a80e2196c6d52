"""Timestamps of mixed forms, brought to UTC by a table of wall-time intervals.

Stamps are parsed by column expressions alone. A wall time without an offset is
looked up in a table that cuts each zone's wall clock into intervals: ``normal``
ones with one offset, ``gap`` ones that the clock skips and ``overlap`` ones that
it shows twice, the last two with the offsets before and after the change. The
table is made by Spark from the zone rules and joined by range, in bins of a year.

What is broadcast is bounded, whatever the input: the table has at most a few rows
a year and known zone, and at most ``HOT`` sources are told by broadcast. A source
is one of these if it holds at least 1 / ``HOT`` of all undecided stamps; the
stamps of the others, whose groups are small by that rule, meet their source's
votes in a plain join. Votes are counted before they are shuffled.

Defined results: null, empty and overlong stamps, impossible dates and times and
those in a zone that is null or unknown (where no offset is given) are ``bad``, with
a null instant, and do not vote; a null source is a source of its own; ties between
votes are ``default``; repeated rows vote and are answered each; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash

DAY, HOUR, MINUTE = 86_400, 3_600, 60
#: UTC seconds from which and up to which zones are split: some days more than the years 2000 to 2099.
FIRST, LAST = 10_950 * DAY, 47_490 * DAY
#: At most so many sources have their votes broadcast.
HOT = 512
SPACE = " \t\n\x0b\f\r"

CLOCK = r"(?:[T\x20]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?(?:\x20?([AP]M))?(?:\x20?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
YEAR, TWO = "20[0-9]{2}", "[0-9]{2}"
#: Form -> pattern of the date, its length, and where year, month and day begin.
FORMS = {
    "dashed": (f"{YEAR}-{TWO}-{TWO}", 10, 1, 6, 9),
    "plain": (f"{YEAR}{TWO}{TWO}", 8, 1, 5, 7),
    "dotted": (rf"{TWO}\.{TWO}\.{YEAR}", 10, 7, 4, 1),
    "named": (rf"{TWO}\x20(?:{'|'.join(MONTHS)})\x20{YEAR}", 11, 8, 4, 1),
    "slashed": (f"{TWO}/{TWO}/{YEAR}", 10, 7, 4, 1),
}


def known_zones(spark: SparkSession) -> list[str]:
    """The zone names of the session's zone rules, some hundreds."""
    jvm = spark._jvm
    return sorted(str(jvm.java.lang.String.join("\n", jvm.java.time.ZoneId.getAvailableZoneIds())).split("\n"))


def _offset(at: Column) -> Column:
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(at), F.col("zone"))) - at


def _finer(changes: DataFrame, span: int, step: int) -> DataFrame:
    """(zone, at): the steps of each span from ``at`` on within which the zone's offset changes."""
    steps = changes.select("zone", F.explode(F.sequence(F.col("at"), F.col("at") + span - step, F.lit(step).cast("long"))).alias("at"))
    return steps.where(_offset(F.col("at")) != _offset(F.col("at") + step))


def intervals(zones: DataFrame) -> DataFrame:
    """(zone, kind, wall_from, wall_to, before, after) in seconds: every zone's wall clock without holes, ends exclusive."""
    start = zones.select("zone", F.lit(FIRST).cast("long").alias("at"))
    minutes = _finer(_finer(_finer(start, LAST - FIRST, DAY), DAY, HOUR), HOUR, MINUTE)
    changes = minutes.select("zone", (F.col("at") + MINUTE).alias("at"), _offset(F.col("at")).alias("before"), _offset(F.col("at") + MINUTE).alias("after"))
    changed = changes.select(
        "zone", F.when(F.col("after") > F.col("before"), "gap").otherwise("overlap").alias("kind"),
        (F.col("at") + F.least("before", "after")).alias("wall_from"), (F.col("at") + F.greatest("before", "after")).alias("wall_to"), "before", "after",
    )
    # One row a change, some hundreds a zone: in order they also bound the intervals between them.
    ordered = changed.groupBy("zone").agg(F.sort_array(F.collect_list(F.struct("wall_from", "wall_to", "before", "after"))).alias("c"))
    every = start.join(ordered, "zone", "left").select("zone", F.coalesce("c", F.array().cast("array<struct<wall_from:bigint,wall_to:bigint,before:bigint,after:bigint>>")).alias("c"), _offset(F.col("at")).alias("first"))
    between = F.transform(
        F.sequence(F.lit(0), F.size("c")),
        lambda k: F.struct(
            F.when(k == 0, F.lit(FIRST)).otherwise(F.get("c", k - 1)["wall_to"]).cast("long").alias("wall_from"),
            F.when(k == F.size("c"), F.lit(LAST)).otherwise(F.get("c", k)["wall_from"]).cast("long").alias("wall_to"),
            F.when(k == 0, F.col("first")).otherwise(F.get("c", k - 1)["after"]).alias("before"),
        ),
    )
    normal = every.select("zone", F.explode(between).alias("b")).select("zone", F.lit("normal").alias("kind"), "b.wall_from", "b.wall_to", "b.before", F.col("b.before").alias("after"))
    return changed.unionByName(normal).where("wall_from < wall_to")


def _number(text: Column, at: int, n: int = 2) -> Column:
    return F.substring(text, at, n).cast("int")


def _days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970, null for an impossible date. Within 2000 to 2099 every fourth year is a leap year."""
    longest = F.when(month == 2, F.when(year % 4 == 0, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    right = month.between(1, 12) & (day >= 1) & (day <= longest)
    return F.when(right, F.unix_date(F.make_date(year, month, day)))


def parse(stamps: DataFrame) -> DataFrame:
    """Fields of each stamp: epoch_us; or wall times (seconds) by day-month and month-day order, with ``shift`` if an offset is given."""
    text = F.btrim("raw", F.lit(SPACE))
    rows = stamps.select("stamp_id", "source", "zone", F.when(F.length(text) <= 64, text).alias("s"))
    form = F.coalesce(*(F.when(F.col("s").rlike(rf"\A{date}{CLOCK}\z"), name) for name, (date, *_) in FORMS.items()))
    epoch = F.when(F.col("s").rlike(r"\A[0-9]{10}\z"), F.lit(1_000_000)).when(F.col("s").rlike(r"\A[0-9]{13}\z"), F.lit(1_000))
    rows = rows.withColumn("unit", epoch).withColumn("form", F.when(F.col("unit").isNull(), form))

    def field(k: int) -> Column:
        return F.coalesce(*(F.when(F.col("form") == name, F.substring("s", at[k], 4 if k == 2 else 3 if k == 3 and name == "named" else 2)) for name, at in FORMS.items()))

    tail = F.coalesce(*(F.when(F.col("form") == name, F.substring(F.col("s"), n + 1, 64)) for name, (_, n, *_) in FORMS.items()))
    rows = rows.withColumns({"year": field(2).cast("int"), "mon": field(3), "day": field(4).cast("int"), "tail": tail})
    month = F.when(F.col("form") == "named", F.array_position(F.lit(list(MONTHS)), F.col("mon")).cast("int")).otherwise(F.when(F.col("form") != "named", F.col("mon")).cast("int"))
    group = lambda k: F.regexp_extract("tail", rf"\A{CLOCK}\z", k)
    rows = rows.withColumns({"month": month, "half": F.when(F.col("tail") == "", "").otherwise(group(4)), "off": F.when(F.col("tail") == "", "").otherwise(group(5))})
    timed = F.col("tail") != ""
    # Hours and minutes stand at fixed places; seconds too, where there are any.
    seconds = F.when(timed & (F.substring("tail", 7, 1) == ":"), _number(F.col("tail"), 8)).otherwise(0)
    rows = rows.withColumns({"h": F.when(timed, _number(F.col("tail"), 2)).otherwise(0), "mi": F.when(timed, _number(F.col("tail"), 5)).otherwise(0), "sec": seconds})
    hour = F.when(F.col("half") == "", F.when(F.col("h") <= 23, F.col("h"))).when(F.col("h").between(1, 12), F.col("h") % 12 + F.when(F.col("half") == "PM", 12).otherwise(0))
    clock = F.when((F.col("mi") <= 59) & (F.col("sec") <= 59), hour * HOUR + F.col("mi") * MINUTE + F.col("sec"))
    far = F.when(F.col("off").rlike("^[+-]"), _number(F.col("off"), 2))
    away = F.when(F.col("off").rlike("^[+-]"), F.right("off", F.lit(2)).cast("int"))
    shift = F.when(F.col("off") == "Z", 0).when((far <= 14) & (away <= 59), (far * HOUR + away * MINUTE) * F.when(F.col("off").startswith("-"), -1).otherwise(1))
    rows = rows.withColumns({"clock": clock.cast("long"), "shift": shift, "off_right": (F.col("off") == "") | shift.isNotNull()})
    wall = lambda m, d: F.when(F.col("off_right"), _days(F.col("year"), m, d) * F.lit(DAY).cast("long") + F.col("clock"))
    return rows.select(
        "stamp_id", "source", "zone", "shift", F.when(F.col("unit").isNotNull(), F.expr("try_cast(s as bigint)") * F.col("unit")).alias("epoch_us"),
        wall(F.col("month"), F.col("day")).alias("dm"),
        F.when(F.col("form") == "slashed", wall(F.col("day"), F.col("month"))).alias("md"), F.coalesce(F.col("form") == "slashed", F.lit(False)).alias("slash"),
    )


def _votes(rows: DataFrame) -> DataFrame:
    """(source, dm_votes, md_votes, undecided): a row a source."""
    one = lambda c: F.sum(c.cast("long"))
    only_dm, only_md = F.col("slashed") & F.col("dm").isNotNull() & F.col("md").isNull(), F.col("slashed") & F.col("dm").isNull() & F.col("md").isNotNull()
    counted = rows.where("slashed").groupBy("source").agg(one(only_dm).alias("dm_votes"), one(only_md).alias("md_votes"), one(F.col("undecided")).alias("undecided"))
    return counted.where("undecided > 0")


def _told(rows: DataFrame, votes: DataFrame) -> DataFrame:
    """``rows`` with the votes of their source, null-safe, for undecided stamps; ``told`` where there are some."""
    told = votes.select(F.col("source").alias("voted"), "dm_votes", "md_votes", F.lit(True).alias("told"))
    return rows.join(told, F.col("source").eqNullSafe(F.col("voted")) & F.col("undecided"), "left").drop("voted")


def normalise(stamps: DataFrame, hot: int = HOT) -> DataFrame:
    """stamp_id, utc_us, rule (bad, epoch, votes, default, plain), ambiguous, kind (of the wall time's interval) of each stamp."""
    known = known_zones(stamps.sparkSession)
    rows = stash(_marked(parse(stamps), known), "stamp-fields")  # narrow rows, parsed once
    votes = stash(_votes(rows), "stamp-votes")
    total = votes.agg(F.coalesce(F.sum("undecided"), F.lit(0)).alias("n")).first().n
    large = F.col("undecided") * hot >= total  # at most ``hot`` sources
    met = _told(rows, F.broadcast(votes.where(large)))
    if votes.where(~large).limit(1).count():
        apart = F.col("undecided") & F.col("told").isNull()
        rest = met.where(apart).drop("dm_votes", "md_votes", "told")
        met = met.where(~apart).unionByName(_told(rest, votes.where(~large)))
    table = stash(intervals(stamps.select("zone").distinct().where(F.col("zone").isin(known))), "wall-intervals")
    binned = table.withColumn("bin", F.explode(F.sequence(_bin(F.col("wall_from")), _bin(F.col("wall_to") - 1)))).withColumnRenamed("zone", "of_zone")
    first = F.coalesce(F.col("dm_votes") > F.col("md_votes"), F.lit(False))
    wall = F.when(F.col("undecided"), F.when(first, F.col("dm")).otherwise(F.col("md"))).otherwise(F.coalesce("dm", "md"))
    decided = F.when(F.col("dm_votes") != F.col("md_votes"), "votes").otherwise("default")
    rule = F.when(F.col("bad"), "bad").when(F.col("epoch_us").isNotNull(), "epoch").when(F.col("undecided"), decided).otherwise("plain")
    rows = met.select("stamp_id", "epoch_us", "shift", rule.alias("rule"), wall.alias("wall"), "zone").withColumn("at_bin", _bin(F.col("wall")))
    inside = F.col("shift").isNull() & (F.col("zone") == F.col("of_zone")) & (F.col("at_bin") == F.col("bin")) & (F.col("wall") >= F.col("wall_from")) & (F.col("wall") < F.col("wall_to"))
    found = rows.join(F.broadcast(binned), inside, "left")
    utc = F.coalesce("epoch_us", (F.col("wall") - F.coalesce("shift", "before")) * 1_000_000)
    odd = F.coalesce(F.col("kind") != "normal", F.lit(False))
    return found.select("stamp_id", utc.cast("long").alias("utc_us"), "rule", (F.col("rule").isin("votes", "default") | odd).alias("ambiguous"), "kind")


def _bin(wall: Column) -> Column:
    """Bins of 2**25 seconds, somewhat over a year."""
    return F.shiftright(wall, 25).cast("int")


def _marked(rows: DataFrame, known: list[str]) -> DataFrame:
    """``rows`` with bad, slashed and undecided; a bad row has no wall time."""
    placed = F.col("shift").isNotNull() | F.coalesce(F.col("zone").isin(known), F.lit(False))
    rows = rows.withColumns({c: F.when(placed, F.col(c)) for c in ("dm", "md")})
    rows = rows.withColumn("bad", F.col("epoch_us").isNull() & F.col("dm").isNull() & F.col("md").isNull())
    undecided = F.coalesce((F.col("dm") != F.col("md")), F.lit(False))
    return rows.withColumns({"undecided": undecided, "slashed": F.col("slash") & ~F.col("bad")})
