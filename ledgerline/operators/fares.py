"""Fares: labels, date pairs, cells, rankings and heatmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import BUCKETS, bucket_order, day_shift, duration, hour_bucket, to_24h
from .rollup import first_of

# Currencies as a label says them, airports of cities.
CURRENCY_WORDS = {"hong kong dollars": "HKD", "us dollars": "USD", "u.s. dollars": "USD", "singapore dollars": "SGD", "malaysian ringgit": "MYR", "new taiwan dollars": "TWD", "japanese yen": "JPY", "euros": "EUR", "euro": "EUR", "british pounds": "GBP", "australian dollars": "AUD", "canadian dollars": "CAD", "thai baht": "THB", "indonesian rupiah": "IDR", "philippine pesos": "PHP", "south korean won": "KRW", "chinese yuan renminbi": "CNY", "new zealand dollars": "NZD", "indian rupees": "INR"}
CITY_CODES = {"hong kong": "HKG", "dubai": "DXB", "penang": "PEN", "singapore": "SIN", "kuala lumpur": "KUL", "bangkok": "BKK", "taipei": "TPE", "tokyo": "TYO", "osaka": "KIX", "seoul": "ICN", "london": "LON", "paris": "PAR", "manila": "MNL", "sydney": "SYD", "melbourne": "MEL", "bali": "DPS", "phuket": "HKT", "ho chi minh city": "SGN", "hanoi": "HAN", "jakarta": "CGK", "shanghai": "SHA", "beijing": "PEK", "new york": "NYC", "san francisco": "SFO", "los angeles": "LAX", "doha": "DOH", "abu dhabi": "AUH", "mumbai": "BOM", "delhi": "DEL", "frankfurt": "FRA", "amsterdam": "AMS", "zurich": "ZRH", "istanbul": "IST", "cairo": "CAI"}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")

# The clauses of a spoken label, and of the older short form.
_CITY = r"([A-Za-z .'\-]+?)(?:\s+International\s+Airport|\s+Airport)?"
_WHEN = r"\s+at\s+(\d{1,2}:\d{2})\s*(AM|PM)\s+on\s+[A-Za-z]+,\s+([A-Za-z]+)\s+(\d+)"
LEG = rf"(?i)Leaves\s+{_CITY}{_WHEN}.*?arrives at\s+{_CITY}{_WHEN}"
AIRLINE = r"(?i)flight with\s+([^.]*?)\."
STOPS = r"(?i)(nonstop|(\d+)\s+stop)\s+flight"
TOTAL = r"(?i)Total duration\s+(\d+)\s*hr(?:s?)?\s*(?:(\d+)\s*min)?"
PRICE = r"(?i)From\s+([\d,]+)\s+([A-Za-z ]+?)\s+round trip total"
SHORT_LEG = r"(?i)(\d{1,2}:\d{2}\s*(?:AM|PM))\s+([A-Z]{3})\s+to\s+([A-Z]{3})"
SHORT_DURATION = r"(\d{1,2})\s*h(?:r)?\s*(?:(\d{1,2})\s*m(?:in)?)?"
SHORT_STOPS = r"(?i)non-?stop|(\d)\s*stop"
FLIGHT = r"\b([A-Z]{2})\s*(\d{3,4})\b"
SHORT_PRICES = (r"([A-Z]{2,3})?\s*\$?([\d,]+(?:\.\d{2})?)\s*(?:round\s+trip|total|for\s+all)", r"Price:\s*([A-Z]{2,3})?\s*\$?([\d,]+(?:\.\d{2})?)", r"()\$([\d,]+(?:\.\d{2})?)", r"()([\d,]{4,})\s*(?:HK\s*dollars|dollars|HKD|for\s+all)")
SHORT_NOISE = (r"(?i)Price:\s*(?:[A-Z]{2,3}\s*)?\$?[\d,]+(?:\.\d{2})?|(?:[A-Z]{2,3}\s*)?\$[\d,]+(?:\.\d{2})?|[\d,]{4,}\s*(?:HK\s*dollars|dollars|HKD)", r"(?i)(flights? from .*?(?=\.\s*\d|$)|round trip.*$|total for.*$|departs? .*$|arrives? .*$|price:.*$|select .*$|opens? .*$)")
SEARCH_BOX = r"Where (?:from|to)\??\s*(.+?)\s+([A-Z]{3})$"


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])


def city_code(city: Column, learned: Column | None = None) -> Column:
    """An airport code: learned from the page, else of a known city, else the name itself."""
    name = F.lower(F.trim(city))
    known = F.try_element_at(_map(CITY_CODES), name)
    return F.coalesce(F.try_element_at(learned, name), known, F.trim(city)) if learned is not None else F.coalesce(known, F.trim(city))


def learn_codes(labels: Column) -> Column:
    """City name to code, from the search boxes among an array of labels; the last of a name counts."""
    found = F.filter(labels, lambda x: x.rlike(SEARCH_BOX))
    pairs = F.transform(found, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, SEARCH_BOX, 1))).alias("k"), F.regexp_extract(x, SEARCH_BOX, 2).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


LEG_FIELDS = "origin string, dest string, depart_time string, arrive_time string, day_shift int, duration_min int, stops int, airline string, flight_no string"
#: Stand between the pieces of a label and between the fields of a piece; no label holds them.
_PIECE, _FIELD = "\x02", "\x01"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _pieces(text: Column, pattern: str, groups: int) -> Column:
    """The text cut at every match: what stands before, then by turns a match's fields and what follows it."""
    fields = _FIELD.join(f"${k}" for k in range(1, groups + 1))
    return F.split(F.regexp_replace(text, pattern, f"{_PIECE}{fields}{_PIECE}"), _PIECE)


def _each_leg(parts: Column, leg) -> Column:
    """``leg`` of (fields, what follows them up to the next leg) for every match."""
    at = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
    return F.transform(at, lambda i: _let(F.split(F.get(parts, i), _FIELD), lambda f: _let(F.get(parts, i + 1), lambda rest: leg(f, rest))))


def _clock(time: Column, half: Column) -> Column:
    hour = F.pmod(F.substring_index(time, ":", 1).cast("int"), F.lit(12)) + F.when(F.upper(half) == "PM", 12).otherwise(0)
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.substring_index(time, ":", -1))


def _month(name: Column) -> Column:
    return F.greatest(F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.lower(name)).cast("int") - 1, F.lit(0))


def _number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def _hours_minutes(text: Column) -> Column:
    """Minutes of the first one or two numbers; null without any."""
    return _let(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda n: F.get(n, F.lit(0)).try_cast("int") * 60 + F.coalesce(F.get(n, F.lit(1)).try_cast("int"), F.lit(0)))


def _leg(**fields: Column) -> Column:
    return F.struct(*[fields[n].cast(t).alias(n) for n, t in (c.split() for c in LEG_FIELDS.split(", "))])


def _option(text: Column, legs: Column, price: Column, currency: Column) -> Column:
    first = [legs[0][c.split()[0]].alias(c.split()[0]) for c in LEG_FIELDS.split(", ")]
    round_trip = text.rlike(r"(?i)round\s+trip") | (F.size(legs) >= 2)
    return F.struct(*first, price.alias("price"), currency.alias("currency"), round_trip.alias("round_trip"), legs.alias("legs"))


def _spoken(text: Column, parts: Column, learned: Column | None) -> Column:
    """Carrier, stops and total duration are said once for all legs."""
    said = F.struct(
        _hours_minutes(F.regexp_extract(text, TOTAL, 0)).alias("minutes"),
        F.coalesce(F.regexp_extract(text, STOPS, 2).try_cast("int"), F.lit(0)).alias("stops"),
        F.trim(F.substring_index(F.regexp_extract(text, AIRLINE, 1), " and ", 1)).alias("carrier"),
    )

    def of(said: Column) -> Column:
        def leg(f: Column, rest: Column) -> Column:
            depart, arrive = _clock(f[1], f[2]), _clock(f[6], f[7])
            shift = day_shift(_month(f[3]), f[4].try_cast("int"), _month(f[8]), f[9].try_cast("int"))
            return _leg(
                origin=city_code(f[0], learned), dest=city_code(f[5], learned), depart_time=depart, arrive_time=arrive, day_shift=shift,
                duration_min=F.coalesce(said["minutes"], duration(depart, arrive, shift)), stops=said["stops"], airline=F.when(said["carrier"] != "", said["carrier"]).otherwise("Unknown"), flight_no=F.lit(None),
            )

        price = _let(F.regexp_extract(text, PRICE, 1), _number)
        currency = F.try_element_at(_map(CURRENCY_WORDS), F.lower(F.trim(F.regexp_extract(text, PRICE, 2))))
        return _let(_each_leg(parts, leg), lambda legs: _option(text, legs, price, currency))

    return _let(said, of)


def _short(text: Column, parts: Column) -> Column:
    """Each leg's words stand between it and the next one."""

    def leg(f: Column, rest: Column) -> Column:
        left = rest
        for pattern in (SHORT_DURATION, FLIGHT, SHORT_STOPS, *SHORT_NOISE):
            left = F.regexp_replace(left, pattern, " ")
        name = F.regexp_replace(left, r"^[ .,;:-]+|[ .,;:-]+$", "")
        plane = F.concat(F.regexp_extract(rest, FLIGHT, 1), F.regexp_extract(rest, FLIGHT, 2))
        return _leg(
            origin=F.upper(f[1]), dest=F.upper(f[2]), depart_time=to_24h(f[0]), arrive_time=F.lit(None), day_shift=F.lit(0),
            duration_min=F.coalesce(_hours_minutes(F.regexp_extract(rest, SHORT_DURATION, 0)), F.lit(0)), stops=F.coalesce(F.regexp_extract(rest, SHORT_STOPS, 1).try_cast("int"), F.lit(0)),
            airline=_let(F.struct(name.alias("n"), plane.alias("p")), lambda x: F.when(x["n"] != "", x["n"]).when(x["p"] != "", F.substring(x["p"], 1, 2)).otherwise("Unknown")), flight_no=F.nullif(plane, F.lit("")),
        )

    priced = None
    for pattern in SHORT_PRICES:  # the first that matches counts
        found = F.struct(_number(F.regexp_extract(text, pattern, 2)).alias("price"), F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).alias("currency"))
        priced = F.when(text.rlike(pattern), found) if priced is None else priced.when(text.rlike(pattern), found)
    return _let(priced, lambda p: _let(_each_leg(parts, leg), lambda legs: _option(text, legs, p["price"], p["currency"])))


def parse_label(label: Column, learned: Column | None = None) -> Column:
    """Struct of a fare label: its first leg's fields, the price, and ``legs``; null where it names no leg.

    The spoken form is tried first, the short form where it finds nothing. Each form
    is cut at its legs in one pass, and fields are read by their place. A round trip
    is one that says so or has two legs.
    """

    def short(text: Column) -> Column:
        return _let(_pieces(text, SHORT_LEG, 3), lambda parts: F.when(F.size(parts) > 1, _short(text, parts)))

    def spoken(text: Column) -> Column:
        return _let(_pieces(text, LEG, 10), lambda parts: F.when(F.size(parts) > 1, _spoken(text, parts, learned)).otherwise(short(text)))

    return _let(F.translate(label, "\u202f\u2009", "  "), spoken)


def flies(option: Column, origin: Column, dest: Column) -> Column:
    """Whether any leg of a parsed label goes from ``origin`` to ``dest``."""
    return F.exists(option["legs"], lambda leg: (leg["origin"] == origin) & (leg["dest"] == dest))


def outbound(options: DataFrame, origin: Column, dest: Column, option: str = "option") -> DataFrame:
    """The options with a leg there."""
    return options.where(flies(F.col(option), origin, dest))


def inbound(options: DataFrame, origin: Column, dest: Column, option: str = "option") -> DataFrame:
    """The options with a leg back."""
    return options.where(flies(F.col(option), dest, origin))


def directions(options: DataFrame, origin: Column, dest: Column, option: str = "option") -> DataFrame:
    """The options with a leg there (``back`` false) and those with a leg back (``back`` true), each label parsed once for both."""
    ways = _let(F.col(option), lambda o: F.filter(F.array(F.when(flies(o, dest, origin), True), F.when(flies(o, origin, dest), False)), lambda way: way.isNotNull()))
    return options.withColumn("back", F.explode(ways)).drop(option)


def date_pairs(scopes: DataFrame) -> DataFrame:
    """Departure and return days of each scope: every pair of its windows with an allowed number of nights."""
    out = scopes.withColumn("depart_date", F.explode(F.sequence("depart_from", "depart_to"))).withColumn("return_date", F.explode(F.sequence("return_from", "return_to")))
    n = F.datediff("return_date", "depart_date")
    return out.where((n >= F.greatest(F.lit(1), F.coalesce("min_nights", F.lit(1)))) & (n <= F.coalesce("max_nights", F.lit(10_000)))).select("scope", "depart_date", "return_date", n.alias("nights"))


def select_outbound(options: DataFrame, cap: int) -> DataFrame:
    """The cheapest option of each airline and departure bucket, then the cheapest of these; unpriced last."""
    price = F.col("price").asc_nulls_last()
    best = first_of(options, ["airline", "dep_bucket"], [price, F.asc("depart_time"), F.asc("id")])
    return best.orderBy(price, "depart_time", "airline").limit(cap)


def cells(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Cheapest return of each bucket and number of stops, its airline carried along.

    ``n_itineraries`` counts the bucket whatever the stops: an oddity kept on purpose.
    """
    priced = returns.where("price is not null")
    per = priced.groupBy(*keys, "ret_bucket", "ret_stops").agg(F.min(F.struct("price", "id", "ret_airline")).alias("b"), F.count("*").alias("n"))
    n = F.sum("n").over(Window.partitionBy(*keys, "ret_bucket"))
    return per.select(*keys, "ret_bucket", "ret_stops", F.col("b.price").alias("min_price"), F.col("b.ret_airline").alias("return_airline"), n.alias("n_itineraries"))


def cheapest(fares: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The cheapest fare of each key with the rest of its row; equal prices by ``order``."""
    rest = [c for c in fares.columns if c not in keys]
    per = fares.groupBy(*keys).agg(F.min(F.struct("price", *order, *[c for c in rest if c not in ("price", *order)])).alias("b"))
    return per.select(*keys, "b.*")


def ranked(best: DataFrame) -> DataFrame:
    return best.orderBy("price", bucket_order(F.col("dep_bucket")), bucket_order(F.col("ret_bucket")), "airline")


def heatmap(fares: DataFrame) -> DataFrame:
    """Lowest price of each airline and departure bucket, a column for each return bucket."""
    return fares.groupBy("airline", "dep_bucket").pivot("ret_bucket", list(BUCKETS)).agg(F.min("price"))


def trend(fares: DataFrame, keys: list[str]) -> DataFrame:
    return fares.groupBy(*keys, "run_date").agg(F.min("price").alias("price"))


def trend_lines(trends: DataFrame, keys: list[str], top: int = 5) -> DataFrame:
    """The trend of the cheapest groupings, ranked by their lowest price."""
    low = trends.groupBy(*keys).agg(F.min("price").alias("lowest")).orderBy("lowest", *keys).limit(top)  # the limit bounds the window's one task
    ranks = low.withColumn("rank", F.row_number().over(Window.orderBy("lowest", *keys)))
    return trends.join(F.broadcast(ranks), keys)


def grouping_label(airline: Column, dep: Column, ret: Column) -> Column:
    return F.format_string("%s %s → %s", airline, dep, ret)


def with_bucket(df: DataFrame, ts: str, into: str) -> DataFrame:
    return df.withColumn(into, hour_bucket(F.hour(ts)))
