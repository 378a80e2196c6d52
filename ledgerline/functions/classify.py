"""Headline classes and materiality scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import AGGREGATORS, WIRES, outlet_name

# Weight of each class, and the bands of the score.
CLASS_WEIGHTS = {"guidance": 55, "earnings": 50, "ma": 48, "legal_regulatory": 45, "contract": 40, "capital": 38, "leadership": 33, "insider": 35, "product": 30, "analyst": 22, "price_move": 10, "unclassified": 20, "noise": 0}
HIGH, MEDIUM = 65, 35

# The pattern families, noise before events, each in order.
NOISE = {
    "listicle": (r"^\s*\d+\s+\S+.{0,40}\b(stocks?|shares|picks?|reasons?|things)\b", r"\bbetter buy\b", r"\bvs\.?\s", r"\bshould you (buy|sell|own)\b", r"\bis it time to\b", r"\bprediction\b", r"\bwhere will\b.*\bbe in\b", r"\bbuy-rated\b", r"\bbest .{0,30}\bstocks?\b", r"\bmillionaire(s|-maker)?\b", r"\b(multi[- ]?)?billionaire\b", r"^\s*meet\b", r"\b(daughter|son|wife|husband|family) of\b"),
    "ownership_churn": (
        r"\b(shares|stake|position|holdings)\b.{0,40}\b(acquired|sold|bought|purchased|boosted|raised|lowered|trimmed|cut|increased|decreased|reduced|lifted|grew|expanded)\b",
        r"\b(acquires|buys|sells|purchases|invests|boosts|takes|exits|trims|expands|reduces|liquidates|lifts|grows)\b.{0,40}\b(shares|stake|position|holdings)\b",
        r"\b(takes|has)\s+a\s+new\s+position\b", r"\bmakes?\s+(a\s+)?new\s+investment\b", r"\bhas\b.{0,40}\b(stock\s+)?position\s+in\b", r"\bposition\s+in\b.{0,40}\b(llc|inc|ltd|lp|corp|s\.a\.|ag)\b", r"\bshort interest\b", r"\b(52[- ]week (high|low))\b",
        r"\b(llc|lp|l\.p\.|inc\.?|n\.v\.|a/?s|s\.a\.)\s+(buys|sells|acquires|purchases|invests|boosts)\b",
    ),
    "preview_or_recap": (r"\b(earnings )?preview\b", r"\bcountdown to\b", r"\bahead of\b.{0,30}\bearnings\b", r"\bwhat to (expect|watch)\b", r"\bnears? buy point\b", r"\b(weekly|daily|monthly) (recap|wrap|roundup)\b", r"\bdeep dive\b", r"\bstock forecasts?\b", r"\bthings to know\b", r"\bcould (send|push|drive|take|make|turn)\b.{0,50}\b(price|shares?|stock|投資)\b", r"^\s*an event on\b"),
    "rhetorical_question": (r"^\s*(is|are|does|do|should|will|can|could|would|which|what|why)\b",),
    "market_research_pr": (r"\bmarket\b.{0,40}\b(size|share|forecast|outlook|report|analysis)\b.{0,40}\b(20\d\d|\$|cagr)", r"\bcagr\b", r"\bmarket (size )?(to reach|forecast to|expected to reach|projected)\b", r"^\s*\$?[\d.]+\+?\s*(billion|trillion|million)\b.{0,40}\bmarket\b", r"\bglobal\b.{0,40}\bmarket report\b"),
}
EVENTS = {
    "guidance": (r"\b(raises?|lifts?|cuts?|lowers?|trims?|reaffirms?|withdraws?|issues?)\b.{0,30}\b(guidance|outlook|forecast|full[- ]year)\b", r"\bguidance\b.{0,20}\b(raised|cut|lowered|reaffirmed)\b", r"\bwarns? on\b", r"\bprofit warning\b"),
    "earnings": (r"\b(beats?|misses?|tops?|falls short of)\b.{0,30}\b(estimates?|expectations?|consensus|forecasts?)\b", r"\bq[1-4]\b.{0,30}\b(results?|revenue|earnings|profit)\b", r"\b(reports?|posts?|delivers?|books?)\b.{0,25}\b(results?|revenue|earnings|profit|loss|sales)\b", r"\brecord (sales|revenue|quarter|profit|earnings)\b", r"\b(revenue|earnings|profit|eps)\b.{0,20}\b(rose|fell|jumped|surged|climbed|declined)\b"),
    "ma": (r"\b(acquires?|acquisition|to acquire|merger|merges? with|takeover|buyout)\b", r"\bagrees? to buy\b", r"\b(in talks|talks)\b.{0,70}\b(deal|acquisition|merger|stake|buy)\b", r"\bdiscloses?\b.{0,30}\bstake in\b", r"\bspin[- ]?off\b", r"\bdivests?\b"),
    "legal_regulatory": (r"\b(sec|doj|ftc|cma|eu|regulators?)\b.{0,30}\b(probe|investigation|inquiry|sues?|lawsuit|charges?)\b", r"\b(opens?|launches?)\b.{0,20}\b(probe|investigation)\b", r"\bexport controls?\b", r"\b(sanctions?|tariffs?|antitrust)\b", r"\b(lawsuit|sued|settlement|fined?|penalt(y|ies))\b", r"\b(approval|approves?|rejects?)\b.{0,25}\b(fda|regulator|antitrust)\b", r"\b(ban|bans|banned|restricts?)\b"),
    "contract": (r"\b(wins?|awarded|secures?|lands?|signs?)\b.{0,40}\b(contract|deal|order|award|agreement|application|deployment|customer)\b", r"\b\$[\d.]+\s*(billion|bn|million|m)\b.{0,30}\b(contract|deal|order)\b", r"\bpartners? with\b", r"\bpartnership\b", r"\bsupply agreement\b"),
    "capital": (r"\b(buyback|repurchase)\b", r"\b(dividend)\b.{0,25}\b(raises?|increases?|cuts?|suspends?|declares?|initiat)", r"\b(offering|raises?)\b.{0,25}\b(\$[\d.]+|equity|debt|notes|capital)\b", r"\b(stock )?split\b", r"\block[- ]?up\b", r"\bshares?\b.{0,40}\bsubject to a\b", r"\bipo\b", r"\bconvertible notes?\b"),
    "insider": (r"\b(ceo|cfo|cto|coo|chairman|chairwoman|director|officers?|executives?|insiders?)\b.{0,50}\b(sells?|sold|files? to sell|offloads?|unloads?|dumps?|buys?|purchases?|acquires?)\b", r"\binsider (selling|buying|sales?|purchases?|transactions?)\b", r"\bform 4\b"),
    "leadership": (r"\b(ceo|cfo|coo|cto|chair(man|woman|person)?|president)\b.{0,40}\b(steps? down|resigns?|departs?|to leave|out|fired|ousted|named|appoints?|appointed|succeeds?)\b", r"\b(names?|appoints?|hires?)\b.{0,25}\b(ceo|cfo|coo|cto|chief)\b", r"\bexecutive (shake[- ]?up|departure)\b"),
    "product": (r"\b(launches?|unveils?|introduces?|announces?|releases?|debuts?)\b.{0,40}\b(chip|chipset|product|platform|model|service|device|line|version|generation|accelerator|processor|gpu|cpu|silicon|engine|system|satellite|rocket|vehicle)\b", r"\bnext[- ]gen\b", r"\brolls? out\b", r"\b(begins?|starts?) (production|shipping)\b"),
    "analyst": (r"\b(upgrades?|downgrades?|initiates?)\b", r"\bprice target\b", r"\b(raises?|cuts?|lowers?)\b.{0,25}\bpt\b", r"\b(buy|sell|hold|overweight|underweight|neutral) rating\b"),
    "price_move": (r"\b(stock|shares)\b.{0,30}\b(rises?|falls?|jumps?|slides?|surges?|sinks?|plunges?|soars?|drops?|climbs?|tumbles?|rallies|gains?|slips?)\b", r"\b(rises?|falls?|jumps?|slides?|surges?|sinks?|plunges?|soars?|drops?|climbs?|tumbles?)\b.{0,20}\b\d+(\.\d+)?%", r"\bhits? (a )?(record|all[- ]time) high\b", r"\b(more than )?(tripled|doubled|quadrupled|halved)\b", r"\btrades?\b.{0,20}\b\d+% (below|above)\b"),
}


def family(patterns: tuple[str, ...], flags: str = "(?iU)") -> str:
    """One case-insensitive, Unicode-aware expression of a family."""
    return flags + "|".join(f"(?:{p})" for p in patterns)


def classify(title: Column) -> Column:
    """The class of a headline: blank or noise first, then the first event family that matches."""
    text = F.trim(F.coalesce(title, F.lit("")))
    found = F.when(text == "", "noise")
    for patterns in NOISE.values():
        found = found.when(text.rlike(family(patterns)), "noise")
    for name, patterns in EVENTS.items():
        found = found.when(text.rlike(family(patterns)), name)
    return found.otherwise("unclassified")


def suppressed(event_class: Column) -> Column:
    return event_class.isin("noise", "price_move", "unclassified")


def band(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


# What a score's parts are called in its reasons.
REASONS = {
    "class": "{class} (+{weight})",
    "wire": "carried by a wire (+12)",
    "outlets": "{n} outlets (+{bonus})",
    "aggregators": "aggregators only (-18)",
    "held": "open position (+15)",
    "peer": "about peer {peer} (-12)",
    "price_move": "bare price move, capped at {cap}",
    "noise": "headline is advice, churn or PR filler",
}


def _reason(name: str, **values: Column) -> Column:
    text = F.lit(REASONS[name])
    for mark, value in values.items():
        text = F.replace(text, F.lit("{" + mark.rstrip("_") + "}"), value.cast("string"))
    return text


def assess(event_class: Column, sources: Column, held: Column, peer_of: Column) -> Column:
    """Struct of score, band and reasons of a story (class of its title, outlets of all its copies)."""
    weight = F.element_at(F.create_map(*[x for k, v in CLASS_WEIGHTS.items() for x in (F.lit(k), F.lit(v))]), event_class)
    names = F.array_distinct(F.filter(F.transform(F.coalesce(sources, F.array().cast("array<string>")), outlet_name), lambda o: o != ""))
    n = F.size(names)
    wire = F.exists(names, lambda o: o.isin(list(WIRES)))
    bonus = F.when(n > 1, F.least(F.lit(15), 6 * (n - 1) - (n - 2) * 2)).otherwise(0)
    only = (n > 0) & F.forall(names, lambda o: o.isin(list(AGGREGATORS)))
    held = F.coalesce(held, F.lit(False))
    total = weight + F.when(wire, 12).otherwise(0) + bonus - F.when(only, 18).otherwise(0) + F.when(held, 15).otherwise(0) - F.when(peer_of.isNotNull(), 12).otherwise(0)
    move = event_class == "price_move"
    capped = F.when(move, F.least(total, F.lit(HIGH - 1))).otherwise(total)
    score = F.when(event_class == "noise", 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), capped))).cast("int")
    reasons = F.array_compact(F.array(
        _reason("class", class_=event_class, weight=weight),
        F.when(wire, _reason("wire")), F.when(n > 1, _reason("outlets", n=n, bonus=bonus)), F.when(only, _reason("aggregators")),
        F.when(held, _reason("held")), F.when(peer_of.isNotNull(), _reason("peer", peer=peer_of)), F.when(move, _reason("price_move", cap=F.lit(HIGH - 1))),
    ))
    return F.struct(score.alias("score"), band(score).alias("band"), F.when(event_class == "noise", F.array(_reason("noise"))).otherwise(reasons).alias("reasons"))


def mentions(title: Column, ticker: Column, names: Column) -> Column:
    """Whether a title names a subject: ``$sym``, ``(sym)``, or an alias as whole words."""
    low, sym = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.trim(F.substring_index(ticker, ".", 1)))
    by_symbol = (sym != "") & (F.contains(low, F.concat(F.lit("$"), sym)) | F.contains(low, F.concat(F.lit("("), sym, F.lit(")"))))
    by_name = F.exists(names, lambda n: (n != "") & F.regexp_like(low, F.concat(F.lit(r"(?U)\b\Q"), n, F.lit(r"\E\b"))))
    return F.coalesce(by_symbol | by_name, F.lit(False))


LEGAL = r"(?i)[,\s]+(incorporated|inc|corporation|corp|limited|ltd|plc|holdings|group|company|co|sa|ag|nv)\.?$"


def aliases(ticker: Column, company: Column) -> Column:
    """Names to look for: the symbol, the company's name, and that without its legal form; numbers alone are none."""
    tidy = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s-]", " "), r"\s+", " "))
    symbol = F.lower(F.trim(F.substring_index(ticker, ".", 1)))
    names = F.array(F.when(symbol.rlike(r"(?U)\p{L}"), symbol), tidy(company), tidy(F.regexp_replace(F.trim(company), LEGAL, "")))
    return F.filter(F.array_distinct(F.array_compact(names)), lambda n: F.length(n) >= 3)
