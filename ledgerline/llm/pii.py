"""Personal data: base patterns, and further spans that boosted trees confirm.

For each kind a strict pattern gives the base spans, which always stay. A wider,
high-recall pattern proposes more spans, which may overlap them and each other. A
proposal that touches no base span is described by features of its format and of
the characters around it, scored by gradient-boosted trees, and added where its
probability reaches its kind's threshold. Of overlapping additions the likeliest
stays, then the likeliest that overlaps none of those that stay, and so on (ties:
the earlier kind, then the further left). Overlaps are found between neighbours in
the order of the text, so the time follows the number of spans; only additions that
overlap others are compared with each other.

Secrets (keys and tokens) are a fifth kind, without a strict pattern: they are
proposed and scored alone.

The trees are trained here, on a bounded sample of labelled rows (``SAMPLE``): by rule,
written-out variants of personal data and look-alikes (versions, dates, prices, order
numbers) are set between words of the documents themselves, taken from the first
CONTEXT_CHARS characters of the CONTEXTS documents of smallest hash; so is, as it
stands there, the prose around ``at`` and across the ends of sentences. Half of the
sample fits the trees; on the other half each kind's threshold is set to the smallest
score with the precision asked for, in all above it and in the MARGIN rows next above. Trees become one SQL expression, so scoring
stays in the JVM. Apart from this sample every text is searched whole.

Positions are code points, ends exclusive. They come from the pieces between
matches: a split and an extraction by one pattern give alternating lengths.

Defined results: a null or empty text has no spans; rows are independent, so ties,
repeated rows and extra columns (not read, except by ``redact``, which passes them
on) change nothing; an empty table gives an empty result; texts are searched whole.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_name

KINDS = ("email", "ip", "card", "phone")
#: What the trees may add.
ADDED = (*KINDS, "secret")

#: The strict patterns. Possessive where nothing after could match otherwise.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns: masked marks, odd separators, no international prefix.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?i:@|\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]++(?: ?(?i:\.|\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{2,}+){1,4}",
    "ip": r"(?<![0-9])[0-9]{1,3}(?: ?(?i:\.|\(\.\)|\[\.\]|\(dot\)|\[dot\]) ?[0-9]{1,3}){3}",
    "card": r"(?<![0-9])[0-9](?:[ ._/-]{0,2}[0-9]){12,18}",
    "phone": r"(?<![0-9])(?:\(?[0-9]{2,4}\)?[ .-]{1,2}){1,3}[0-9]{3,4}[ .-]?[0-9]{3,4}|(?<![0-9])00[0-9]{8,13}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]{0,40}[0-9])(?=[0-9_+/=-]{0,40}[A-Za-z])[A-Za-z0-9_+/=-]{16,}+",
}
#: What a text must hold for a kind's patterns to be tried at all.
GATES = {"email": r"@|(?i:[(\[{ ](?:at|dot)[)\]} ])", "ip": r"[0-9]", "card": r"[0-9]", "phone": r"[0-9]"}
#: The wide e-mail pattern is tried only where a mark that it accepts stands.
WIDE_GATES = {"email": r"@|(?i:[(\[{](?:at|dot)[)\]}]| at | dot )", "ip": r"[0-9]", "card": r"[0-9]", "phone": r"[0-9]", "secret": r"[0-9][A-Za-z]|[A-Za-z][0-9]"}
#: Words that name a kind, looked for in the CONTEXT characters before a span.
NAMED = {
    "email": r"(?i)mail|contact|write|reach",
    "ip": r"(?i)\bip\b|address|host|server|from",
    "card": r"(?i)card|visa|master|amex|credit|pay",
    "phone": r"(?i)phone|call|tel|mobile|fax|cell|contact|whatsapp|number|ring|dial|reach|text",
    "secret": r"(?i)token|secret|key|passw|pwd|auth|bearer|credential",
}
#: The end of an address, for a common top-level name: in any case behind a masked dot, else in small
#: letters behind a dot that ends no sentence (one with a space behind it has one before it too).
TLD = r"(?:(?i:[(\[{]dot[)\]}]| dot )\x20?(?i:{names})|(?:(?<!\x20)\.|\x20\.\x20|\x20\.)(?:{names}))$".replace("{names}", "com|org|net|edu|gov|info|biz|io|eu|uk|de|fr|es|it|nl|ch|at|jp|cn|hk")
#: A full stop within a span.
STOP = r"(?<!\x20)\.\x20"
#: Words that speak against personal data.
AGAINST = r"(?i)version|release|order|invoice|isbn|total|price|section|figure|page|build|serial|ticket|ref|part|id\b|no\.|#|\$|€"
CONTEXT = 24

#: Rows of the training sample, at most; half fits the trees, half sets thresholds.
SAMPLE = 6000
#: Documents whose words stand around the sample's spans, at most, and the characters taken of each.
CONTEXTS, CONTEXT_CHARS = 300, 600
PRECISION, MARGIN, MARGIN_PRECISION = 0.98, 40, 0.97
SEED = 2


# --- spans -----------------------------------------------------------------


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: inside a lambda, a plain expression is computed for each element."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine=lambda a, x: a + x, first: int = 0) -> Column:
    """``combine`` of all before each element, in blocks: no array is copied more than block by block. ``values`` must be a bound value."""
    block = 256
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / block) - 1, F.lit(0)).cast("int"))
    start = F.lit(first).cast("long")

    def before(some: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["at"])).alias("out"), combine(acc["at"], x).alias("at"))
        return F.aggregate(some, F.struct(F.expr("cast(array() as array<long>)").alias("out"), start.alias("at")), step)["out"]

    part = lambda b: F.slice(values, b * block + 1, F.lit(block))
    totals = F.transform(blocks, lambda b: F.aggregate(part(b), start, combine))
    return _let(before(totals, start), lambda firsts: F.flatten(F.transform(blocks, lambda b: before(part(b), F.get(firsts, b)))))


FAR = 1 << 40


def _met(ordered: Column, met: Column | None, keep) -> Column:
    """Elements x of ``ordered`` (bound, by start) for which keep(x, whether x overlaps another for which the field ``met`` holds, or any)."""
    told = lambda x, value: value if met is None else F.when(x[met], value).otherwise(F.lit(-FAR))
    ends = F.transform(ordered, lambda x: told(x, x["end"]))
    starts = F.transform(F.reverse(ordered), lambda x: told(x, -x["start"]))
    largest = lambda some: _let(some, lambda v: running(v, lambda a, x: F.greatest(a, x), -FAR))
    return _let(F.struct(largest(ends).alias("b"), F.reverse(largest(starts)).alias("a")), lambda n: F.filter(ordered, lambda x, i: keep(x, (F.get(n["b"], i) > x["start"]) | (-F.get(n["a"], i) < x["end"]))))


def clear_of(some: Column, others: Column) -> Column:
    """The spans (start, end, match) that overlap none of ``others`` (start, end)."""
    tagged = F.concat(
        F.transform(some, lambda s: F.struct(s["start"], s["end"], F.lit(False).alias("other"), s["match"].alias("match"))),
        F.transform(others, lambda s: F.struct(s["start"], s["end"], F.lit(True).alias("other"), F.lit("").alias("match"))),
    )
    cut = _let(F.array_sort(tagged), lambda a: _met(a, "other", lambda x, hit: ~x["other"] & ~hit))
    return F.when((F.size(some) == 0) | (F.size(others) == 0), F.transform(some, lambda s: F.struct(s["start"], s["end"], F.lit(False).alias("other"), s["match"].alias("match")))).otherwise(cut)


def likeliest(some: Column) -> Column:
    """Of spans (start, end, k, p) those that stay: the likeliest first, none that overlaps one that stays."""
    free = lambda a: _met(a, None, lambda x, hit: ~hit)
    contested = lambda a: _met(a, None, lambda x, hit: hit)
    ranked = lambda a: F.array_sort(F.transform(contested(a), lambda x: F.struct((-x["p"]).alias("q"), x["k"], x["start"], x["end"], x["p"])))
    none = F.slice(some, 1, F.lit(0))
    stay = lambda acc, x: F.when(F.exists(acc, lambda o: (o["start"] < x["end"]) & (x["start"] < o["end"])), acc).otherwise(F.concat(acc, F.array(F.struct(x["start"], x["end"], x["k"], x["p"]))))
    return F.when(F.size(some) < 2, some).otherwise(_let(F.array_sort(some), lambda a: F.concat(free(a), F.aggregate(ranked(a), none, stay))))


def spans(text: Column, pattern: str, gate: Column) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, match). The text is searched twice, however many there are."""
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,match:string>>)")

    def listed(cut: Column) -> Column:
        found = cut["found"]
        gaps = F.zip_with(found, F.slice(cut["between"], 1, F.size(found)), lambda m, b: (F.length(b) + F.length(m)).cast("long"))

        def placed(gaps: Column) -> Column:
            ends = F.zip_with(running(gaps), gaps, lambda s, g: s + g)
            return F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")))

        return F.when(F.size(found) > 0, _let(gaps, placed)).otherwise(none)

    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return F.when(gate, _let(cut, listed)).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string's Luhn sum is a multiple of ten."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        twice = F.pmod(n - i, F.lit(2)) == 1
        return F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.when(n > 0, F.pmod(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, i: a + worth(i)), F.lit(10)) == 0).otherwise(False)


def octets(match: Column) -> Column:
    """Whether every number of a match is at most 255."""
    numbers = F.transform(F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0)), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    return F.forall(numbers, lambda x: (F.length(x) <= 3) & (F.try_to_number(x, F.lit("999")) <= 255))


def valid(kind: str, match: Column) -> Column:
    """The check of a strict match."""
    if kind == "ip":
        return octets(match)
    if kind == "card":
        d = _digits(match)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


# --- features --------------------------------------------------------------

FEATURES = ("kind", "length", "digits", "separators", "kinds_of_separator", "groups", "starts_plus", "parens", "masked", "sure", "before", "after", "named", "against", "letters", "repeats", "shape", "stops")


def _class_of(c: Column) -> Column:
    """0 none, 1 white space, 2 letter, 3 digit, 4 joining sign, 5 other."""
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^\p{L}"), 2).when(c.rlike("^[0-9]"), 3).when(c.rlike(r"^[._/:@=-]"), 4).otherwise(5)


def features(kind: str, text: Column, span: Column) -> Column:
    """Struct of doubles that describes a proposed span."""
    m, start, end = span["match"], span["start"].cast("int"), span["end"].cast("int")
    ahead = F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
    digits = _digits(m)
    signs = F.regexp_extract_all(m, F.lit("[^A-Za-z0-9]+"), F.lit(0))
    groups = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    sure = {"card": luhn(digits), "ip": octets(m), "phone": F.length(digits).between(9, 13), "email": m.rlike(TLD), "secret": m.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$")}[kind]
    shape = {"card": F.when(F.forall(groups, lambda g: F.length(g) == 4), 2).when(F.size(groups) == 1, 1).otherwise(0), "phone": F.when(m.rlike(r"^\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$"), 2).when(m.rlike("^00"), 1).otherwise(0), "ip": F.size(F.filter(groups, lambda g: F.length(g) > 1)), "email": F.size(F.regexp_extract_all(m, F.lit(r"[A-Za-z0-9-]+"), F.lit(0))), "secret": m.rlike("[a-z]").cast("int") + m.rlike("[A-Z]").cast("int") + m.rlike("[_+/=-]").cast("int")}[kind]
    values = {
        "kind": F.lit(ADDED.index(kind)),
        "length": F.length(m),
        "digits": F.length(digits),
        "separators": F.size(signs),
        "kinds_of_separator": F.size(F.array_distinct(signs)),
        "groups": F.size(groups),
        "starts_plus": m.startswith("+").cast("int"),
        "parens": m.contains("(").cast("int"),
        "masked": m.rlike(r"(?i)[(\[{](?:at|dot|\.)[)\]}]").cast("int") + m.rlike("(?i) (?:at|dot) ").cast("int"),
        "sure": sure.cast("int"),
        "before": _class_of(F.substring(text, F.greatest(start, F.lit(1)), F.least(start, F.lit(1)))),
        "after": _class_of(F.substring(text, end + 1, F.lit(1))),
        "named": ahead.rlike(NAMED[kind]).cast("int"),
        "against": ahead.rlike(AGAINST).cast("int"),
        "letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")),
        "repeats": m.rlike(r"([0-9])\1{4,}").cast("int"),
        "shape": shape,
        "stops": F.size(F.regexp_extract_all(m, F.lit(STOP), F.lit(0))),
    }
    return F.struct(*[values[f].cast("double").alias(f) for f in FEATURES])


# --- boosted trees ---------------------------------------------------------


@dataclass
class Trees:
    """Trees as nested (feature, cut, left, right) or leaf values; and thresholds by kind."""

    base: float
    trees: list
    thresholds: dict[str, float]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += _walk(t, x)
        return out

    def column(self, f: Column) -> Column:
        """The probability, as one expression over a features struct."""

        def node(t) -> Column:
            if not isinstance(t, tuple):
                return F.lit(float(t))
            k, cut, left, right = t
            return F.when(f[FEATURES[k]] <= F.lit(float(cut)), node(left)).otherwise(node(right))

        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, map(node, self.trees), F.lit(self.base))))


def _walk(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    k, cut, left, right = tree
    return np.where(x[:, k] <= cut, _walk(left, x), _walk(right, x))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, least: int = 8, ridge: float = 1.0):
    """One tree on gradients and curvatures, by exact splits."""
    leaf = rate * g.sum() / (h.sum() + ridge)
    if not depth or len(x) < 2 * least:
        return float(leaf)
    best = (1e-3, None, None)
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        v, gs, hs = x[order, k], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at >= least - 1) & (at < len(x) - least)]
        if len(at):
            gain = gs[at] ** 2 / (hs[at] + ridge) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + ridge) - whole
            j = int(np.argmax(gain))
            if gain[j] > best[0]:
                best = (float(gain[j]), k, float((v[at[j]] + v[at[j] + 1]) / 2))
    if best[1] is None:
        return float(leaf)
    _, k, cut = best
    low = x[:, k] <= cut
    return (k, cut, _grow(x[low], g[low], h[low], depth - 1, rate, least, ridge), _grow(x[~low], g[~low], h[~low], depth - 1, rate, least, ridge))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3) -> Trees:
    """Gradient boosting of the logistic loss."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = Trees(float(np.log(share / (1 - share))), [], {})
    margin = model.margin(x)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, y - p, p * (1 - p), depth, rate)
        model.trees.append(tree)
        margin += _walk(tree, x)
    return model


# --- training sample -------------------------------------------------------


def _luhn_digits(r: random.Random, n: int) -> str:
    body = "".join(str(r.randrange(10)) for _ in range(n - 1))
    return body + str(-_luhn_sum(body + "0") % 10)


def _grouped(digits: str, sign: str) -> str:
    return sign.join(digits[i : i + 4] for i in range(0, len(digits), 4))


def _valid_luhn(digits: str) -> bool:
    return _luhn_sum(digits) % 10 == 0


def _luhn_sum(digits: str) -> int:
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))


def contexts(docs: DataFrame, n: int = CONTEXTS, chars: int = CONTEXT_CHARS) -> list[str]:
    """Words of at most ``n`` documents, those of the smallest hashes, in their order.

    A share of the hashes that holds about four times as many passes the scan, equal
    rows meet before they move, so what reaches the driver does not grow.
    """
    whole = 1 << 40
    share = min(1.0, 4 * n / max(1, docs.select(F.lit(1)).count()))
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(whole))
    some = docs.where("text is not null").select(h.alias("h"), F.substring("text", 1, chars).alias("t")).where(F.col("h") < max(1, int(share * whole)))
    rows = some.groupBy("h").agg(F.min("t").alias("t")).orderBy("h").limit(n).collect()
    return [w for r in rows for w in r.t.split()]


def _email(r: random.Random, yes: int, word) -> tuple[str, str]:
    end = r.choice(["com", "org", "net", "de", "co.uk", "io"])
    name = word() + r.choice(["", "." + word(), str(r.randrange(10, 99)), "_" + word()])
    if yes:
        at, dot = r.choice([" at ", "(at)", "[at]", " [at] ", " (at) ", " AT ", "{at}", " @ ", "@"]), r.choice([" dot ", "[dot]", "(dot)", " (dot) ", " . ", " [dot] "])
        return r.choice(["", "", "mail me: ", "contact ", "write to ", "e-mail "]), name + at + r.choice(["example", word()]) + dot + end
    opening = r.choice(["It", "At", "In", "Is", "No", "So", "To", "He", "We", "My", "Es", "De", "La", word().title()])
    return "", r.choice([f"{word()} at {word()}. {opening}", f"{word()} at {word()}. {word().title()}. {opening}", f"{opening} at {word()}. {opening}", f"{word()} at {word()}.{word()}", f"{word()} at {word()} dot {word()} ing", f"{word()} (at) {word()}.", f"{word()} at {word()}. {word().title()}", f"{word()} at {word()}.  {word()}", f"{word()}@{word()}. {word().title()}", f"at {word()}. {word()}"])


def _ip(r: random.Random, yes: int, word) -> tuple[str, str]:
    four = [str(r.randint(1, 254)) for _ in range(4)]
    if yes:
        sign = r.choice(["[.]", "(.)", "[dot]", "(dot)", " . ", " [.] "])
        return r.choice(["", "ip ", "host ", "server ", "from "]), r.choice([sign.join(four), ".".join(four[:3]) + sign + four[3]])
    some = lambda a, b: str(r.randint(a, b))
    return r.choice(["", "version ", "section ", "release "]), r.choice([".".join(some(0, 30) for _ in range(5)), ". ".join(some(1, 999) for _ in range(4)), f"{some(300, 999)}.{some(0, 999)}.{some(0, 999)}.{some(0, 999)}", f"{some(1, 9)}. {some(1, 99)}. {some(1, 99)}. {some(1, 99)}"])


def _card(r: random.Random, yes: int, word) -> tuple[str, str]:
    n = r.choice([13, 15, 16, 16, 16])
    if yes:
        d = _luhn_digits(r, n)
        amex = f"{d[:4]} {d[4:10]} {d[10:]}" if n == 15 else d
        span = r.choice([_grouped(d, "."), _grouped(d, "  "), _grouped(d, "/"), _grouped(d, "_"), amex if n < 16 else _grouped(d, " -")])
        return r.choice(["card ", "visa ", "credit card ", "pay with ", "" if n == 16 else "amex "]), span
    d = "".join(r.choice("0123456789") for _ in range(r.choice([13, 14, 15, 16, 17, 19])))
    while _valid_luhn(d):
        d = str(r.randrange(10 ** (len(d) - 1), 10 ** len(d)))
    part = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    stamp = f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {r.randint(0, 23):02d}-{r.randint(0, 59):02d}-{r.randint(0, 59):02d}"
    return r.choice(["", "order ", "invoice ", "serial ", "id ", "ref ", "isbn "]), r.choice([d, _grouped(d, "."), _grouped(d, " "), stamp, ".".join(part(3) for _ in range(5)), f"978-{part(1)}-{part(4)}-{part(4)}-{part(1)}"])


def _phone(r: random.Random, yes: int, word) -> tuple[str, str]:
    part = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    a, b, c = str(r.randint(201, 989)), part(3), part(4)
    if yes:
        span = r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{r.randint(1, 9)}{part(10)}", f"00{r.randint(20, 99)} {r.randint(20, 99)} {part(3)}{part(4)}", f"0{r.randint(20, 99)} {part(4)} {part(4)}"])
        cue = r.choice(["call ", "phone ", "tel. ", "mobile: ", "fax ", "contact ", "my number is ", "ring ", "text me on ", "reach me: "])
        return (r.choice(["", cue]) if span.startswith("(") else cue), span
    stamp = f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"
    return r.choice(["", "", "price ", "order ", "total ", "part no. ", "id "]), r.choice([f"{stamp} {r.randint(1000, 9999)}", f"{part(2)}.{part(3)}.{part(3)}", f"{part(3)} {part(3)} {part(3)}", f"{part(2)}-{part(3)}-{part(4)}", f"{a}-{b}-{c}", f"{a} {b} {c}"])


def _secret(r: random.Random, yes: int, word) -> tuple[str, str]:
    pick = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    hexes, mixed = "0123456789abcdef", "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"
    if yes:
        span = r.choice([pick(hexes, r.choice([32, 40, 64])), pick(mixed, r.choice([20, 24, 32, 40])), r.choice(["sk-", "ghp_", "key-", "AKIA"]) + pick(mixed, r.choice([16, 24, 36])), pick(mixed + "+/", 43) + "="])
        return r.choice(['token = "', "token: ", "api_key=", "secret ", "password: ", "Authorization: Bearer ", "key = '", "auth "]), span
    return r.choice(["", "", "see ", "version ", "file ", "the "]), r.choice([f"{word()}-{word()}-{r.randint(1990, 2030)}-{word()}", f"{word()}_{word()}_{r.randint(1, 99)}_{word()}", f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{r.randint(10, 23)}", f"{word()}/{word()}/{r.randint(1, 999)}/{word()}", word() * 3 + str(r.randint(1, 99))])


_MAKERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "secret": _secret}


def sample(n: int = SAMPLE, seed: int = SEED, words: list[str] | None = None) -> list[tuple[str, str, int]]:
    """(kind, text, label) rows made by rule, at most ``n``, between some of ``words`` (made-up ones without)."""
    r = random.Random(seed)
    made = lambda: "".join(r.choice("abcdefghilmnoprstuw") for _ in range(r.randint(2, 9)))
    prose = [w for w in words or [] if not any(c.isdigit() for c in w)]
    plain = [w for w in prose if w.isascii() and w.isalpha()]
    word = lambda: r.choice(plain).lower() if plain and r.random() < 0.5 else made()

    def run(k: int) -> str:
        at = r.randrange(max(1, len(prose) - k))
        return " ".join(prose[at : at + k]) if len(prose) > k else " ".join(made() for _ in range(k))

    # The documents' own prose: around "at", and across full stops; masked addresses are left out.
    own = [k for k, w in enumerate(prose) if w.lower() == "at" or w.endswith(".")]
    own = [" ".join(prose[max(0, k - 4) : k + 6]) for k in own]
    own = [t for t in own if " at " in f" {t.lower()} " and not re.search(r"(?i)@|dot|[(\[{]|at [^ ]+\.[a-z]", t)]
    rows: list[tuple[str, str, int]] = []
    while len(rows) < n:
        kind, label = r.choice(ADDED), r.randrange(2)
        if kind == "email" and not label and own and r.random() < 0.5:
            rows.append((kind, r.choice(own), 0))
            continue
        cue, span = _MAKERS[kind](r, label, word)
        stick = r.choice([" "] * 9 + ["", "=", "x"]) if not label else r.choice([" ", " ", " ", ": ", "\n"])
        if kind == "secret" and not cue.endswith(" "):
            stick = ""
        close = cue.strip()[-1:] if cue.strip()[-1:] in "\"'" else ""
        lead = f"{run(r.randint(2, 6))} {cue}"
        lead = lead if kind == "secret" and not stick else lead.rstrip()
        rows.append((kind, lead + stick + span + close + r.choice([" ", " ", ". ", ", "] if label else [" ", ". ", "-", "x ", " "]) + run(r.randint(1, 4)), label))
    return rows


_TRAINED: dict[tuple, Trees] = {}


def train(spark: SparkSession, docs: DataFrame | None = None, n: int = SAMPLE, seed: int = SEED, precision: float = PRECISION) -> Trees:
    """Trees and thresholds from ``sample`` between words of ``docs``; features come from the same SQL as in use."""
    words = contexts(docs) if docs is not None else None
    key = (n, seed, precision, tuple(words or ()))
    if key in _TRAINED:
        return _TRAINED[key]
    rows = sample(n, seed, words)
    table = spark.createDataFrame([(i, k, t, y) for i, (k, t, y) in enumerate(rows)], "row int, kind string, text string, label int")
    proposed = table.select("row", "label", "kind", F.explode(proposals(F.col("text"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"))).alias("s"))
    own = F.get(F.array(*[F.lit(k) for k in ADDED]), F.col("s.k"))
    # A proposal of a kind that the row was not made for is not personal data of that kind.
    found = sorted((r.row, r.own, r.start, r.label if r.own == r.kind else 0, [r.f[c] for c in FEATURES]) for r in proposed.select("row", own.alias("own"), "kind", "label", "s.start", "s.f").collect())
    x, y = np.array([f for *_, f in found]), np.array([label for *_, label, _ in found], float)
    half = np.array([row % 2 == 0 for row, *_ in found])
    model = fit(x[half], y[half])
    p = 1 / (1 + np.exp(-model.margin(x[~half])))
    held, kinds = y[~half], np.array([k for _, k, *_ in found])[~half]
    for kind in ADDED:
        mine = np.flatnonzero(kinds == kind)
        order = mine[np.argsort(-p[mine], kind="stable")]
        right = np.cumsum(held[order]) / np.arange(1, len(order) + 1)
        # Of the rows next above: scores may be told apart only by lots of rows.
        near = np.convolve(held[order], np.ones(MARGIN), "full")[: len(order)] / np.minimum(np.arange(1, len(order) + 1), MARGIN)
        good = np.flatnonzero((right >= precision) & (near >= MARGIN_PRECISION))
        model.thresholds[kind] = float(p[order[good[-1]]]) if len(good) else 2.0
    if len(_TRAINED) >= 8:
        _TRAINED.clear()
    _TRAINED[key] = model
    return model


# --- the operator ----------------------------------------------------------


def proposals(text: Column, base: Column) -> Column:
    """Wide matches of every kind that touch no base span: array of (start, end, k, f)."""
    found = []
    for kind in ADDED:
        wide = spans(text, WIDE[kind], text.rlike(WIDE_GATES[kind]))
        found.append(F.transform(_let(wide, lambda w: clear_of(w, base)), _described(kind, text)))
    return F.concat(*found)


# Factories bind a kind: a lambda for SQL may have no parameters of its own.


def _checked(kind: str):
    return lambda s: valid(kind, s["match"])


def _described(kind: str, text: Column):
    return lambda s: F.struct(s["start"], s["end"], F.lit(ADDED.index(kind)).alias("k"), features(kind, text, s).alias("f"))


def _marked(kind: str):
    return lambda s: F.struct(s["start"], s["end"], F.lit(f"[{kind.upper()}]").alias("mark"))


def _written(kind: str):
    return lambda s: F.concat(F.lit(f"{kind}:"), s["start"], F.lit(":"), s["end"])


def _of_kind(number: int):
    return lambda s: s["k"] == number


def with_spans(df: DataFrame, text: str, model: Trees, prefix: str) -> DataFrame:
    """``df`` with the arrays ``<prefix>base_<kind>`` and ``<prefix>more_<kind>`` of (start, end)."""
    t = F.coalesce(F.col(text), F.lit(""))
    searched, candidates, sure = f"{prefix}searched", f"{prefix}candidates", f"{prefix}sure"
    any_gate = "|".join(dict.fromkeys([*GATES.values(), *WIDE_GATES.values()]))
    out = df.withColumn(searched, F.when(t.rlike(any_gate), t).otherwise(F.lit("")))
    st = F.col(searched)
    out = out.withColumns({f"{prefix}base_{k}": F.transform(F.filter(spans(st, STRICT[k], st.rlike(GATES[k])), _checked(k)), lambda s: F.struct(s["start"], s["end"])) for k in KINDS})
    out = out.withColumn(candidates, proposals(st, F.concat(*(F.col(f"{prefix}base_{k}") for k in KINDS))))
    out = out.withColumn(candidates, F.transform(candidates, lambda s: F.struct(s["start"], s["end"], s["k"], model.column(s["f"]).alias("p"))))
    limits = F.array(*[F.lit(float(model.thresholds[k])) for k in ADDED])
    out = out.withColumn(sure, F.filter(candidates, lambda s: s["p"] >= F.get(limits, s["k"])))
    out = out.withColumn(sure, likeliest(F.col(sure)))
    out = out.withColumns({f"{prefix}more_{k}": F.transform(F.filter(sure, _of_kind(n)), lambda s: F.struct(s["start"], s["end"])) for n, k in enumerate(ADDED)})
    return out.drop(searched, candidates, sure)


def _listed(arrays: list[tuple[str, Column]]) -> Column:
    parts = [F.transform(F.array_sort(a), _written(kind)) for kind, a in arrays]
    return F.array_join(F.concat(*parts), ",")


def find(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """doc_id, base counts, the base spans' digest, all spans (secrets last), counts of those added, and secrets again by themselves."""
    model = model or train(docs.sparkSession, docs)
    found = with_spans(documents(docs), "text", model, "_")
    base = [(k, F.col(f"_base_{k}")) for k in KINDS]
    every = [*((k, F.concat(f"_base_{k}", f"_more_{k}")) for k in KINDS), ("secret", F.col("_more_secret"))]
    more = [F.size(f"_more_{k}").cast("long") for k in ADDED]
    return found.select(
        "doc_id",
        *[F.size(c).cast("long").alias(f"n_{k}") for k, c in base],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(every).alias("spans"),
        *[c.alias(f"n_more_{k}") for k, c in zip(KINDS, more, strict=False)],
        more[-1].alias("n_secret"), _listed([("secret", F.col("_more_secret"))]).alias("secrets"),
        sum([F.size(c).cast("long") for _, c in base], sum(more[1:], more[0])).alias("n_spans"),
    )


def redact(docs: DataFrame, model: Trees | None = None, length: str | None = "n_chars") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; ``length`` is set anew where the table has it."""
    model = model or train(docs.sparkSession, docs)
    prefix = fresh_name(docs, "pii_")
    found = with_spans(docs, "text", model, prefix)
    spanned = F.flatten(F.array(*[F.transform(F.concat(f"{prefix}base_{k}", f"{prefix}more_{k}") if k in KINDS else F.col(f"{prefix}more_{k}"), _marked(k)) for k in ADDED]))
    ordered = F.array_sort(spanned)
    # Kinds may overlap (a phone number within a card's digits): the earlier span hides what it covers.
    step = lambda acc, s: F.struct(
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), s["mark"]))).otherwise(acc["out"]).alias("out"),
        F.greatest(acc["at"], s["end"]).alias("at"),
    )
    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit(0).cast("long").alias("at"))
    cut = F.aggregate(ordered, start, step)
    clean = F.when(F.size(ordered) > 0, F.concat(F.array_join(cut["out"], ""), F.substring(F.col("text"), (cut["at"] + 1).cast("int"), F.length("text")))).otherwise(F.col("text"))
    changed = found.withColumn("text", clean)
    if length and length in docs.columns:
        changed = changed.withColumn(length, F.when(F.size(ordered) > 0, F.length("text").cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return changed.select(*docs.columns)
