"""Text functions: normal forms, word signatures, URLs, keys."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words without topical weight in headlines, and those of company news besides.
STOPWORDS = """
a an the and or but if then than that this these those of in on at to for from by with
is are was were be been being as it its he she they them his her their we our you your
new now says say said report reports amid over after before into out up down about
""".split()
COMPANY_STOPWORDS = "stock stocks shares share inc corp ltd plc holdings group company co".split()
# Query parameters that only track readers.
FEED_TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "cmpid")
NEWS_TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "cmpid", "icid", "at_medium", "at_campaign", "ncid", "guccounter")
# Outlets that report themselves, and those that republish.
WIRES = ("reuters", "bloomberg", "associated press", "ap", "dow jones", "the wall street journal", "wall street journal", "wsj", "financial times", "ft", "barron's", "barrons", "cnbc", "the information", "nikkei", "south china morning post", "scmp", "the new york times", "washington post", "axios", "the economist")
AGGREGATORS = ("marketbeat", "marketbeat.com", "simply wall st", "simplywall.st", "24/7 wall st.", "24/7 wall st", "247wallst.com", "zacks", "zacks investment research", "insider monkey", "gurufocus", "tipranks", "invezz", "stocktwits", "the motley fool", "motley fool", "investorplace", "benzinga", "etf daily news", "americanbankingnews", "defense world", "modern readers", "ticker report", "msn")

_TOKEN = r"[0-9a-z㐀-鿿]+(?:-[0-9a-z㐀-鿿]+)*"


def normal_keyword(text: Column) -> Column:
    """Lower case; anything but digits, a-z and Han becomes one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^0-9a-z一-鿿]+", " "))


def _icu(cls: str, method: str, text: Column) -> Column:
    """A text through a static ICU function of (text, true), in the JVM; null stays null."""
    return F.when(text.isNotNull(), F.java_method(F.lit(f"com.ibm.icu.{cls}"), F.lit(method), F.coalesce(text, F.lit("")), F.lit(True)))


def casefold(text: Column) -> Column:
    """Full case folding: unlike lower case, ``ß`` is ``ss``."""
    return _icu("lang.UCharacter", "foldCase", text)


def _collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]+", " "))


def _combining() -> str:
    """A class of all characters with a combining class, as the Unicode database has them."""
    marks = [c for c in range(0x110000) if unicodedata.combining(chr(c))]
    starts = [c for c in marks if not unicodedata.combining(chr(c - 1))]
    ends = [c for c in marks if not unicodedata.combining(chr(c + 1))]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{z:x}}}" for a, z in zip(starts, ends, strict=True)) + "]"


def normal_title(text: Column) -> Column:
    """NFKC, case-folded, white space collapsed (feeds)."""
    return _collapsed(casefold(_icu("text.Normalizer", "compose", text)))


def plain_title(text: Column) -> Column:
    """NFKD without marks, case-folded, white space collapsed (company news)."""
    return _collapsed(casefold(F.regexp_replace(_icu("text.Normalizer", "decompose", text), COMBINING, "")))


COMBINING = _combining()


@F.pandas_udf(T.StringType())
def _unescaped(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(html.unescape, na_action="ignore")


def unescaped(text: Column) -> Column:
    """HTML entities resolved; only texts with an ampersand leave the JVM."""
    return F.coalesce(_unescaped(F.when(F.contains(text, F.lit("&")), text)), text)


@F.pandas_udf(T.StringType())
def _charsets(content: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def one(raw: bytes | None, stated: str | None) -> str | None:
        if raw is None:
            return None
        for charset in (stated, *CHARSETS):
            try:
                return raw.decode(charset)
            except (UnicodeDecodeError, LookupError, TypeError):  # wrong, unknown or not stated
                continue
        return raw.decode("utf-8", errors="replace")

    for raw, stated in content:
        yield pd.Series([one(r, c) for r, c in zip(raw, stated, strict=True)], dtype=object)


# The charsets tried after the stated one, in this order.
CHARSETS = ("utf-8", "big5", "gb18030")


def decoded(content: Column, charset: Column) -> Column:
    """Bytes as text: by the stated charset, else the first of CHARSETS that fits, else UTF-8 with marks for what it lacks.

    Valid UTF-8 that is said to be so, or of which nothing is said, stays in the JVM.
    """
    plain = F.is_valid_utf8(content.cast("string")) & F.upper(F.coalesce(charset, F.lit(""))).isin("UTF-8", "UTF8", "")
    return F.when(plain, content.cast("string")).otherwise(_charsets(F.when(~plain, content), charset))


def ascii_title(text: Column) -> Column:
    """The normal title of ASCII text, in the JVM."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def clean_text(text: Column, entities: bool = True) -> Column:
    """Entities resolved, white space collapsed, no gap before punctuation; empty is null."""
    base = unescaped(text) if entities else text
    tight = F.regexp_replace(F.regexp_replace(base, r"\s+", " "), r" ([,.;:!?])", "$1")
    return F.nullif(F.trim(tight), F.lit(""))


def signature(normal: Column, company: bool = False) -> Column:
    """Significant words of a normal title, sorted; all words where none is significant."""
    stop = STOPWORDS + (COMPANY_STOPWORDS if company else [])
    words = F.array_distinct(F.regexp_extract_all(normal, F.lit(_TOKEN), F.lit(0)))
    # A title is taken apart once: what stands inside an array is computed before its lambda looks at it.
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    kept = lambda ws: F.filter(ws, lambda w: ~w.isin(stop) & (F.length(w) > 1))
    return once(words, lambda ws: once(kept(ws), lambda ks: F.sort_array(F.when(F.size(ks) > 0, ks).otherwise(ws))))


def overlap(a: Column, b: Column) -> Column:
    """Shared words over the smaller set; 0 where either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def _rebuilt(url: Column, query: Column, path: Column) -> Column:
    base = F.concat(F.lower(F.parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), F.lower(F.parse_url(url, F.lit("AUTHORITY"))), path)
    return F.when(query != "", F.concat(base, F.lit("?"), query)).otherwise(base)


def _kept_query(url: Column, drop) -> Column:
    parts = F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&")
    return F.array_join(F.filter(parts, lambda p: (p != "") & ~drop(F.substring_index(p, "=", 1))), "&")


def canonical_feed_url(url: Column) -> Column:
    """No fragment, no tracking parameters (case-sensitive names, any ``utm_``); the path stays."""
    query = _kept_query(url, lambda k: k.startswith("utm_") | k.isin(list(FEED_TRACKING)))
    return F.when(F.try_parse_url(url, F.lit("HOST")).isNull(), url).otherwise(_rebuilt(url, query, F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit(""))))


def canonical_news_url(url: Column) -> Column:
    """No fragment, no listed tracking parameters in any case, no slash at the end."""
    query = _kept_query(url, lambda k: F.lower(k).isin(list(NEWS_TRACKING)))
    path = F.regexp_replace(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    return F.when(F.try_parse_url(url, F.lit("HOST")).isNull(), url).otherwise(_rebuilt(url, query, path))


def domain_of(url: Column, unknown: str | None = None) -> Column:
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    return F.coalesce(host, F.lit(unknown or ""))


def item_key(source: Column, url: Column, title: Column) -> Column:
    return F.sha1(F.concat_ws("|", source, url, title))


def dedupe_key(merchant: Column, title: Column, day: Column) -> Column:
    return F.sha1(F.concat_ws("|", ascii_title(merchant), ascii_title(title), day.cast("string")))


def url_hash(url: Column) -> Column:
    return F.sha2(canonical_news_url(url), 256)


def without_outlet(title: Column, outlet: Column) -> Column:
    """The title without `` - Outlet`` at its end."""
    tail = F.concat(F.lit(" - "), outlet)
    return F.when(F.endswith(title, tail), F.rtrim(F.left(title, F.length(title) - F.length(tail)))).otherwise(title)


def outlet_name(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), "’ʼ", "''")


def redact(text: Column, secrets: list[str]) -> Column:
    for s in secrets:
        text = F.replace(text, F.lit(s), F.lit("***"))
    return text
