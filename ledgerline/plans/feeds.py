"""News, pages, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, text
from ..operators import cluster, scans
from ..session import read
from ..sources import extract
from ..staging import stash
from . import adapters as a
from .registry import query

N = "v_news"
_FEED_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


@query(a.with_views("select id, 'https://www.' || source || '.example.com/' || cast(id as varchar) || '/?id=' || cast(id as varchar) as feed_url, 'https://www.' || source || '.example.com/' || cast(id as varchar) || '?id=' || cast(id as varchar) as news_url from v_news", N))
def canonical_url(spark, sf):
    n = a.news(spark, sf)
    return n.select("id", text.canonical_feed_url(F.col("url")).alias("feed_url"), text.canonical_news_url(F.col("url")).alias("news_url"))


@query("select page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', '') as domain from pages")
def domain_of(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.domain_of(F.col("url")).alias("domain"))


@query(a.with_views("select id, sha1(source || '|' || url || '|' || title) as key, sha256('https://www.' || source || '.example.com/' || cast(id as varchar) || '?id=' || cast(id as varchar)) as url_hash from v_news", N))
def item_key(spark, sf):
    n = a.news(spark, sf)
    return n.select("id", text.item_key(F.col("source"), F.col("url"), F.col("title")).alias("key"), text.url_hash(F.col("url")).alias("url_hash"))


_SIGNED = f", n as (select id, source, category, list_distinct(regexp_extract_all(trim(regexp_replace(lower(title), '\\s+', ' ', 'g')), '[0-9a-z㐀-鿿]+(?:-[0-9a-z㐀-鿿]+)*')) as w from v_news), s as (select id, source, category, list_sort(case when len(list_filter(w, lambda x: x not in ({_FEED_STOP}) and len(x) > 1)) > 0 then list_filter(w, lambda x: x not in ({_FEED_STOP}) and len(x) > 1) else w end) as words from n)"


def _signed(spark, sf):
    n = a.news(spark, sf)
    return n.select("id", "source", "category", "title", "url", text.signature(text.ascii_title(F.col("title"))).alias("words"))


@query(a.with_views(_SIGNED + " select id, array_to_string(words, ' ') as signature from s", N))
def title_signature(spark, sf):
    return _signed(spark, sf).select("id", F.array_join("words", " ").alias("signature"))


_PAIRED = _SIGNED + ", e as (select * from s where len(words) >= 2), p as (select x.id as a, y.id as b, len(list_intersect(x.words, y.words)) / least(len(x.words), len(y.words)) as overlap from e x join e y on x.category = y.category and x.id < y.id where len(list_intersect(x.words, y.words)) / least(len(x.words), len(y.words)) >= {0})"


_SETS = _SIGNED + ", e as (select category, words, min(id) as first, count(*) as n from s where len(words) >= 2 group by 1, 2)"


@query(a.with_views(_SETS + " select x.first as a, y.first as b, x.n as n_a, y.n as n_b, len(list_intersect(x.words, y.words)) / least(len(x.words), len(y.words)) as overlap from e x join e y on x.category = y.category and x.first < y.first where len(list_intersect(x.words, y.words)) / least(len(x.words), len(y.words)) >= 0.5 union all select e.first, s.id, e.n, e.n, 1.0 from e join s on e.category = s.category and e.words = s.words where s.id <> e.first", N))
def overlap_pairs(spark, sf):
    """Pairs of different titles of one category that share half of the smaller one's words, by their first items, with how often each occurs; and each further item of a title beside its first."""
    return cluster.pairs_and_members(_signed(spark, sf), "category", 0.5)


#: An item is of the cluster of its first match, and so on down: the least id that a way of ever earlier matches reaches.
_STORIES = ", reach as (select id, id as reached from s union select r.id, p.a from reach r join p on p.b = r.reached), c as (select id, min(reached) as story_id from reach group by 1)"


def _recursive(sql: str) -> str:
    return a.with_views(_PAIRED.replace("{0}", "0.7") + _STORIES + sql, N).replace("with ", "with recursive ", 1)


@query(_recursive(" select id, story_id from c"))
def cluster_stories(spark, sf):
    return cluster.cluster(_signed(spark, sf), "category")


@query(_recursive(" select id, story_id from c"))
def stories_extended(spark, sf):
    """Two scans: the later titles are placed behind the earlier ones, whose stories stay."""
    n = stash(_signed(spark, sf).drop("title"), "signed-titles")
    cut = n.agg(F.percentile_approx("id", 0.7).alias("cut"))
    sided = n.join(F.broadcast(cut)).withColumn("later", F.col("id") > F.col("cut")).drop("cut")
    first, later = sided.where("not later").drop("later"), sided.where("later").drop("later")
    stored = stash(first.join(cluster.cluster(first, "category"), "id"), "stored-stories")
    return stored.select("id", "story_id").unionByName(cluster.extend(stored, later, "category"))


@query(_recursive(", j as (select c.story_id, n.id, n.source, n.title, n.source || '.example.com' as domain from c join v_news n using (id)), f as (select story_id, domain, min(id) as first_id from j group by 1, 2), g as (select story_id, string_agg(domain, ',' order by first_id) as domains from f group by 1) select j.story_id, count(*) as n, count(distinct source) as n_sources, string_agg(cast(id as varchar), ',' order by id) as ids, any_value(domains) as domains, arg_min(title, id) as title from j join g using (story_id) group by 1"))
def story_domains(spark, sf):
    n = _signed(spark, sf).withColumn("domain", text.domain_of(F.col("url")))
    found = cluster.stories(n, cluster.cluster(n, "category"))
    return found.withColumns({"ids": F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), "domains": F.array_join("domains", ",")})


#: Headlines with their class, one for each way in which a class is told, for the documents' titles are not in English.
_TOLD = {
    "noise": ("5 top stocks to own now", "Better buy: Acme or Bolt", "Acme vs. Bolt", "Should you buy Acme", "Is it time to worry", "A bold prediction for Acme", "Where will Acme be in a year", "A buy-rated name", "Best chip stocks of the year", "The millionaire-maker share", "A multi-billionaire adds more", "Meet the new Acme", "The daughter of the founder speaks", "Acme shares acquired by Bolt Fund", "Bolt Fund trims Acme stake", "Bolt takes a new position in Acme", "Bolt makes a new investment", "Bolt has a stock position in Acme", "A position in Acme held by Bolt LLC", "Short interest grows in Acme", "Acme at a 52-week low", "Bolt LLC buys more Acme", "Acme earnings preview", "Countdown to the launch", "Ahead of Acme earnings day", "What to watch in chips", "Acme nears buy point", "Weekly wrap for chips", "A deep dive into Acme", "Stock forecasts for Acme", "Three things to know of Acme", "This could send the stock higher", "An event on chips", "Why Acme matters", "Chip market size forecast to 2030", "Growth at a CAGR of ten", "Chip market to reach new highs", "12 billion chip market", "Global chip market report", "", "   "),
    "guidance": ("Acme raises full-year outlook", "Acme guidance was raised", "Acme warns on demand", "Acme in profit warning"),
    "earnings": ("Acme beats estimates", "Acme Q3 revenue is here", "Acme posts a loss", "Acme sees record quarter", "Acme revenue rose sharply"),
    "ma": ("Acme to acquire Bolt", "Acme agrees to buy Bolt", "Acme in talks on a stake", "Fund discloses a stake in Acme", "Acme plans a spin-off", "Acme divests a unit"),
    "legal_regulatory": ("SEC opens probe into Acme", "Ministry launches an investigation", "New export controls for chips", "Tariffs hit Acme", "Acme settlement reached", "Regulator approves FDA plan", "City bans Acme scooters"),
    "contract": ("Acme wins a navy order", "A US$3 billion order for Acme", "Acme partners with Bolt", "Acme in partnership talks", "Acme supply agreement stands"),
    "capital": ("Acme starts a buyback", "Acme dividend increases again", "Acme offering of notes", "Acme stock split is on", "Acme lock-up ends", "Acme shares may be subject to a charge", "Acme IPO is near", "Acme convertible notes out"),
    "insider": ("Acme director offloads shares of his", "Insider selling at Acme", "Acme files form 4"),
    "leadership": ("Acme CEO steps down", "Acme appoints chief of staff", "Executive shake-up at Acme"),
    "product": ("Acme unveils a chip", "Acme next-gen wafers", "Acme rolls out fibre", "Acme begins shipping"),
    "analyst": ("Bank downgrades Acme", "New price target for Acme", "Bank cuts Acme PT", "Acme keeps its buy rating"),
    "price_move": ("Acme stock slides", "Acme surges by 12.5%", "Acme hits a record high", "Acme has doubled", "Acme trades at 20% below peers"),
    "unclassified": ("Acme holds a meeting", "Acme opens a canteen", "Börse öffnet"),
}
_TITLES = [(title, name) for name, titles in _TOLD.items() for title in titles]
_HEAD = "h as (select p_partkey as id, (['" + "','".join(name for _, name in _TITLES) + f"'])[p_partkey % {len(_TITLES)} + 1] as event_class from part)"


def _headlines(spark, sf):
    p = read(spark, sf, "part")
    title = F.element_at(F.array(*[F.lit(t) for t, _ in _TITLES]), (F.col("p_partkey") % len(_TITLES) + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("id"), title.alias("title"))


@query(f"with {_HEAD} select id, event_class from h")
def classify_headline(spark, sf):
    return _headlines(spark, sf).select("id", classify.classify(F.col("title")).alias("event_class"))


_WEIGHT = "case event_class " + " ".join(f"when '{k}' then {v}" for k, v in classify.CLASS_WEIGHTS.items()) + " end"


@query(f"with {_HEAD}, t as (select id, event_class, {_WEIGHT} + case when id % 3 = 0 then 12 else 0 end + case when id % 3 = 0 then 6 else 0 end - case when id % 3 = 1 then 18 else 0 end + case when id % 5 = 0 then 15 else 0 end - case when id % 7 = 0 then 12 else 0 end as raw from h), s as (select id, event_class, case when event_class = 'noise' then 0 else greatest(0, least(100, case when event_class = 'price_move' then least(raw, 64) else raw end)) end as score from t) select id, event_class, cast(score as integer) as score, case when score >= 65 then 'high' when score >= 35 then 'medium' else 'low' end as band from s")
def materiality_score(spark, sf):
    h = _headlines(spark, sf).withColumn("event_class", classify.classify(F.col("title")))
    sources = F.when(F.col("id") % 3 == 0, F.array(F.lit("Reuters"), F.lit("Zacks"))).when(F.col("id") % 3 == 1, F.array(F.lit("Zacks"))).otherwise(F.array(F.lit("Gazette")))
    out = h.withColumn("v", classify.assess(F.col("event_class"), sources, F.col("id") % 5 == 0, F.when(F.col("id") % 7 == 0, "PEER")))
    return out.select("id", "event_class", "v.score", "v.band")


@query(f"with {_HEAD} select event_class, event_class in ('noise', 'price_move', 'unclassified') as suppressed, count(*) as n from h group by 1, 2")
def suppression_breakdown(spark, sf):
    h = _headlines(spark, sf).select(classify.classify(F.col("title")).alias("event_class"))
    return h.groupBy("event_class", classify.suppressed(F.col("event_class")).alias("suppressed")).agg(F.count("*").alias("n"))


@query("select p_partkey as id, regexp_matches(lower(p_name), '\\b(' || 'steel' || ')\\b') as subject from part")
def subject_gate(spark, sf):
    p = read(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), classify.mentions(F.col("p_name"), F.lit("ZZZZ"), F.array(F.lit("steel"))).alias("subject"))


@query(f"with {_HEAD}, s as (select id as story_id, {_WEIGHT} as score from h), r as (select *, row_number() over (order by score desc, story_id) as rank, count(*) over () as n from s) select story_id, score, cast(rank as integer) as rank, greatest(n - 12, 0) as held from r where rank <= 12")
def ranked_stories(spark, sf):
    w = F.create_map(*[x for k, v in classify.CLASS_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    s = _headlines(spark, sf).select(F.col("id").alias("story_id"), F.element_at(w, classify.classify(F.col("title"))).alias("score"))
    return cluster.ranked(s)


@query(r"select page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) as title from pages where regexp_matches(html, '(?s)<title>.+?</title>')")
def page_titles(spark, sf):
    p = read(spark, sf, "pages")
    found = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1), r"\s+", " "))
    return p.where(F.col("html").rlike(r"(?s)<title>.+?</title>")).select("page_id", found.alias("title"))


def _tags(html: str) -> str:
    for tag in extract.CHROME:
        html = rf"regexp_replace({html}, '(?is)<{tag}\b.*?</{tag}\s*>', ' ', 'g')"
    html = rf"regexp_replace({html}, '(?s)<!--.*?-->|<![^>]*>', ' ', 'g')"
    return rf"substr(trim(regexp_replace(regexp_replace({html}, '(?s)<[^>]+>', ' ', 'g'), '[ \t\n\x0b\x0c\r]+', ' ', 'g')), 1, 4000)"


@query(f"select page_id, {_tags('html')} as detail from pages")
def readable_text(spark, sf):
    return read(spark, sf, "pages").select("page_id", extract.readable_text(F.col("html")).alias("detail"))


#: Up to 40 links of a page's list; a title is trimmed, a link without a host is the page's.
_LINKS = r"""with x as (select page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as origin, unnest(regexp_extract_all({html}, '<li><a href="([^"]*)">(.*?)</a>', 1)[1:40]) as link, unnest(regexp_extract_all({html}, '<li><a href="([^"]*)">(.*?)</a>', 2)[1:40]) as raw, generate_subscripts(regexp_extract_all({html}, '<li><a href="([^"]*)">(.*?)</a>', 1)[1:40], 1) - 1 as position from pages)
select cast(page_id as varchar) as source, cast(position as integer) as position, trim(regexp_replace(raw, '\s+', ' ', 'g')) as title, cast(null as varchar) as summary, cast(null as varchar) as date_text, origin || link as url from x where trim(raw) <> ''"""


@query(_LINKS.replace("{html}", "html"))
def listing_items(spark, sf):
    pages = read(spark, sf, "pages").select(F.col("page_id").cast("string").alias("source"), "url", F.col("html").alias("body"))
    return extract.listing_items(pages, {"list": "nav li", "title": "a", "link": "a@href"})


@query(_LINKS.replace("{html}", "html"))
def pattern_items(spark, sf):
    pages = read(spark, sf, "pages").select(F.col("page_id").cast("string").alias("source"), "url", F.col("html").alias("body"))
    return extract.pattern_items(pages, r"<li><a href=\"([^\"]*)\">(.*?)</a>", {"link": 1, "title": 2})


@query("with s as (select distinct source from documents), r as (select *, row_number() over (order by source) as rank from s) select source, cast(rank as integer) as rank, rank > 5 as deferred from r")
def budgeted_refresh(spark, sf):
    return scans.budgeted(read(spark, sf, "documents").select("source").distinct(), 5, [F.col("source")])


@query("with e as (select event_type as kind, ts, event_id % 4 = 0 as ok from events), l as (select kind, max(ts) filter (where ok) as last_ok from e group by 1) select kind, count(*) filter (where not ok and (last_ok is null or ts > last_ok)) as streak from e join l using (kind) group by 1")
def failure_streak(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("kind"), F.col("ts").alias("at"), (F.col("event_id") % 4 == 0).alias("ok"))
    return scans.failure_streak(e, "kind")


@query("with p as (select 'T' || cast(o_custkey % 50 as varchar) as ticker, 0 as priority from orders union all select 'T' || cast(c_custkey % 80 as varchar), 1 from customer union all select 'S' || cast(s_suppkey % 10 as varchar), 2 from supplier) select ticker, min(priority) as priority from p group by 1")
def ordered_union(spark, sf):
    t = lambda table, key, n, letter="T": read(spark, sf, table).select(F.concat(F.lit(letter), (F.col(key) % n).cast("string")).alias("ticker"))
    return scans.ordered_union(t("orders", "o_custkey", 50), t("customer", "c_custkey", 80), t("supplier", "s_suppkey", 10, "S"))


@query("with e as (select event_id, cast(ts as date) as event_date, case when event_id % 2 = 0 then ts end as notified_at from events) select event_id, event_date, cast(event_date - date '2024-01-10' as integer) as days_left from e where notified_at is null and event_date between date '2024-01-10' and date '2024-01-17'")
def event_horizon(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.col("ts").cast("date").alias("event_date"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("notified_at"))
    return scans.horizon(e, F.lit("2024-01-10").cast("date"), 7).select("event_id", "event_date", "days_left")


@query("select source, count(*) as n, count(distinct lang) as n_categories, min(doc_id) as first_id from documents group by 1")
def digest_counts(spark, sf):
    return read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("n_categories"), F.min("doc_id").alias("first_id"))
