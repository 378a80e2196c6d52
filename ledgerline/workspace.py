"""A workspace: the tables under one folder, and what can be asked of and done to them.

Each area below has one method for each thing a user asks. Questions return frames.
Changes return what they would write, and write it with ``commit=True`` alone; done
twice, they change nothing the second time. Every ``now`` is an argument.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import dates, text
from .functions.classify import aliases, band, classify, mentions, suppressed
from .operators import asof, coupons, fares, groups, messages, portfolio, registers, rollup, scans, setups, state
from .plans import reports
from .sources import config, extract


class Workspace:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.spending, self.vouchers, self.supply = Spending(self), Vouchers(self), Supply(self)
        self.radar, self.fares, self.desk = Radar(self), Fares(self), Desk(self)

    def _at(self, name: str) -> state.Versioned:
        return state.Versioned(self.spark, f"{self.root}/{name}", schemas.TABLES[name], list(schemas.KEYS.get(name, ())))

    def table(self, name: str) -> DataFrame:
        return self._at(name).read()

    def shaped(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows with a table's columns and types; what they lack is null."""
        want = [c.split(None, 1) for c in _split(schemas.TABLES[name])]
        return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in want])

    def add(self, name: str, rows: DataFrame, commit: bool) -> DataFrame:
        """The rows whose key is new."""
        new = registers.add(name, self.table(name), self.shaped(name, rows))
        if not commit:
            return new
        table = self._at(name)
        return table.added(table.append(new))  # read back: it holds what was added, whatever happens to the input

    def upsert(self, name: str, rows: DataFrame, commit: bool) -> DataFrame:
        """The table after the upsert; committed, it has new files only where the keys stand."""
        if not commit:
            return registers.upsert(name, self.table(name), self.shaped(name, rows))
        self._at(name).merge(self.shaped(name, rows), list(schemas.KEPT.get(name, ())))
        return self.table(name)

    def replace(self, name: str, rows: DataFrame, commit: bool) -> DataFrame:
        if not commit:
            return rows
        self._at(name).commit(rows)
        return self.table(name)

    def log(self, kind: str, now: datetime, status: str = "ok", detail: str | None = None) -> None:
        row = self.spark.createDataFrame([(int(now.timestamp() * 1e6), kind, now, now, status, detail)], schemas.TABLES["runs"])
        self.add("runs", row, True)

    def runs(self, kind: str | None = None, limit: int = 20) -> DataFrame:
        rows = self.table("runs")
        return (rows.where(F.col("kind") == kind) if kind else rows).orderBy(F.desc("started_at"), F.desc("id")).limit(limit)

    def ledger(self, domain: str) -> state.Ledger:
        return state.Ledger(self.table("ledger"), domain)

    def stamp(self, stamps: DataFrame) -> None:
        self.add("ledger", stamps, True)


def _split(ddl: str) -> list[str]:
    """The columns of a schema text, whose types may hold commas themselves."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[at:k].strip())
            at = k + 1
    return [*out, ddl[at:].strip()]


class _Area:
    def __init__(self, ws: Workspace):
        self.ws = ws


class Spending(_Area):
    def init(self, commit: bool = False) -> DataFrame:
        """Starter keywords; what has been learned stays."""
        return self.ws.add("keyword_category", messages.keyword_table(self.ws.spark).withColumns({"source": F.lit("seed"), "hits": F.lit(0)}), commit)

    def add(self, received: DataFrame, zone: str = "Asia/Hong_Kong", currency: str = "HKD", commit: bool = False) -> DataFrame:
        """Expenses of messages (message_id, member, text, sent: text of a time); known ones are not added again."""
        sent = received.withColumn("p", dates.parse_local(F.col("sent"), zone)).withColumns({"ts": F.col("p.local"), "text": F.coalesce("text", F.lit(""))})
        items = messages.parse_messages(sent.select("message_id", "member", "text", "ts"))
        items = items.join(sent.select("message_id", F.col("p.utc").cast("timestamp").alias("ts_utc"), F.col("text").alias("source_text")), "message_id", "left")
        items = items.withColumn("id", F.xxhash64("message_id", "item_index", "ts", "raw"))
        named = messages.resolve_member(messages.resolve(items, self.ws.table("keyword_category"), ["id"]), self.ws.table("alias"))
        return self.ws.add("expenses", named.withColumn("currency", F.lit(currency)), commit)

    def learn(self, pairs: DataFrame, commit: bool = False) -> tuple[DataFrame, DataFrame]:
        """(accepted, rejected) keyword pairs; expenses without a category are resolved anew."""
        good, bad = messages.learn(pairs)
        table = self.ws.upsert("keyword_category", good.withColumn("source", F.lit("learned")), commit)
        if commit:
            self.ws.replace("expenses", messages.recategorize(self.ws.table("expenses"), table), True)
        return good, bad

    def query(self, month: str | None = None, member: str | None = None, top: int = 5) -> dict[str, DataFrame]:
        rows = self.ws.table("expenses").where(rollup.spending_filter(month, member))
        return {"total": rollup.totals_by(rows), "by_category": rollup.category_summary(rows).orderBy(F.desc("total"), "category"), "by_member": rollup.totals_by(rows, "member").orderBy(F.desc("total"), "member"), "top_days": rollup.top_days(rows, top)}

    def year(self, year: str, member: str | None = None) -> DataFrame:
        return rollup.months_by_category(self.ws.table("expenses").where(rollup.spending_filter(year=year, member=member))).orderBy("month", F.desc("total"))

    def list(self, month: str | None = None, member: str | None = None, limit: int = 20) -> DataFrame:
        return rollup.latest_expenses(self.ws.table("expenses").where(rollup.spending_filter(month, member)), limit)

    def report(self, month: str, member: str | None = None) -> dict[str, DataFrame]:
        """The frames behind a month's pictures."""
        rows = self.ws.table("expenses").where(rollup.spending_filter(month, member))
        by = rollup.totals_by(rows, "category")
        return {"slices": rollup.fold_tail(by), "headings": rollup.headings(by), "currency": rollup.latest_value(rows, "currency", "id"), "bars": rollup.stacked(rollup.months_by_category(rows).select("month", "category", "total"), by)}

    def unmapped(self) -> DataFrame:
        return rollup.unmapped(self.ws.table("expenses"))

    def alias(self, alias: str, member: str, commit: bool = False) -> DataFrame:
        return self.ws.upsert("alias", self.ws.spark.createDataFrame([(alias, member)], schemas.TABLES["alias"]), commit)

    def delete(self, ids: list[int], commit: bool = False) -> DataFrame:
        return self.ws.replace("expenses", self.ws.table("expenses").where(~F.col("id").isin(ids)), commit)


class Vouchers(_Area):
    def add_accounts(self, accounts: DataFrame, commit: bool = False) -> tuple[DataFrame, DataFrame]:
        good, refused = registers.add_accounts(self.ws.table("account"), self.ws.shaped("account", accounts))
        return self.ws.add("account", good, commit), refused

    def accounts(self) -> DataFrame:
        return coupons.account_summary(self.ws.table("coupon"), self.ws.table("media"))

    def commit_candidates(self, candidates: DataFrame, now: Column, confirm: bool = False, commit: bool = False) -> tuple[DataFrame, DataFrame]:
        """(coupons added, candidates rejected): all rules of review apply; a document with an invalid condition is refused whole."""
        valid, bad = coupons.split_valid(candidates)
        valid = valid.join(bad.select("doc").distinct(), "doc", "left_anti")
        judged = coupons.review_reasons(valid, self.ws.table("coupon"))
        judged = judged.withColumn("status", F.lit("active") if confirm else F.col("status")).withColumn("notes", F.when(F.size("reasons") > 0, F.concat(F.lit("needs review: "), F.array_join("reasons", "; "))))
        judged = judged.withColumns({"expires_on": F.col("expires_on").cast("date"), "extraction_confidence": F.col("confidence"), "expiry_assumed": F.col("assumed"), "source_ref": F.concat_ws("#", F.col("doc").cast("string"), F.col("at").cast("string"))})
        rows = registers.add_coupons(self.ws.table("coupon"), self.ws.shaped("coupon", judged).drop("id", "dedupe_key", "created_at", "updated_at", "uses_remaining"), now)
        return self.ws.add("coupon", rows, commit), bad

    def current(self) -> DataFrame:
        """Coupons with the status that their events have brought about."""
        rows, log = self.ws.table("coupon"), self.ws.table("coupon_events")
        after = coupons.lifecycle(rows, log).select("id", F.col("status").alias("__s"), F.col("remaining").alias("__r"))
        extended = log.where("kind = 'extend'").groupBy("id").agg(F.max_by("arg", "seq").cast("date").alias("__d"))
        joined = rows.join(after, "id").join(extended, "id", "left")
        return joined.withColumns({"status": F.col("__s"), "uses_remaining": F.col("__r"), "expires_on": F.coalesce("__d", "expires_on")}).drop("__s", "__r", "__d")

    def act(self, account: str, coupon_id: str, kind: str, now: datetime, arg: str | None = None, commit: bool = False) -> DataFrame:
        """use, unuse, void, extend or resolve: an event of one coupon. Another account's coupon is not found."""
        if not coupons.Scoped(account, c=self.ws.table("coupon")).find("c", coupon_id).limit(1).count():
            raise LookupError(coupon_id)
        event = self.ws.spark.createDataFrame([(coupon_id, account, now, int(now.timestamp() * 1e6), kind, arg)], schemas.TABLES["coupon_events"])
        self.ws.add("coupon_events", event, commit)
        return self.current().where(F.col("id") == coupon_id)

    def list(self, account: str, today: Column, **spec) -> DataFrame:
        return coupons.listed(coupons.Scoped(account, c=self.current())["c"], today, **spec)

    def usable_now(self, account: str, at: Column, channel: Column | None = None, location: Column | None = None) -> DataFrame:
        none = F.lit(None).cast("string")
        return coupons.usable_now(coupons.Scoped(account, c=self.current())["c"], at, channel if channel is not None else none, location if location is not None else none)

    def review(self, account: str) -> DataFrame:
        return coupons.Scoped(account, c=self.current())["c"].where("status = 'needs_review'").orderBy("created_at", "id")

    def sweep_expiry(self, now: datetime, commit: bool = False) -> DataFrame:
        past = coupons.swept(self.current(), F.lit(now.date())).where("swept")
        events = past.select("id", "account_id", F.lit(now).cast("timestamp_ntz").alias("at"), F.lit(int(now.timestamp() * 1e6)).alias("seq"), F.lit("expire").alias("kind"), F.lit(None).cast("string").alias("arg"))
        return self.ws.add("coupon_events", events, commit)

    def alerts_due(self, today: Column, within: int = 3) -> DataFrame:
        return coupons.alerts(self.current(), self.ws.table("account"), today, within)

    def purge(self, account: str, today: Column, commit: bool = False, **selection) -> DataFrame:
        """The manifest of what a purge releases; rows go only with ``commit``."""
        own = coupons.Scoped(account, c=self.current())["c"]
        chosen = registers.purge_selection(own, today, **selection).select("id").withColumn("__gone", F.lit(True))
        marked = own.join(chosen, "id", "left").withColumn("__gone", F.coalesce("__gone", F.lit(False)))
        manifest = coupons.purge_manifest(marked, F.col("__gone"))
        if commit:
            at = f"{self.ws.root}/manifests"
            manifest.write.mode("append").json(at)
            self.ws.replace("coupon", state.without(self.ws.table("coupon"), chosen), True)
            return self.ws.spark.read.schema(manifest.schema).json(at)
        return manifest

    def doctor(self) -> dict[str, DataFrame]:
        rows, media, accounts = self.ws.table("coupon"), self.ws.table("media"), self.ws.table("account")
        return {"dangling": coupons.dangling(rows, media), "unreferenced": coupons.unreferenced(media, rows), "orphans": coupons.orphans(rows, accounts)}


class Supply(_Area):
    def check(self, figures: DataFrame, now: datetime, commit: bool = False) -> tuple[DataFrame, DataFrame]:
        """(new quarters, refused ones). The back catalogue is stamped before the first append, so it is never news."""
        history = self.ws.table("quarters")
        if commit and history.limit(1).count() and not self.ws.table("ledger").where("domain = 'quarters'").limit(1).count():
            self.ws.stamp(self.ws.ledger("quarters").stamp(history, F.col("quarter"), F.lit(now).cast("timestamp")))
        typed = figures.withColumn("q_index", dates.parse_quarter(F.col("quarter")))
        good, refused = registers.add_quarter(history, self.ws.shaped("quarters", typed))
        return self.ws.add("quarters", good, commit), refused

    def pending(self) -> DataFrame:
        return self.ws.ledger("quarters").pending(self.ws.table("quarters"), F.col("quarter")).orderBy("q_index")

    def report(self, now: datetime, quarter: str | None = None, n: int = 8, commit: bool = False) -> DataFrame:
        """The table that ends at a quarter (the oldest pending one, else the newest)."""
        if quarter is None:
            row = self.pending().first() or self.ws.table("quarters").orderBy(F.desc("q_index")).first()
            quarter = row.quarter if row else None
        end = self.ws.spark.range(1).select(dates.parse_quarter(F.lit(quarter)).alias("i")).first().i
        if commit and quarter:
            self.ws.stamp(self.ws.ledger("quarters").stamp(self.ws.table("quarters").where(F.col("quarter") == quarter), F.col("quarter"), F.lit(now).cast("timestamp")))
        return asof.quarter_table(self.ws.table("quarters"), n, end)

    def history(self, n: int = 8) -> DataFrame:
        return asof.quarter_table(self.ws.table("quarters"), n)


class Radar(_Area):
    def scan(self, pages: DataFrame, sources: list[config.Source], now: datetime, exclude: list[str] = (), commit: bool = False) -> DataFrame:
        """Items of fetched pages (source, url, body) that are new. A source's first harvest is absorbed: stored and stamped."""
        parts = []
        for kind in ("rss", "html", "regex"):
            for s in [x for x in sources if x.kind == kind and x.enabled]:
                own = pages.where(F.col("source") == s.name)
                if kind == "rss":
                    parts.append(extract.feed_items(own, s.max_items))
                elif kind == "html":
                    parts.append(extract.listing_items(own, {"list": s.list_selector, **s.fields}, s.max_items))
                else:
                    parts.append(extract.pattern_items(own, s.item_pattern, {"title": 1, "link": 2}, s.max_items))
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        kept = found.where(~scans.excluded(found, list(exclude)))
        rows = kept.withColumns({"item_key": text.item_key(F.col("source"), F.col("url"), F.col("title")), "source_domain": text.domain_of(F.col("url")), "first_seen_at": F.lit(now).cast("timestamp")})
        rows = rows.withColumn("id", F.xxhash64("source", "item_key"))
        known = self.ws.table("site_state").select("source")
        new = self.ws.add("item", rows, commit)
        if commit:
            stamped = F.lit(now).cast("timestamp")
            self.ws.stamp(self.ws.ledger("item").stamp(new.join(known, "source", "left_anti"), F.col("id"), stamped))
            harvest = pages.select("source").distinct().join(kept.groupBy("source").agg(F.count("*").alias("yielded")), "source", "left")
            results = harvest.withColumns({"ok": F.lit(True), "at": stamped})
            after = scans.after_scan(self.ws.table("site_state").select("source", "last_scan_at", "recent_yield", "failures"), results)
            self.ws.upsert("site_state", after, True)
            self.ws.log("scan", now)
        return new

    def digest(self, sources: list[config.Source], now: datetime, threshold: float = 0.7, commit: bool = False) -> DataFrame:
        """Stories of unreported items by section; what it tells is stamped with ``commit``."""
        items = self.ws.table("item").withColumn("domain", F.col("source_domain")).withColumn("words", text.signature(text.normal_title(F.col("title"))))
        told = reports.digest(items, config.source_dim(self.ws.spark, sources), self.ws.ledger("item"), list(dict.fromkeys(s.category for s in sources)), threshold)
        if not commit:
            return told
        at = f"{self.ws.root}/digests/{now:%Y%m%dT%H%M%S}"
        told.write.mode("overwrite").parquet(at)
        rows = self.ws.spark.read.schema(told.schema).parquet(at).orderBy("section", "category", "story_id")
        self.ws.stamp(rows.select(F.lit("item").alias("domain"), F.explode(F.transform("ids", lambda i: i.cast("string"))).alias("key"), F.lit(now).cast("timestamp").alias("stamped_at")))
        return rows

    def sources(self, sources: list[config.Source]) -> DataFrame:
        return scans.health(config.source_dim(self.ws.spark, sources), self.ws.table("site_state"))

    def items(self, limit: int = 20, since: Column | None = None) -> DataFrame:
        rows = self.ws.table("item")
        return (rows.where(F.col("first_seen_at") >= since) if since is not None else rows).orderBy(F.desc("first_seen_at"), F.desc("id")).limit(limit)


class Fares(_Area):
    def collect(self, cells: DataFrame, itineraries: DataFrame | None = None, commit: bool = False) -> DataFrame:
        if itineraries is not None:
            self.ws.upsert("itinerary", itineraries, commit)
        return self.ws.upsert("cell", cells, commit)

    def report(self, scope: str, run_date: date, days: int = 7) -> dict[str, DataFrame]:
        rows = self.ws.table("cell").where(F.col("scope") == scope).withColumn("price", F.col("min_price"))
        today = rows.where(F.col("run_date") == F.lit(run_date))
        keys = ["airline", "dep_bucket", "ret_bucket"]
        trend = fares.trend(rows, keys)
        moved = asof.movement(rows, [*keys, "depart_date", "return_date"], "run_date", "price", str(run_date), days)
        return {"ranking": fares.ranked(fares.cheapest(today.select(*keys, "price", "depart_date", "return_date"), keys, ["depart_date", "return_date"])), "heatmap": fares.heatmap(today), "trend": trend, "movement": asof.nearest(trend, keys, "run_date", "price", str(run_date), days), "drops": asof.movers(moved), "rises": asof.movers(moved, drops=False)}

    def latest(self, limit: int = 20) -> DataFrame:
        rows = self.ws.table("cell")
        newest = rows.groupBy("scope").agg(F.max("run_date").alias("run_date"))
        return rows.join(newest, ["scope", "run_date"], "left_semi").orderBy("min_price", "airline", "dep_bucket").limit(limit)

    def trend(self, scope: str, since: date) -> DataFrame:
        return self.ws.table("cell").where((F.col("scope") == scope) & (F.col("run_date") >= F.lit(since))).orderBy("run_date", "airline", "dep_bucket", "ret_bucket")


class Desk(_Area):
    def sync(self, bars: DataFrame, commit: bool = False) -> DataFrame:
        """Newest write wins: a bar that was provisional is replaced."""
        return self.ws.upsert("bars", bars, commit)

    def trade(self, trades: DataFrame, commit: bool = False) -> tuple[DataFrame, DataFrame]:
        """(trades added, refused): quantities are positive, prices not negative, sides known."""
        ok = (F.col("quantity") > 0) & (F.col("price") >= 0) & F.col("side").isin("buy", "sell")
        return self.ws.add("trades", trades.where(ok), commit), trades.where(~F.coalesce(ok, F.lit(False)))

    def delete_trade(self, ids: list[int], commit: bool = False) -> DataFrame:
        return self.ws.replace("trades", self.ws.table("trades").where(~F.col("id").isin(ids)), commit)

    def positions(self) -> DataFrame:
        last = self.ws.table("bars").groupBy("ticker").agg(F.max_by("close", "day").alias("last_close"))
        return portfolio.priced(portfolio.fifo(self.ws.table("trades")), last)

    def held(self) -> DataFrame:
        return portfolio.open_tickers(self.ws.table("trades")).select("ticker")

    def poll(self, items: DataFrame, watch: config.Watchlist, now: datetime, commit: bool = False) -> DataFrame:
        """News (ticker, peer_of, url, title, source, ...) about its subject, classified; a ticker's first batch is absorbed."""
        tickers, _ = config.watchlist_dims(self.ws.spark, watch)
        named = items.join(tickers.select("ticker", "company_name"), "ticker", "left")
        gate = mentions(F.col("title"), F.coalesce("peer_of", "ticker"), aliases(F.coalesce("peer_of", "ticker"), F.when(F.col("peer_of").isNull(), F.col("company_name"))))
        kind = classify(F.col("title"))
        stamped = F.lit(now).cast("timestamp")
        seen = self.ws.table("news").select("ticker").distinct().withColumn("known", F.lit(True))
        rows = named.where(gate).withColumns({"url_hash": text.url_hash(F.col("url")), "event_class": kind, "first_seen_at": stamped}).withColumn("suppressed", suppressed(F.col("event_class"))).join(seen, "ticker", "left")
        rows = rows.withColumn("notified_at", F.when(F.col("known").isNull(), stamped)).withColumn("id", F.xxhash64("ticker", "url_hash")).withColumn("band", band(F.lit(0)))
        if commit:
            self.ws.log("news_poll", now)
        return self.ws.add("news", rows, commit)

    def refresh_events(self, events: DataFrame, commit: bool = False) -> DataFrame:
        """A moved date is an event of its own."""
        return self.ws.add("events", events.withColumn("id", F.xxhash64("ticker", "kind", "event_date")), commit)

    def refresh_macro(self, readings: DataFrame, commit: bool = False) -> DataFrame:
        return self.ws.upsert("macro", readings, commit)

    def macro(self) -> dict[str, DataFrame]:
        rows = self.ws.table("macro")
        return {"latest": asof.as_of(rows, ["series"], "as_of", "value", "9999-12-31"), "curve": asof.same_day_spread(rows, "ust_2y", "ust_10y")}

    def scan(self, thresholds: setups.Thresholds | None = None, commit: bool = False) -> DataFrame:
        """Setups; with ``commit`` each ticker's stage is remembered for tomorrow's verdict."""
        found = setups.scan(self.ws.table("bars"), self.ws.table("setup_state"), thresholds)
        if commit:
            self.ws.upsert("setup_state", found.select("ticker", "as_of", "stage", "score", "pivot"), True)
        return found

    def sector(self, watch: config.Watchlist, sessions: int = 30) -> tuple[DataFrame, DataFrame]:
        _, members = config.watchlist_dims(self.ws.spark, watch)
        from .functions.series import Bars

        returns = self.ws.table("bars").withColumn("ret", Bars().horizon_return(sessions)).groupBy("ticker").agg(F.max_by("ret", "day").alias("ret"))
        view = groups.sector_view(members, returns)
        return view, groups.standing(view, members, returns)

    def report(self, watch: config.Watchlist, moves: DataFrame, now: datetime, commit: bool = False, **how) -> reports.Report:
        """The daily report; with ``commit`` what it says is stamped: capped stories, due events and changed series."""
        _, members = config.watchlist_dims(self.ws.spark, watch)
        made = reports.desk_report(self.ws.table("bars"), self.ws.table("setup_state"), self.ws.table("news"), self.ws.table("events"), members, self.ws.table("macro"), moves, F.lit(now.date()), self.held(), **how)
        if commit:
            stamped = F.lit(now).cast("timestamp")
            told = made.capped.select(F.explode("ids").alias("id")).withColumn("__t", F.lit(True))
            news = self.ws.table("news").join(told, "id", "left").withColumn("notified_at", F.coalesce("notified_at", F.when(F.col("__t"), stamped))).drop("__t")
            due = made.events.select("id").withColumn("__t", F.lit(True))
            events = self.ws.table("events").join(due, "id", "left").withColumn("notified_at", F.coalesce("notified_at", F.when(F.col("__t"), stamped))).drop("__t")
            moved = made.macro.select("series", "as_of").withColumn("__t", F.lit(True))
            macro = self.ws.table("macro").join(moved, ["series", "as_of"], "left").withColumn("notified_at", F.coalesce("notified_at", F.when(F.col("__t"), stamped))).drop("__t")
            for name, rows in (("news", news), ("events", events), ("macro", macro)):
                self.ws.replace(name, self.ws.shaped(name, rows), True)
            self.ws.log("report", now)
        return made

    def seed_macro(self, now: datetime, commit: bool = False) -> DataFrame:
        """The newest level of every series becomes the base that changes are measured from."""
        rows = self.ws.table("macro")
        newest = rows.groupBy("series").agg(F.max("as_of").alias("as_of")).withColumn("__t", F.lit(True))
        marked = rows.join(newest, ["series", "as_of"], "left").withColumn("notified_at", F.coalesce("notified_at", F.when(F.col("__t"), F.lit(now).cast("timestamp")))).drop("__t")
        return self.ws.replace("macro", self.ws.shaped("macro", marked), commit)

    def alerts(self, today: Column) -> tuple[DataFrame, DataFrame]:
        return reports.position_alerts(self.ws.table("news"), self.ws.table("events"), self.held(), today)

    def pending(self, today: Column) -> DataFrame:
        return reports.pending_summary(self.ws.table("news"), self.ws.table("events"), today)

    def brief(self, ticker: str, since: Column, today: Column) -> dict[str, DataFrame]:
        return reports.brief(ticker, self.ws.table("bars"), self.ws.table("news"), self.ws.table("events"), self.ws.table("fundamentals"), since, today)

    def schedule(self, watch: config.Watchlist, today: Column) -> DataFrame:
        """Tickers by market, and the next day that market may open."""
        tickers, _ = config.watchlist_dims(self.ws.spark, watch)
        labelled = tickers.where("enabled").withColumn("market", scans.market_of(F.col("ticker"))["market"])
        return labelled.groupBy("market").agg(F.sort_array(F.collect_list("ticker")).alias("tickers")).withColumn("next_session", scans.next_session(today))

