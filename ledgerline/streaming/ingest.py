"""Structured Streaming twins of the batch operators; equal input gives equal state."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.portfolio import meet
from ..functions.text import decoded
from ..operators.state import Versioned, insert_absent


def landing(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """A stream of the files that appear in a landing folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Zone-less time stamps cast to instants (watermarks need them), and a watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], value: str, delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Windowed counts and sums of late-tolerant event time."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    per = with_event_time(df, ts, delay).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(38,2)")).cast("double").alias("total"))
    return per.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    per = with_event_time(df, ts, delay).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))
    return per.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def once(df: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """Each key once, as long as repeats come within the watermark."""
    return with_event_time(df, ts, delay).dropDuplicatesWithinWatermark(keys)


def into(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]):
    """Run a batch step on every micro-batch of what is available now, and wait for its end."""
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def absent_into(table: Versioned, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A step that appends the rows of new keys: a batch that is replayed adds nothing.

    A table with ``keys`` opens only the folders that may hold one of the batch, so a
    batch costs its own rows, its folders' filters, and the rows of folders that it
    repeats. ``table.commit(table.read())``, apart from the stream, puts the small
    folders together.
    """

    def step(batch: DataFrame, _: int) -> None:
        existing = table.read_for(batch) if table.keys == keys else table.read()
        table.append(insert_absent(existing, batch.select(*existing.columns), keys))

    return step


class ChangeSinceReported(StatefulProcessor):
    """Emits a reading at least ``move`` away from the last one emitted; the first only sets the base."""

    def __init__(self, move: float):
        self.move = move

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reported = handle.getValueState("reported", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        readings = pd.concat(list(rows)).sort_values("as_of", kind="stable")
        base = self.reported.get()[0] if self.reported.exists() else None
        out = []
        for at, value in zip(readings["as_of"], readings["value"], strict=True):
            if base is None:
                base = float(value)
            elif abs(value - base) + 1e-12 >= self.move:
                out.append((key[0], at, float(value), base))
                base = float(value)
        if base is not None:
            self.reported.update((base,))
        yield pd.DataFrame(out, columns=["series", "as_of", "value", "previous"])

    def close(self) -> None:
        pass


CHANGES = "series string, as_of timestamp, value double, previous double"


def changes(stream: DataFrame, move: float) -> DataFrame:
    """Changes since last reported, of a stream of (series, as_of, value). Needs the RocksDB state store."""
    return stream.groupBy("series").transformWithStateInPandas(ChangeSinceReported(move), outputStructType=CHANGES, outputMode="Append", timeMode="None")


class OpenLots(StatefulProcessor):
    """A ticker's open lots, oldest first: a day's trades meet what is open, not all that was ever traded."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lots = handle.getListState("lots", "quantity double, each double")
        self.realized = handle.getValueState("realized", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        trades = pd.concat(list(rows)).sort_values(["trade_date", "id"], kind="stable")
        lots = deque([q, p] for q, p in self.lots.get()) if self.lots.exists() else deque()
        realized = self.realized.get()[0] if self.realized.exists() else 0.0
        realized += meet(lots, zip(trades["side"], trades["quantity"], trades["price"], trades["fee"].fillna(0.0), strict=True))
        self.realized.update((float(realized),))
        if lots:
            self.lots.put([(float(q), float(p)) for q, p in lots])
        else:
            self.lots.clear()
        held, basis = sum(q for q, _ in lots), sum(q * p for q, p in lots)
        out = [(key[0], trades["trade_date"].max(), held, basis / held if held else 0.0, basis, float(realized), len(lots))]
        yield pd.DataFrame(out, columns=["ticker", "as_of", "quantity", "avg_cost", "cost_basis", "realized", "open_lots"])

    def close(self) -> None:
        pass


POSITIONS = "ticker string, as_of date, quantity double, avg_cost double, cost_basis double, realized double, open_lots long"


def positions(stream: DataFrame) -> DataFrame:
    """Net positions after each batch of a stream of trades, of the tickers traded in it. Batches come in order of time."""
    return stream.groupBy("ticker").transformWithStateInPandas(OpenLots(), outputStructType=POSITIONS, outputMode="Update", timeMode="None")


class Expiry(StatefulProcessor):
    """A coupon's status, and a timer at its end: it expires when the watermark passes that, with no event of its own.

    Events: ``add`` and ``extend`` set the end (``until``); ``use`` and ``void`` close
    the coupon, and it is forgotten. Closed or forgotten ones do not expire.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until timestamp")

    def _disarm(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for e in pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable").itertuples():
            known = self.until.exists()
            if e.kind in ("add", "extend") and not pd.isna(e.until) and (e.kind == "add") != known:
                self._disarm()
                self.until.update((e.until.to_pydatetime(),))
                self.handle.registerTimer(int(e.until.timestamp() * 1000))
                out.append((key[0], e.at, "active"))
            elif e.kind in ("use", "void") and known:
                self._disarm()
                self.until.clear()
                out.append((key[0], e.at, "used" if e.kind == "use" else "void"))
        yield pd.DataFrame(out, columns=["id", "at", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        self.until.clear()
        yield pd.DataFrame([(key[0], at, "expired")], columns=["id", "at", "status"])

    def close(self) -> None:
        pass


def expiries(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Changes of status, of a stream of (id, at, seq, kind, until), expiry by event time included. Needs the RocksDB state store."""
    timed = with_event_time(stream, "at", delay)
    return timed.groupBy("id").transformWithStateInPandas(Expiry(), outputStructType="id string, at timestamp, status string", outputMode="Append", timeMode="EventTime")


class StageMachine(StatefulProcessor):
    """Keeps a ticker's last stage and pivot; a triggered one that closes under its pivot has failed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "stage string, pivot double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        scans = pd.concat(list(rows)).sort_values("as_of", kind="stable")
        stage, pivot = self.last.get() if self.last.exists() else (None, None)
        out = []
        for r in scans.itertuples():
            if stage == "triggered" and pivot is not None:
                now = ("failed" if r.close < pivot else "triggered", pivot)
            else:
                now = (r.stage, None if pd.isna(r.pivot) else float(r.pivot))
            out.append((key[0], r.as_of, *now))
            stage, pivot = now
        self.last.update((stage, pivot))
        yield pd.DataFrame(out, columns=["ticker", "as_of", "stage", "pivot"])

    def close(self) -> None:
        pass


def stages(stream: DataFrame) -> DataFrame:
    """Stages with memory, of a stream of (ticker, as_of, stage, pivot, close)."""
    return stream.groupBy("ticker").transformWithStateInPandas(StageMachine(), outputStructType="ticker string, as_of timestamp, stage string, pivot double", outputMode="Append", timeMode="None")


class Validators(StatefulProcessor):
    """What an address last answered with, and the fetch under way: attempts may come in different batches."""

    def __init__(self, retries: int):
        self.retries = retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "etag string, last_modified string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        attempts = pd.concat(list(rows)).sort_values(["fetched_at", "attempt"], kind="stable")
        known = tuple(self.known.get()) if self.known.exists() else (None, None)
        out = []
        for a in attempts.itertuples():
            again = pd.isna(a.status) or a.status >= 500
            if again and a.attempt < self.retries:
                continue
            if a.attempt > self.retries:
                continue
            if not again and a.status == 304:
                out.append((key[0], a.fetched_at, "unchanged", None, None, *known))
            elif not again and 200 <= a.status < 300:
                known = (a.etag, a.last_modified)
                out.append((key[0], a.fetched_at, "fresh", a.body, a.charset, *known))
            else:
                out.append((key[0], a.fetched_at, "failed", None, None, *known))
        if out:
            self.known.update(known)
        yield pd.DataFrame(out, columns=["url", "fetched_at", "outcome", "body", "charset", "etag", "last_modified"])

    def close(self) -> None:
        pass


ANSWERS = "url string, fetched_at timestamp, outcome string, body binary, charset string, etag string, last_modified string"


def answers(stream: DataFrame, retries: int = 2) -> DataFrame:
    """One row for each fetch of an address, of a stream of landed responses: fresh text, unchanged, or failed.

    As ``readers.conditional_responses``, but with the validators as state: an unchanged
    or failed fetch keeps those of the last fresh one. A fetch is told once its last
    attempt has landed, and batches come in order of time. Needs the RocksDB state store.
    """
    told = stream.groupBy("url").transformWithStateInPandas(Validators(retries), outputStructType=ANSWERS, outputMode="Append", timeMode="None")
    return told.select("url", "fetched_at", "outcome", F.when(F.col("outcome") == "fresh", decoded(F.col("body"), F.col("charset"))).alias("text"), "etag", "last_modified")
