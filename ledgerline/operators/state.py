"""State without a transactional table: merges, ledgers, seeding, versioned tables.

Every transformation is a pure frame; only ``Versioned`` writes. A write makes a new
folder and then an entry of the table's log, so a reader sees the old version or
the new one, never a part, and running a step twice changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import keyfilter


def one_per_key(rows: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """One row of each key: the newest by a column, else any one of equal rows. One aggregation, no sort."""
    rest = [c for c in rows.columns if c not in keys and c != newest]
    order = [newest] if newest else []
    pick = F.max(F.struct(*order, *rest)) if order or rest else F.lit(None)
    per = rows.groupBy(*keys).agg(pick.alias("__r"))
    return per.select(*[F.col(c) if c in keys else F.col(f"__r.{c}") for c in rows.columns])


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str], null_keys_repeat: bool = False) -> DataFrame:
    """The new rows whose key is not there yet, one each. Rows with a null key are all kept if they may repeat."""
    known = new
    free = None
    if null_keys_repeat:
        has_null = F.lit(False)
        for k in keys:
            has_null = has_null | F.col(k).isNull()
        free, known = new.where(has_null), new.where(~has_null)
    first = known.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti").select(*new.columns)
    return first if free is None else first.unionByName(free)


def merge(existing: DataFrame, updates: DataFrame, keys: list[str], keep: list[str] | None = None, newest: str | None = None) -> DataFrame:
    """Existing rows replaced by updates of their key; ``keep`` columns stay as they were.

    The updates' last row of a key counts (by ``newest``). One shuffle by key: a full
    outer join of existing rows with at most one update each.
    """
    latest = one_per_key(updates, keys, newest) if newest else updates.dropDuplicates(keys)
    new = latest.select(*keys, F.struct(*[c for c in existing.columns if c not in keys]).alias("__new"))
    old = existing.select(*keys, F.struct(*[c for c in existing.columns if c not in keys]).alias("__old"))
    both = old.join(new, keys, "full")

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if keep and c in keep:
            return F.when(F.col("__old").isNotNull(), F.col(f"__old.{c}")).otherwise(F.col(f"__new.{c}")).alias(c)
        return F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}")).alias(c)

    return both.select(*[value(c) for c in existing.columns])


def add_hits(table: DataFrame, used: DataFrame, key: str = "keyword") -> DataFrame:
    counts = used.groupBy(key).agg(F.count("*").alias("__n"))
    return table.join(counts, key, "left").withColumn("hits", F.col("hits") + F.coalesce("__n", F.lit(0))).drop("__n")


def without(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def compact(log: DataFrame, order: str, keep: int = 200, over: int = 400) -> DataFrame:
    """The newest ``keep`` entries once there are more than ``over``; else all."""
    return log if log.limit(over + 1).count() <= over else log.orderBy(F.desc(order)).limit(keep)


class Ledger:
    """What has been reported: (domain, key, stamped_at). Pending is what it does not hold, whatever the clock says."""

    SCHEMA = "domain string, key string, stamped_at timestamp"

    def __init__(self, stamps: DataFrame, domain: str):
        self.stamps, self.domain = stamps, domain

    def pending(self, rows: DataFrame, key: Column) -> DataFrame:
        seen = self.stamps.where(F.col("domain") == self.domain).select(F.col("key").alias("__key"))
        return rows.withColumn("__key", key.cast("string")).join(seen, "__key", "left_anti").drop("__key")

    def stamp(self, rows: DataFrame, key: Column, now: Column) -> DataFrame:
        """New stamps; a key that has one keeps it."""
        new = rows.select(F.lit(self.domain).alias("domain"), key.cast("string").alias("key"), now.alias("stamped_at"))
        return insert_absent(self.stamps, new, ["domain", "key"])

    def seed(self, rows: DataFrame, key: Column, group: list[str], now: Column) -> DataFrame:
        """Stamps of the back catalogue of groups the ledger has never seen, so that it is never news."""
        keyed = rows.withColumn("__key", key.cast("string"))
        seen = self.stamps.where(F.col("domain") == self.domain).select(F.col("key").alias("__key"))
        known = keyed.join(seen, "__key", "left_semi").select(*group).distinct()
        return self.stamp(keyed.join(known, group, "left_anti"), F.col("__key"), now)


def _range(low, high) -> tuple:
    """A range of keys as the log holds it: numbers and texts as they are, dates as text in the same order, others without bounds."""
    if isinstance(low, str | int | float) and not isinstance(low, bool):
        return low, high
    return (low.isoformat(), high.isoformat()) if type(low) is date else ("", "\U0010ffff")


class Conflict(RuntimeError):
    """Another writer has made the version that this one was to make."""


class Versioned:
    """A Parquet table whose versions are lists of folders and files, each told by one entry of a log.

    A writer puts its rows into a folder of its own and then the entry of the next
    version under its final name, by a rename that never replaces one. So a reader
    sees the old version or the new one; of two writers one is refused; a crash
    before the rename leaves a folder that no version names.

    With ``keys``, each folder's range of the first key stands in the log and a
    filter of its keys beside its files (``keyfilter``), but for folders of fewer rows
    than ``least_filtered``, which are as well read. A look for given keys opens only
    the folders that pass both, and a merge writes only the files that hold them.
    """

    least_filtered = 10_000

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str] | None = None):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys or ())
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._log = self._hadoop.Path(f"{self.path}/_log")
        self._fs = self._log.getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        if not self._fs.exists(self._log):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._log)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def folders(self, version: int) -> list[str]:
        """The folders and files that a version consists of; the last one is what it added."""
        return self._entry(version)["folders"]

    def applied(self) -> list[str]:
        """The names of the migrations that the table has been through."""
        return self._entry(self.version())["applied"]

    def _entry(self, version: int) -> dict:
        if not version:
            return {"folders": [], "applied": [], "facts": {}}
        stream = self._fs.open(self._hadoop.Path(self._log, str(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        return self._frame(self.folders(self.version() if version is None else version))

    def added(self, version: int) -> DataFrame:
        """The rows of a version's last folder."""
        return self._frame(self.folders(version)[-1:])

    def _frame(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.sql("select 1").limit(0).select(*[F.lit(None).cast(t).alias(n) for n, t in (c.split(None, 1) for c in self.schema.split(", "))])
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def holding(self, rows: DataFrame, version: int | None = None) -> list[str]:
        """The folders and files that may hold a key of ``rows``: by their ranges, then by their filters."""
        entry = self._entry(self.version() if version is None else version)
        facts = entry.get("facts", {})
        kinds = dict(self._frame([]).dtypes)
        rows = rows.select(*[F.col(k).cast(kinds[k]).alias(k) for k in self.keys])  # hashes tell types apart
        low, high = rows.agg(F.min(self.keys[0]), F.max(self.keys[0])).first()
        if low is None:
            return []  # no rows, or null keys, which equal none
        low, high = _range(low, high)
        unknown, near = [], {}
        for at in entry["folders"]:
            fact = facts.get(folder := at.split("/")[0])
            if fact is None or fact["keys"] != self.keys:
                unknown.append(at)
            elif fact["low"] is not None and low <= fact["high"] and fact["low"] <= high:
                near.setdefault(folder, []).append(at)
        unknown += [at for f in [*near] if not facts[f]["size"] for at in near.pop(f)]
        if not near:
            return unknown
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/_keys/", 1)
        of_size = F.create_map(*[x for f in near for x in (F.lit(f), F.lit(facts[f]["size"]))])
        filters = self.spark.read.schema("word long, bits long").parquet(*[f"{self.path}/{f}/_keys" for f in near]).select(name.alias("folder"), "word", "bits").withColumn("size", of_size[F.col("folder")])
        found = keyfilter.passing(rows, self.keys, filters, sorted({facts[f]["size"] for f in near})).collect()  # a row a folder
        return unknown + [at for r in found for at in near[r.folder]]

    def read_for(self, rows: DataFrame) -> DataFrame:
        """The part of the table that may hold a key of ``rows``."""
        return self._frame(self.holding(rows))

    def merge(self, updates: DataFrame, keep: list[str] | None = None, newest: str | None = None) -> int:
        """``state.merge`` by the table's keys that writes only the files that hold a key of ``updates``, and one folder more.

        Keys are looked for in the folders that may hold them; the files that do are
        read, merged and written anew, the others stay as they are, named one by one.
        """
        v = self.version()
        entry = self._entry(v)
        keyed = updates.select(*self.keys).distinct()
        maybe = self.holding(updates, v)
        place = F.concat_ws("/", F.slice(F.split("_metadata.file_path", "/"), -2, 2))
        held = self._frame(maybe).select(*self.keys, place.alias("__file")).join(keyed, self.keys, "left_semi") if maybe else None
        touched = [r[0] for r in held.select("__file").distinct().collect()] if maybe else []  # names of files, no more than the log holds
        rows = merge(self._frame(touched), updates.select(*self._names()), self.keys, keep, newest)
        added = self._write(rows, v + 1)
        left = []
        for at in entry["folders"]:
            if "/" in at or not any(t.startswith(f"{at}/") for t in touched):
                left += [] if at in touched else [at]
            else:
                left += [f for f in self._files(at) if f not in touched]
        return self._publish(v + 1, [*left, added])

    def _names(self) -> list[str]:
        return self._frame([]).columns

    def _files(self, folder: str) -> list[str]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._hadoop.Path(f"{self.path}/{folder}"))]
        return sorted(f"{folder}/{n}" for n in names if n.endswith(".parquet"))

    def commit(self, rows: DataFrame) -> int:
        """``rows`` become the table, in one folder."""
        v = self.version()
        return self._publish(v + 1, [self._write(rows, v + 1)])

    def append(self, rows: DataFrame) -> int:
        """``rows`` join the table; what is there is not written again. ``commit(read())`` puts the folders together."""
        v = self.version()
        before = self.folders(v)
        return self._publish(v + 1, [*before, self._write(rows, v + 1)])

    def migrate(self, steps: dict[str, Callable[[DataFrame], DataFrame]]) -> list[str]:
        """Run the steps that the table has not been through, by name; their names.

        A step's rows and its name are one entry of the log: a step that fails leaves
        neither, and running all again does nothing.
        """
        done = []
        for name in sorted(set(steps) - set(self.applied())):
            v = self.version()
            self._publish(v + 1, [self._write(steps[name](self.read(v)), v + 1)], [*self.applied(), name])
            done.append(name)
        return done

    def _write(self, rows: DataFrame, version: int) -> str:
        folder = f"v{version}-{uuid.uuid4().hex[:12]}"
        rows.write.mode("error").parquet(f"{self.path}/{folder}")
        return folder

    def _fact(self, folder: str) -> dict:
        """Range and filter of a folder's keys; the filter is a table within it that readers of the folder pass over."""
        rows = self._frame([folder])
        n, low, high = rows.agg(F.count("*"), F.min(self.keys[0]), F.max(self.keys[0])).first()
        size = keyfilter.size_for(n) if n >= self.least_filtered else 0
        if size:
            keyfilter.build(rows, self.keys, size).write.mode("overwrite").parquet(f"{self.path}/{folder}/_keys")
        low, high = (None, None) if low is None else _range(low, high)
        return {"keys": self.keys, "low": low, "high": high, "size": size}

    def _publish(self, version: int, folders: list[str], applied: list[str] | None = None) -> int:
        before = self._entry(version - 1)
        applied = before["applied"] if applied is None else applied
        named = {f.split("/")[0] for f in folders}
        facts = {f: x for f, x in before.get("facts", {}).items() if f in named}
        if self.keys:
            facts |= {f: self._fact(f) for f in folders[-1:] if f not in facts}
        entry, fresh = self._hadoop.Path(self._log, str(version)), self._hadoop.Path(self._log, f".{uuid.uuid4().hex}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps({"folders": folders, "applied": applied, "facts": facts}).encode()))
        out.close()
        jvm = self.spark._jvm
        rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
        files = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(self._fs.makeQualified(fresh), self._fs.makeQualified(entry), self.spark.sparkContext._gateway.new_array(rename, 0))
        except Exception as e:
            self._fs.delete(fresh, False)
            if self._fs.exists(entry):
                raise Conflict(f"version {version} of {self.path} was made by another writer") from e
            raise
        return version
