"""Keyed upserts with memory, deletions, retention, and versioned tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from almanac.operators.dedupe import first_by


def links_replaced(old: DataFrame, new: DataFrame, releases: DataFrame, key: str = "release_id") -> DataFrame:
    """The links of ``releases`` are those of ``new`` alone, none left over; other links stay."""
    ids = releases.select(key).distinct()
    return old.join(ids, key, "left_anti").unionByName(new.join(ids, key, "left_semi"))


def run_ledger(events: DataFrame, key: str = "run_id") -> DataFrame:
    """One row per run from its appended rows: started when the first says so, closed by the latest that is closed.

    ``events``: run_id, at, closed, ok, error.  A run without a closing row is running (ok null).
    """
    end = F.max_by(F.struct("at", "ok", "error"), F.when(F.col("closed"), F.col("at")))
    rows = events.groupBy(key).agg(F.min("at").alias("started_at"), F.when(F.bool_or("closed"), end).alias("end"))
    return rows.select(key, "started_at", F.col("end.at").alias("finished_at"), F.col("end.ok").alias("ok"), F.col("end.error").alias("error"))


def blank_to_null(value: Column, kind) -> Column:
    if isinstance(kind, StringType):
        return F.nullif(value, F.lit(""))
    if isinstance(kind, (ArrayType, MapType)):
        return F.when(F.size(value) > 0, value)
    return value


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their key as a whole."""
    every = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return first_by(every, keys, [F.desc("_new")]).drop("_new")


def upserted_keeping(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str], overlay: str | None = None) -> DataFrame:
    """As upserted(), but a blank new value of ``keep`` leaves the old one; map ``overlay`` is laid over the old map."""
    o, n = old.alias("o"), new.alias("n")
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"o.{k}") == F.col(f"n.{k}"))
    there = F.col(f"n.{keys[0]}").isNotNull()
    out = []
    for field in new.schema.fields:
        mine, theirs = F.col(f"n.{field.name}"), F.col(f"o.{field.name}")
        if field.name in keys:
            value = F.coalesce(mine, theirs)
        elif field.name in keep:
            value = F.coalesce(blank_to_null(mine, field.dataType), theirs)
        elif field.name == overlay:
            value = overlaid(theirs, mine)
        else:
            value = F.when(there, mine).otherwise(theirs)
        out.append(value.alias(field.name))
    return o.join(n, cond, "full_outer").select(*out)


def overlaid(old: Column, new: Column) -> Column:
    """A map laid over another; keys of the new one win."""
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def overlay_field(current: Column, page: Column, prior: Column, prior_from_page: Column, current_from_page: Column) -> Column:
    """The page's value; else the earlier page value where the current one is not from a page; else the current one."""
    return F.coalesce(page, F.when(prior_from_page & ~current_from_page, prior), current)


def evidence_reset(provenance: Column, url: Column, old_url: Column) -> Column:
    """Field provenance without page entries where the address changed."""
    return F.when(url.eqNullSafe(old_url), provenance).otherwise(F.map_filter(provenance, lambda _, v: v != "page"))


def reassigned(rows: DataFrame, ids: DataFrame, column: str = "release_id") -> DataFrame:
    """Moves rows to canonical ids; ``ids``: old, canonical_id."""
    own = ids.select(F.col("release_id").alias(column), "canonical_id")
    return rows.join(own, column, "left").withColumn(column, F.coalesce("canonical_id", column)).drop("canonical_id")


def expired(rows: DataFrame, date: str, start: Column) -> tuple[DataFrame, DataFrame]:
    """(rows from ``start`` on, rows before it); rows without a date stay."""
    gone = F.coalesce(F.col(date) < start, F.lit(False))
    return rows.where(~gone), rows.where(gone)


def retired(rows: DataFrame, source: str, sources: list[str]) -> DataFrame:
    return rows.where(~F.coalesce(F.col(source).isin(*sources), F.lit(False)))


def excluded(releases: DataFrame, observations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(releases, observations) after records were excluded.

    ``gone``: provider, record.  Their observations go; a release goes when one of its observations
    went and none is left.
    """
    hit = observations.join(gone.distinct(), ["provider", "record"], "left_semi")
    left = observations.join(gone.distinct(), ["provider", "record"], "left_anti")
    dead = hit.select("release_id").distinct().join(left.select("release_id").distinct(), "release_id", "left_anti")
    return releases.join(dead, "release_id", "left_anti"), left


def feed_status(previous: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Status by feed after a cycle: a failed feed keeps its last success and counts.

    ``results``: source_id, label_id, ok, error, releases; feeds without a result stay as they are.
    """
    keys = ["source_id", "label_id"]
    p = previous.select(*keys, F.col("last_success_at").alias("p_at"), F.col("releases").alias("p_n"), F.col("last_error").alias("p_error"))
    both = p.join(results, keys, "full_outer")
    return both.select(
        *keys,
        F.when(F.col("ok"), now).otherwise(F.col("p_at")).alias("last_success_at"),
        F.when(F.col("ok"), F.col("releases")).otherwise(F.col("p_n")).alias("releases"),
        F.when(F.col("ok").isNull(), F.col("p_error")).when(~F.col("ok"), F.col("error")).alias("last_error"),
    )


def merged_provenance(old: Column, new: Column) -> Column:
    """Entries of both lists, one per source, source URL and record URL: the last one, at the first one's place."""
    key = lambda x: F.concat_ws("|", F.coalesce(x["source"], F.lit("")), F.coalesce(x["source_url"], F.lit("")), F.coalesce(x["record_url"], F.lit("")))
    every = F.concat(old, new)
    keys = F.array_distinct(F.transform(every, key))
    return F.transform(keys, lambda k: F.element_at(F.filter(every, lambda x: key(x) == k), -1))


class VersionedTable:
    """A table whose versions are whole folders, each named by a pointer file once it is whole.

    The highest pointer counts.  A version is written beside the others and its pointer is made
    after it and never changed, so readers never see half a version, and a crash at any moment
    leaves the last whole one in force.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        found = self._fs.globStatus(self._path(f"{self.root}/current-*.json")) or []
        return max((int(x.getPath().getName()[len("current-") : -len(".json")]) for x in found), default=0)

    def read(self) -> DataFrame | None:
        n = self.version()
        return self.spark.read.parquet(self._folder(n)) if n else None

    def _folder(self, n: int) -> str:
        return f"{self.root}/{json.loads(self.spark.read.text(f'{self.root}/current-{n}.json', wholetext=True).first()[0])['folder']}"

    def write(self, rows: DataFrame, partition_by: list[str] | None = None) -> int:
        # a folder of its own: two writers of one version never write into each other's
        n, folder = self.version() + 1, f"v-{uuid.uuid4().hex}"
        (rows.write.partitionBy(*partition_by) if partition_by else rows.write).parquet(f"{self.root}/{folder}")
        self._point(n, {"version": n, "folder": folder})
        return n

    def _point(self, n: int, manifest: dict) -> None:
        draft = self._path(f"{self.root}/draft-{uuid.uuid4().hex}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        # a name that is taken means that another writer was first: its version counts, and this one never does
        pointer = self._path(f"{self.root}/current-{n}.json")
        if self._fs.exists(pointer) or not self._fs.rename(draft, pointer):
            raise FileExistsError(f"version {n} of {self.root} was written by another, or its pointer cannot be made")


class BucketedTable(VersionedTable):
    """A keyed table in buckets by the hash of its keys, of which an upsert rewrites only those that it touches.

    A version is a manifest: the folder of each bucket, and the schema.  New folders are written beside
    the old ones, which no version ever changes, and the manifest's pointer is made last (see
    VersionedTable).  The driver handles bucket numbers and folder names, as many as there are buckets.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 64):
        super().__init__(spark, root)
        self.keys, self.buckets = list(keys), buckets

    def manifest(self) -> dict:
        n = self.version()
        if not n:
            return {"version": 0, "keys": self.keys, "buckets": self.buckets, "folders": {}, "schema": None}
        found = json.loads(self.spark.read.text(f"{self.root}/current-{n}.json", wholetext=True).first()[0])
        if (found["keys"], found["buckets"]) != (self.keys, self.buckets):
            raise ValueError(f"{self.root} is kept by {found['keys']} in {found['buckets']} buckets")
        return found

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of the version in force, or of some of its buckets."""
        now = self.manifest()
        return self._rows(now, [str(b) for b in buckets] if buckets is not None else list(now["folders"])) if now["schema"] else None

    def lookup(self, keys: DataFrame) -> DataFrame | None:
        """The rows under ``keys``, out of their buckets alone."""
        own = self.read(self._touched(keys))
        return None if own is None else own.join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def _rows(self, now: dict, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(now["schema"])
        folders = [now["folders"][b] for b in buckets if b in now["folders"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(row[0] for row in rows.select(self._bucket().alias("b")).distinct().collect())

    def upsert(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> int:
        """A version with the rows of ``new`` under their keys; ``merge`` says what old and new rows make (upserted by default)."""
        now = self.manifest()
        touched = self._touched(new)
        old = self._rows(now, [str(b) for b in touched]) if now["schema"] else new.limit(0)
        rows = merge(old, new) if merge else upserted(old, new, self.keys)
        return self._replace(now, touched, rows)

    def delete(self, gone: DataFrame) -> int:
        """A version without the rows under the keys of ``gone``."""
        now, touched = self.manifest(), self._touched(gone)
        return self._replace(now, touched, self._rows(now, [str(b) for b in touched]).join(gone.select(*self.keys).distinct(), self.keys, "left_anti")) if now["schema"] else 0

    def _replace(self, now: dict, touched: list[int], rows: DataFrame) -> int:
        n, folder = now["version"] + 1, f"{self.root}/data-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        written = {x.getPath().getName().split("=")[1]: f"{folder}/{x.getPath().getName()}" for x in self._fs.globStatus(self._path(f"{folder}/_bucket=*")) or []}
        kept = {b: path for b, path in now["folders"].items() if int(b) not in touched}
        self._point(n, {"version": n, "keys": self.keys, "buckets": self.buckets, "folders": kept | written, "schema": json.loads(rows.schema.json())})
        return n
