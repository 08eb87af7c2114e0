"""Landed feeds as a Spark data source: page ranges planned up to the window's edge, and streams of what is new.

A feed lands as folders ``page=<n>``, from 1 on, with one JSON file each: page, last_page and records,
newest first over all pages.  A feed that is scanned again and again lands as ``scan=<n>`` with such
pages in each.  Planning lists the folder once and reads a few pages, as many as halving takes to find
the window's edges; tasks read the pages of their range, and each holds one page at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from almanac.operators.staging import staged
from almanac.sources.feeds import FeedError

#: Pages of a task, and pages that a feed has at most.
RANGE, MOST = 8, 100_000
FORMAT = "landed_feed"
PAGE_FILE = re.compile(r"(?:^|/)page=(\d+)/[^/_.][^/]*$")
SCAN = re.compile(r"(?:^|/)scan=(\d+)(?:/|$)")


class Page:
    def __init__(self, folder: Folder, number: int, path: str):
        self.folder, self.number, self.path = folder, number, path

    def body(self) -> dict:
        with self.folder.fs.open_input_file(self.path) as source:
            return json.loads(source.read())

    def records(self, last: int) -> list[dict]:
        """The page's records, after holding it against its place in the feed."""
        body = self.body()
        if body["page"] != self.number or body["last_page"] != last:
            raise FeedError(f"{self.path} calls itself page {body['page']} of {body['last_page']}, not {self.number} of {last}")
        return body.get("records") or []


class Folder:
    """Pages in a folder that executors can open."""

    def __init__(self, uri: str):
        self.uri = re.sub("^file:/+", "file:///", uri)
        self.fs, self.root = pafs.FileSystem.from_uri(self.uri)

    def scans(self) -> list[int]:
        found = self.fs.get_file_info(pafs.FileSelector(self.root, allow_not_found=True))
        return sorted(int(m[1]) for x in found if (m := SCAN.search(x.path[len(self.root) :])))

    def pages(self, most: int) -> list[Page]:
        """All pages in order; fails unless they are 1 to the last one, each once, and not too many."""
        files = self.fs.get_file_info(pafs.FileSelector(self.root, recursive=True, allow_not_found=True))
        found = sorted((int(m[1]), x.path) for x in files if x.type == pafs.FileType.File and (m := PAGE_FILE.search(x.path[len(self.root) :])))
        if len(found) > most:
            raise FeedError(f"{self.uri} has {len(found)} pages, more than {most}")
        out = [Page(self, n, path) for n, path in found]
        if out and (last := out[0].body()["last_page"]) != len(out) or [x.number for x in out] != list(range(1, len(out) + 1)):
            raise FeedError(f"{self.uri}: pages are missing or repeated, it has {len(out)} of {last if out else 0}")
        return out


def first_page(pages: list[Page], holds: Callable[[list[dict]], bool]) -> int:
    """How many pages stand before the first one that ``holds``; pages without records do."""
    low, high = 0, len(pages)
    while low < high:
        middle = (low + high) // 2
        records = pages[middle].records(len(pages))
        if not records or holds(records):
            high = middle
        else:
            low = middle + 1
    return low


class Span(InputPartition):
    def __init__(self, uri: str, pages: list[tuple[int, str]], last: int, above: list | None = None):
        self.uri, self.pages, self.last, self.above = uri, pages, last, above


def spans(folder: Folder, pages: list[Page], last: int, size: int, above: list | None = None) -> list[Span]:
    own = [(x.number, x.path) for x in pages]
    return [Span(folder.uri, own[at : at + size], last, above) for at in range(0, len(own), size)]


class Keyed:
    """How a feed's records are ordered: newest first by ``date``, then by ``key``."""

    def __init__(self, options: dict, schema: StructType):
        self.uri, self.schema = options["path"], schema
        self.date, self.key = options.get("date"), options.get("key")
        self.size, self.most = int(options.get("range", RANGE)), int(options.get("most", MOST))

    def place(self, record: dict) -> list:
        return [record[c] for c in (self.date, self.key) if c]

    def batches(self, span: Span, keep: Callable[[dict], bool]) -> Iterator[pa.RecordBatch]:
        folder, before = Folder(span.uri), None
        for number, path in span.pages:
            records = Page(folder, number, path).records(span.last)
            if self.date:
                places = ([before] if before else []) + [self.place(r) for r in records]
                if any(a < b for a, b in zip(places, places[1:], strict=False)):
                    raise FeedError(f"{path}: records are not in order, newest first")
                before = places[-1] if places else before
            yield pa.RecordBatch.from_pylist([r for r in records if keep(r)], schema=to_arrow_schema(self.schema))


class FeedReader(DataSourceReader, Keyed):
    """Pages of one scan; conditions on the date end the scan where its window ends."""

    #: Conditions that are taken over, and whether a date meets them.
    TAKEN = {GreaterThanOrEqual: lambda x, y: x >= y, GreaterThan: lambda x, y: x > y, LessThanOrEqual: lambda x, y: x <= y, LessThan: lambda x, y: x < y}

    def __init__(self, options: dict, schema: StructType):
        Keyed.__init__(self, options, schema)
        self.window: list[tuple[type, str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for x in filters:
            if self.date and type(x) in self.TAKEN and x.attribute == (self.date,):
                self.window.append((type(x), x.value))
            else:
                yield x

    def inside(self, record: dict, kinds: tuple[type, ...] = tuple(TAKEN)) -> bool:
        value = record.get(self.date)
        return all(value is not None and self.TAKEN[kind](value, bound) for kind, bound in self.window if kind in kinds)

    def partitions(self) -> list[Span]:
        folder = Folder(self.uri)
        pages = folder.pages(self.most)
        last, begin = len(pages), 0
        if self.window:
            # the newest record of a page behind the window is too old; the oldest one of a page ahead of it is too new
            old, new = (GreaterThan, GreaterThanOrEqual), (LessThan, LessThanOrEqual)
            end = first_page(pages, lambda records: not self.inside(records[0], old))
            begin = min(end, first_page(pages, lambda records: self.inside(records[-1], new)))
            pages = pages[begin:end]
        return spans(folder, pages, last, self.size) or [Span(folder.uri, [], 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        return self.batches(span, self.inside if self.window else lambda _: True)


class FeedStream(DataSourceStreamReader, Keyed):
    """What each scan has that is newer than all before: an offset is a scan and its newest record.

    A batch reads the pages of its last scan up to the first one that is known, so a replay after a
    failure reads the same pages of the same scan and gives the same rows.
    """

    def __init__(self, options: dict, schema: StructType):
        Keyed.__init__(self, options, schema)
        if not (self.date and self.key):
            raise ValueError("a stream needs the options date and key")

    def scan(self, n: int) -> Folder:
        return Folder(f"{self.uri.rstrip('/')}/scan={n}")

    def initialOffset(self) -> dict:
        return {"scan": 0, "newest": []}

    def latestOffset(self) -> dict:
        """The last scan that is whole; one that is still landing waits."""
        for n in reversed(Folder(self.uri).scans()):
            try:
                pages = self.scan(n).pages(self.most)
            except (FeedError, ValueError, KeyError):
                continue
            if pages and (records := pages[0].records(len(pages))):
                return {"scan": n, "newest": self.place(records[0])}
        return self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Span]:
        if end["scan"] == start["scan"]:
            return [Span(self.uri, [], 0, [])]
        folder = self.scan(end["scan"])
        pages = folder.pages(self.most)
        known = first_page(pages, lambda records: self.place(records[0]) <= start["newest"])
        return spans(folder, pages[:known], len(pages), self.size, start["newest"]) or [Span(folder.uri, [], 0, [])]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        return self.batches(span, lambda record: self.place(record) > span.above)


class FeedSource(DataSource):
    """Records of a landed feed.

    Options: path; date, the column of text that the feed is ordered by, newest first; key, the column
    that tells records of one date apart; range, pages a task; most, pages at most.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeedReader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FeedStream(self.options, schema)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(FeedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def feed(spark: SparkSession, folder: str, schema: str, **options) -> DataFrame:
    """The records of a landed feed (see FeedSource); conditions on ``date`` reach the planning of pages."""
    return registered(spark).read.format(FORMAT).schema(schema).options(**options).load(folder)


def feed_stream(spark: SparkSession, folder: str, schema: str, **options) -> DataFrame:
    """What the scans of a landed feed bring that is new, scan by scan."""
    return registered(spark).readStream.format(FORMAT).schema(schema).options(**options).load(folder)


def land(rows: DataFrame, folder: str, date: str, key: str, size: int = 1000) -> None:
    """Writes rows as the pages of one scan, newest first, at most ``size`` records each.

    The order is dealt by range; a page is a stretch of one range, so the only rows that meet are those
    of a page, and the pages of all ranges are counted up in between.
    """
    order = [F.desc(date), F.desc(key)]
    placed = staged(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "landing")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    cut = placed.withColumn("_nth", nth).withColumn("_cut", F.floor(F.col("_nth") / size).cast("long"))
    counts = cut.groupBy("_part").agg((F.max("_cut") + 1).alias("_pages"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    counts = counts.select("_part", F.coalesce(F.sum("_pages").over(upto), F.lit(0)).alias("_base"), F.sum("_pages").over(Window.partitionBy()).alias("last_page"))
    paged = cut.join(F.broadcast(counts), "_part").withColumn("page", F.col("_base") + F.col("_cut") + 1)
    record = F.struct(*rows.columns)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_nth", record.alias("record")))), lambda x: x["record"])
    bodies = paged.groupBy("page").agg(F.max("last_page").alias("last_page"), listed.alias("records"))
    text = F.to_json(F.struct("page", "last_page", "records"))
    bodies.select("page", text.alias("value")).write.mode("overwrite").partitionBy("page").text(folder)
