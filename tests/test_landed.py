import json

import pytest
from pyspark.sql import functions as F

from almanac.sources import feeds, landed

SCHEMA = "id long, at string, tags array<string>, price double"


def write(folder, pages, last=None):
    for n, records in pages:
        path = folder / f"page={n}"
        path.mkdir(parents=True, exist_ok=True)
        (path / f"part-{len(list(path.iterdir()))}.txt").write_text(json.dumps({"page": n, "last_page": last or len(pages), "records": records}))


def records(n, first=0):
    """n records, newest first, three a day."""
    return [{"id": i, "at": f"2024-{1 + i // 3 // 28:02d}-{1 + i // 3 % 28:02d}", "tags": [str(i), "é"], **({"price": i / 2} if i % 4 else {})} for i in range(first + n - 1, first - 1, -1)]


def paged(rows, size):
    return [(1 + at // size, rows[at : at + size]) for at in range(0, len(rows), size)]


def reader(folder, **options):
    from pyspark.sql.types import _parse_datatype_string

    return landed.FeedReader({"path": str(folder), **options}, _parse_datatype_string(SCHEMA))


def test_equals_the_json_reader(spark, tmp_path):
    write(tmp_path, paged(records(100), 7))
    got = landed.feed(spark, str(tmp_path), SCHEMA, date="at", key="id", range=3)
    want = spark.read.schema(f"records array<struct<{SCHEMA}>>").json(str(tmp_path / "*")).select(F.inline("records"))
    assert got.schema == want.schema and got.count() == 100
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_landing_is_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(r["id"], r["at"], r["tags"], r.get("price")) for r in records(230)], SCHEMA).repartition(5)
    landed.land(rows, str(tmp_path), "at", "id", size=20)
    sizes = [len(json.loads(x.read_text())["records"]) for x in tmp_path.glob("page=*/part*")]
    assert sum(sizes) == 230 and max(sizes) == 20 and len(sizes) < 18
    got = landed.feed(spark, str(tmp_path), SCHEMA, date="at", key="id")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, rows.collect()))


def test_conditions_on_the_date_end_the_scan(spark, tmp_path):
    write(tmp_path, paged(records(200), 10))
    where = "at >= '2024-01-20' and at < '2024-01-24' and price is not null"
    got = landed.feed(spark, str(tmp_path), SCHEMA, date="at", key="id").where(where)
    assert sorted(r.id for r in got.collect()) == [i for i in range(57, 69) if i % 4]
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [GreaterThanOrEqual(at,2024-01-20), LessThan(at,2024-01-24)]" in plan
    own = reader(tmp_path, date="at", key="id", range=1)
    left = list(own.pushFilters([landed.GreaterThanOrEqual(("at",), "2024-01-20"), landed.LessThan(("at",), "2024-01-24"), landed.GreaterThan(("price",), 3.0)]))
    assert left == [landed.GreaterThan(("price",), 3.0)]
    planned = [n for span in own.partitions() for n, _ in span.pages]
    assert planned == [14, 15]
    assert [x for span in own.partitions() for batch in own.read(span) for x in batch.column(0).to_pylist()] == list(range(68, 56, -1))
    for low, pages in (("2024-09-01", []), ("2023-01-01", list(range(1, 21)))):
        edge = reader(tmp_path, date="at", key="id")
        list(edge.pushFilters([landed.GreaterThan(("at",), low)]))
        assert [n for span in edge.partitions() for n, _ in span.pages] == pages


def test_pages_that_contradict_each_other_fail(spark, tmp_path):
    broken = {
        "gap": [(1, records(3, 9)), (3, records(3))],
        "short": paged(records(9), 3)[:2],
        "order": [(1, records(3)), (2, records(3, 3))],
        "twice": [*paged(records(9), 3), (2, records(3, 3))],
        "name": [*paged(records(6), 3)],
    }
    for name, pages in broken.items():
        write(tmp_path / name, pages, last=3 if name in ("gap", "short", "twice") else 2)
    body = tmp_path / "name" / "page=2" / "part-0.txt"
    body.write_text(body.read_text().replace('"page": 2', '"page": 1'))
    for name in broken:
        with pytest.raises(feeds.FeedError):
            own = reader(tmp_path / name, date="at", key="id")
            [batch for span in own.partitions() for batch in own.read(span)]
    with pytest.raises(feeds.FeedError):
        write(tmp_path / "many", paged(records(9), 3))
        reader(tmp_path / "many", most=2).partitions()
    assert landed.feed(spark, str(tmp_path / "nothing"), SCHEMA).count() == 0


def test_stream_gives_each_record_once(spark, tmp_path):
    folder, out = tmp_path / "feed", tmp_path / "out"
    folder.mkdir()
    got = []

    def keep(batch, number):
        got.append(sorted(r.id for r in batch.collect()))

    def run():
        stream = landed.feed_stream(spark, str(folder), SCHEMA, date="at", key="id", range=2)
        stream.writeStream.option("checkpointLocation", str(out)).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()

    write(folder / "scan=1", paged(records(20), 5))
    run()
    write(folder / "scan=2", paged(records(33), 5))
    write(folder / "scan=3", paged(records(40), 5))
    write(folder / "scan=4", paged(records(60), 5)[:7], last=12)  # still landing
    run()
    run()
    assert [x for x in got if x] == [list(range(20)), list(range(20, 40))]
    from pyspark.sql.types import _parse_datatype_string

    own = landed.FeedStream({"path": str(folder), "date": "at", "key": "id"}, _parse_datatype_string(SCHEMA))
    end = own.latestOffset()
    assert end["scan"] == 3 and end["newest"] == [records(40)[0]["at"], 39]
    start = {"scan": 1, "newest": [records(20)[0]["at"], 19]}
    batch = lambda: [x for span in own.partitions(start, end) for b in own.read(span) for x in b.column(0).to_pylist()]
    assert batch() == batch() == list(range(39, 19, -1))
    with pytest.raises(ValueError):
        landed.FeedStream({"path": str(folder)}, _parse_datatype_string(SCHEMA))
