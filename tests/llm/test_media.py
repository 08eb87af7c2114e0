import hashlib
import zlib

import pyarrow.fs as pafs
import pytest

from almanac.llm import media
from almanac.llm.common import scratch_path
from tests.llm.common import folder, none, odd


def check(rows, texts):
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.wav(payload, len(raw))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(payload))


def test_round_trip(spark, small, tmp_path):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = media.op3_media(spark, small).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    own = odd(spark)
    rows = media.op3_media(spark, folder(spark, tmp_path, own)).collect()
    assert len(rows) == 12
    check([r for r in rows if r.doc_id is not None], {r.doc_id: r.text for r in own.collect()})
    assert sum(r.doc_id is None for r in rows) == 2


def test_empty_table(spark, tmp_path):
    assert media.op3_media(spark, folder(spark, tmp_path, none(spark))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 128])
def test_padding(n):
    payload, length = media.padded("x" * n)
    assert length == n and len(payload) % 64 == 0 and len(payload) >= max(64, n) and len(payload) - n < 64 + (n == 0)
    assert media.samples(media.wav(payload, n)) == (payload, n)
    with pytest.raises(ValueError):
        media.samples(media.wav(payload, n)[:-1])


def test_ranges_split_members_without_loss(spark):
    where = scratch_path(spark, "media-test")
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(200)], "doc_id long, text string").coalesce(2)
    assert media.stored(docs, where) == 200
    found = media.read(spark, where, range=1000)
    assert found.rdd.getNumPartitions() > 10
    assert found.where("error is null and tries = 1").count() == 200 and found.select("member", "archive").distinct().count() == 200


def test_a_broken_member_is_tried_again_alone(spark):
    where = scratch_path(spark, "media-broken")
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(5)], "doc_id long, text string").coalesce(1)
    media.stored(docs, where)
    fs, root = pafs.FileSystem.from_uri(where)
    (path,) = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".zip")]
    data = bytearray(open(path, "rb").read())
    offset = media.read(spark, where).orderBy("offset").collect()[2].offset
    data[offset + 80] ^= 0xFF
    open(path, "wb").write(data)
    rows = media.read(spark, where, tries=2).collect()
    assert sorted((r.error is None, r.tries) for r in rows) == [(False, 2)] + [(True, 1)] * 4
    assert media.examined(media.read(spark, where)).where("media_sha256 is null and error is not null").count() == 1
    assert media.examined(media.read(spark, where)).where("error is null").count() == 4


def test_a_read_that_fails_once_recovers():
    reader = media.ArchiveReader({"path": "file:///nowhere", "tries": "3"})

    class Archive:
        def read(self, _):
            raise OSError("lost")

    class Files:
        def open_input_file(self, _):
            raise OSError("still lost")

    assert reader.member(Files(), "x", Archive(), None)[:2] == (None, 3)
