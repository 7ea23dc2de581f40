"""Frame files in ranges of bytes: the same frames however a file is cut, and from growing files as streams."""

import io
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilframe.sources import frames

SOI, EOI = b"\xff\xd8", b"\xff\xd9"
#: Junk, an image with a start marker inside, empty images, stuffed bytes, lone marker halves, an image that never ends.
ODD = b"junk\xff" + SOI + b"one" + SOI + b"thumb" + EOI + b"\xff\xff\xd8two\xff\x00\xff" + EOI + SOI + EOI + EOI + b"\xd8\xff" + SOI + b"three" + EOI + b"\xff\xd9" + SOI + b"open\xff"


def whole(data, chunk=1 << 20):
    split = frames.JpegSplitter()
    return [x for i in range(0, len(data), chunk) for x in split.placed(data[i : i + chunk])]


def test_splitter_at_every_cut():
    want = whole(ODD)
    assert [x for _, x in want] == [SOI + b"one" + SOI + b"thumb" + EOI, b"\xff\xd8two\xff\x00\xff" + EOI, SOI + EOI, SOI + b"three" + EOI]
    assert all(ODD[p : p + len(x)] == x for p, x in want)
    for chunk in range(1, len(ODD) + 1):
        assert whole(ODD, chunk) == want


def test_ranges_at_every_boundary():
    """Two ranges meet at each byte in turn, and ranges of every size: each image is in exactly one."""
    want = whole(ODD)
    f = pa.PythonFile(io.BytesIO(ODD), mode="r")
    read = lambda a, z, chunk: list(frames.jpeg_images(f, a, z, chunk))
    for chunk in (2, 3, 7, 64):
        for cut in range(len(ODD) + 1):
            assert read(0, cut, chunk) + read(cut, len(ODD), chunk) == want, (cut, chunk)
        for size in range(1, 12):
            assert [x for a in range(0, len(ODD), size) for x in read(a, min(a + size, len(ODD)), chunk)] == want


def test_random_files():
    random.seed(6)
    for _ in range(60):
        data = b"".join(random.choice([SOI, EOI, b"\xff", b"\xd8", b"\xd9", b"ab"]) for _ in range(random.randint(0, 40)))
        f = pa.PythonFile(io.BytesIO(data), mode="r")
        for size in (1, 5, 17):
            assert [x for a in range(0, len(data), size) for x in frames.jpeg_images(f, a, min(a + size, len(data)), 3)] == whole(data)


def test_jpeg_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    images = [SOI + rng.integers(0, 200, int(n)).astype(np.uint8).tobytes() + EOI for n in rng.integers(0, 3000, 200)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.mjpeg").write_bytes(b"x".join(images))
    (tmp_path / "j" / "b.mjpeg").write_bytes(images[3] * 2)
    (tmp_path / "j" / "empty.mjpeg").write_bytes(b"")
    got = frames.jpeg_frames(spark, str(tmp_path / "j"), range_bytes=5000)
    rows = sorted((r.path.rsplit("/", 1)[1], r.frame_idx, bytes(r.jpeg)) for r in got.collect())
    assert rows == [("a.mjpeg", i, x) for i, x in enumerate(images)] + [("b.mjpeg", i, images[3]) for i in range(2)]
    # read by several tasks, none of which holds the file
    tasks = got.groupBy("path", F.spark_partition_id()).count().where("path LIKE '%a.mjpeg'").count()
    assert tasks > 4


def test_nv12_files(spark, tmp_path):
    size = 4 * 2 * 3 // 2
    data = [bytes([i % 250] * size) for i in range(100)]
    (tmp_path / "a.raw").write_bytes(b"".join(data) + b"short")
    got = frames.nv12_records(spark, str(tmp_path / "a.raw"), 4, 2, range_bytes=7 * size + 5)
    assert got.rdd.getNumPartitions() == 15
    assert [(r.frame_idx, bytes(r.nv12), r.w, r.h) for r in got.orderBy("frame_idx").collect()] == [(i, x, 4, 2) for i, x in enumerate(data)]
    assert frames.nv12_records(spark, "file://" + str(tmp_path / "a.raw"), 4, 2).count() == 100
    (tmp_path / "none").mkdir()
    assert frames.nv12_records(spark, str(tmp_path / "none"), 4, 2).count() == 0
    with pytest.raises(ValueError):
        frames.nv12_records(spark, str(tmp_path / "a.raw"), 3, 2)


def test_growing_files_as_a_stream(spark, tmp_path):
    size = 4 * 2 * 3 // 2
    (tmp_path / "in").mkdir()
    path = tmp_path / "in" / "cam.raw"
    data = [bytes([i] * size) for i in range(10)]

    def run():
        frames.nv12_records(spark, str(tmp_path / "in"), 4, 2, range_bytes=3 * size, stream=True).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return [(r.frame_idx, bytes(r.nv12)) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("path", "frame_idx").collect()]

    path.write_bytes(b"".join(data[:4]) + data[4][:5])  # a frame that is still being written
    assert run() == list(enumerate(data[:4]))
    path.write_bytes(b"".join(data))
    (tmp_path / "in" / "new.raw").write_bytes(data[0])
    assert run() == [*enumerate(data), (0, data[0])]
