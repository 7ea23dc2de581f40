"""Frame files as Spark sources: raw NV12 records and motion-JPEG streams, read by ranges of bytes.

A file is dealt to tasks in ranges of about range_bytes, whatever its size, and a task holds a frame and a chunk of its
range at a time. NV12 ranges end between frames. A JPEG image belongs to the range in which it begins: the scan is
outside an image after an end marker and inside one after a start marker, whichever came last, so a task finds how its
range begins from the last marker before it, and reads on past its end to the end of its last image. Frames then are
the same as in one scan from the start of the file.

Files are opened through Arrow's file systems (local paths, file:, hdfs:, s3:, gs:). As streams, sources pass on what
has come since: whole frames that a growing NV12 file has gained, and JPEG files that are new.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RANGE_BYTES, CHUNK = 64 << 20, 1 << 20
SOI, EOI = b"\xff\xd8", b"\xff\xd9"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files but hidden ones, in order of names."""
    where, name = _at(path)
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    info = where.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [x for x in where.get_file_info(fs.FileSelector(name, recursive=True)) if x.type == fs.FileType.File]
    full = lambda p: scheme + p if scheme and not p.startswith(scheme) else p
    return sorted((full(x.path), int(x.size)) for x in found if not x.base_name.startswith((".", "_")))


@dataclass
class Range(InputPartition):
    """Bytes start to stop of a file, its `part`th range."""

    path: str
    part: int
    start: int
    stop: int


def ranges(path: str, start: int, stop: int, most: int) -> list[Range]:
    n = max(1, -(-(stop - start) // most))
    cuts = [start + (stop - start) * k // n for k in range(n + 1)]
    return [Range(path, k, a, z) for k, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]


class JpegSplitter:
    """Whole JPEG images out of chunks of a stream, however they are cut, each with the place where it begins."""

    def __init__(self, at: int = 0):
        self.rest, self.at = b"", at

    def push(self, chunk: bytes) -> list[bytes]:
        return [image for _, image in self.placed(chunk)]

    def placed(self, chunk: bytes) -> list[tuple[int, bytes]]:
        data, out, pos, seen = self.rest + chunk, [], 0, len(self.rest)
        while True:
            start = data.find(SOI, pos)
            if start < 0:
                keep = len(data) - 1 if data.endswith(b"\xff") and len(data) > pos else len(data)
                break
            # of an image that was open before, what was there has been looked through
            end = data.find(EOI, max(start + 2, seen - 1) if start == 0 else start + 2)
            if end < 0:
                keep = start
                break
            out.append((self.at + start, data[start : end + 2]))
            pos = end + 2
        self.rest, self.at = data[keep:], self.at + keep
        return out


def inside_image(f: pa.NativeFile, at: int, chunk: int = CHUNK) -> bool:
    """Whether a scan from the start of the file is inside an image at this place: the last marker that begins before
    it is one of a start."""
    stop = at
    while stop > 0:
        begin = max(0, stop - chunk)
        f.seek(begin)
        data = f.read(stop - begin + 1)  # a marker that begins before the place may end on it
        last = max((data.rfind(SOI, 0, stop - begin + 1), 1), (data.rfind(EOI, 0, stop - begin + 1), 0))
        if last[0] >= 0:
            return last[1] == 1
        stop = begin
    return False


def jpeg_images(f: pa.NativeFile, start: int, stop: int, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(place, image) of the images that begin in a range of a file."""
    if start > 0 and inside_image(f, start, chunk):
        at = start
        while True:
            f.seek(at)
            data = f.read(chunk)
            end = data.find(EOI)
            if end >= 0:
                start = at + end + 2
                break
            if len(data) < 2:
                return
            at += len(data) - 1
    if start >= stop:
        return
    split = JpegSplitter(start)
    f.seek(start)
    while data := f.read(chunk):
        for place, image in split.placed(data):
            if place >= stop:
                return
            yield place, image
        if split.at >= stop:  # what is open begins past the range
            return


def _rows(path: str, part: int, found: Iterator[tuple[int, bytes]], keep: bool, rows_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches (path, part, n, place, jpeg) of about rows_bytes."""
    n, places, images, size = 0, [], [], 0

    def batch() -> pa.RecordBatch:
        k = len(places)
        return pa.RecordBatch.from_arrays([pa.array([path] * k), pa.array([part] * k, pa.int32()), pa.array(range(n - k, n), pa.int64()), pa.array(places, pa.int64()), pa.array(images if keep else [None] * k, pa.binary())], names=["path", "part", "n", "place", "jpeg"])

    for place, image in found:
        n += 1
        places.append(place)
        images.append(image if keep else b"")
        size += len(image) if keep else 16
        if size >= rows_bytes:
            yield batch()
            places, images, size = [], [], 0
    if places:
        yield batch()


class _Options:
    def __init__(self, options):
        self.path = options["path"]
        self.most = int(options.get("range_bytes", RANGE_BYTES))
        self.w, self.h = int(options.get("w", 0)), int(options.get("h", 0))
        self.keep = options.get("index_only", "false").lower() != "true"

    @property
    def frame(self) -> int:
        return self.w * self.h * 3 // 2


def _nv12(o: _Options, r: Range) -> Iterator[pa.RecordBatch]:
    where, name = _at(r.path)
    with where.open_input_file(name) as f:
        per = max(1, (8 << 20) // o.frame)
        for k in range(r.start, r.stop, per * o.frame):
            f.seek(k)
            raw = f.read(min(per * o.frame, r.stop - k))
            n = len(raw) // o.frame
            side = lambda x: pa.array([x] * n, pa.int32())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array([r.path] * n), pa.array(range(k // o.frame, k // o.frame + n), pa.int64()), side(o.w), side(o.h), pa.array([raw[i * o.frame : (i + 1) * o.frame] for i in range(n)], pa.binary())], names=["path", "frame_idx", "w", "h", "nv12"])


def _nv12_ranges(o: _Options, path: str, start: int, stop: int) -> list[Range]:
    """Ranges that end between frames; a last, short frame is in none."""
    per = max(1, o.most // o.frame) * o.frame
    stop = stop // o.frame * o.frame
    return [Range(path, k, a, min(a + per, stop)) for k, a in enumerate(range(start, stop, per))]


def _mjpeg(o: _Options, r: Range) -> Iterator[pa.RecordBatch]:
    where, name = _at(r.path)
    with where.open_input_file(name) as f:
        yield from _rows(r.path, r.part, jpeg_images(f, r.start, r.stop), o.keep)


class _Reader(DataSourceReader):
    def __init__(self, o: _Options, split, read):
        self.o, self.split, self.each = o, split, read

    def partitions(self) -> list[Range]:
        return [r for path, size in listed(self.o.path) for r in self.split(self.o, path, 0, size)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.each(self.o, partition) if partition.path else iter(())


class _Growing(DataSourceStreamReader):
    """Offsets are the bytes of each file that were passed on."""

    def __init__(self, o: _Options, split, read, whole):
        self.o, self.split, self.each, self.whole = o, split, read, whole

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": json.dumps({path: self.whole(self.o, size) for path, size in listed(self.o.path)})}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        was, now = json.loads(start["files"]), json.loads(end["files"])
        return [r for path, stop in sorted(now.items()) for r in self.split(self.o, path, was.get(path, 0), stop)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.each(self.o, partition) if partition.path else iter(())


class Nv12Files(DataSource):
    """format("veilframe_nv12"), options w, h and range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "veilframe_nv12"

    def schema(self) -> str:
        return "path string, frame_idx long, w int, h int, nv12 binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Options(self.options), _nv12_ranges, _nv12)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Growing(_Options(self.options), _nv12_ranges, _nv12, lambda o, size: size // o.frame * o.frame)


def _jpeg_ranges(o: _Options, path: str, start: int, stop: int) -> list[Range]:
    return ranges(path, start, stop, o.most)


class JpegFiles(DataSource):
    """format("veilframe_mjpeg"), options range_bytes and index_only (no bytes of images)."""

    @classmethod
    def name(cls) -> str:
        return "veilframe_mjpeg"

    def schema(self) -> str:
        return "path string, part int, n long, place long, jpeg binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Options(self.options), _jpeg_ranges, _mjpeg)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Growing(_Options(self.options), _jpeg_ranges, _mjpeg, lambda o, size: size)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Nv12Files)
    spark.dataSource.register(JpegFiles)


def nv12_records(spark: SparkSession, path: str, w: int, h: int, range_bytes: int = RANGE_BYTES, stream: bool = False) -> DataFrame:
    """(path, frame_idx, w, h, nv12) of raw files of w * h * 3 / 2 bytes a frame; a last, short frame is left out.

    Sides must be even: chroma has half of each."""
    if w % 2 or h % 2:
        raise ValueError("NV12 frames have even sides")
    register(spark)
    reader = spark.readStream if stream else spark.read
    return reader.format("veilframe_nv12").option("w", str(w)).option("h", str(h)).option("range_bytes", str(range_bytes)).load(path)


def jpeg_frames(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, frame_idx, jpeg) of motion-JPEG files. Ranges are counted first, so that each knows its first number."""
    register(spark)
    read = lambda only: spark.read.format("veilframe_mjpeg").option("range_bytes", str(range_bytes)).option("index_only", only).load(path)
    counts = read("true").groupBy("path", "part").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("path", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))  # a row a range
    return read("false").join(F.broadcast(first), ["path", "part"]).select("path", (F.col("first") + F.col("n")).alias("frame_idx"), "jpeg")
