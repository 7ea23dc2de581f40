"""Queries of mask algebra, run lengths and compositing, over 64 x 64 frames of rectangles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.groups import pieces
from ..functions.shared import spread
from ..operators import assemble, frames, masks
from ..registry import query
from ..sources.fixtures import view

S = 64
_EDITS = ", edits AS (SELECT seq, frame_idx, op, (py + a.d)::INT AS y, (px + b.d)::INT AS x FROM patches, (SELECT unnest(range(0, 6)) AS d) a, (SELECT unnest(range(0, 6)) AS d) b WHERE a.d < side AND b.d < side)"


def _edits(spark, sf_dir):
    """Edits as masks of their squares."""
    x, y, n = F.col("px"), F.col("py"), F.col("side")
    return view(spark, sf_dir, "patches").select("seq", "frame_idx", "op", F.lit(S).alias("w"), F.lit(S).alias("h"), masks.rectangle(x, y, x + n, y + n, S, S).alias("spans"))


def _masks(spark, sf_dir):
    """The mask of every frame of rectangles."""
    x, y = F.col("rx"), F.col("ry")
    return masks.union(view(spark, sf_dir, "rects").select("frame_idx", F.lit(S).alias("w"), F.lit(S).alias("h"), masks.rectangle(x, y, x + F.col("rw"), y + F.col("rh"), S, S).alias("spans")))


COUNT = "SELECT frame_idx, count(*)::BIGINT AS n_px, sum(x)::BIGINT AS sum_x, sum(y)::BIGINT AS sum_y FROM {t} GROUP BY frame_idx"


@query("mask_union", f"""-- views: pixels patches
{_EDITS}, m AS (SELECT frame_idx, y, x FROM pixels UNION SELECT frame_idx, y, x FROM edits) {COUNT.format(t='m')}""")
def mask_union(spark, sf_dir):
    """The pixels of a frame's mask and of its edits, each once."""
    return masks.numbers(masks.union(_masks(spark, sf_dir), _edits(spark, sf_dir)))


@query("mask_bbox", """-- views: pixels
SELECT frame_idx, greatest(min(x) - 4, 0)::INT AS bx1, greatest(min(y) - 4, 0)::INT AS by1, least(max(x) + 5, 64)::INT AS bx2, least(max(y) + 5, 64)::INT AS by2 FROM pixels GROUP BY frame_idx""")
def mask_bbox(spark, sf_dir):
    return masks.bounds(_masks(spark, sf_dir), 4)


@query("mask_coverage", "-- views: pixels\nSELECT frame_idx, round(100.0::DOUBLE * count(*) / 4096, 6) AS coverage_pct FROM pixels GROUP BY frame_idx")
def mask_coverage(spark, sf_dir):
    return _masks(spark, sf_dir).select("frame_idx", F.round(F.lit(100.0) * masks.area(F.col("spans")) / (F.col("w") * F.col("h")), 6).alias("coverage_pct"))


@query("mask_diff_patches", f"""-- views: pixels patches
{_EDITS}, want AS (SELECT DISTINCT frame_idx, y, x FROM edits WHERE op = 'add'),
d AS (SELECT 'add' AS op, * FROM (SELECT * FROM want EXCEPT SELECT * FROM pixels) UNION ALL SELECT 'erase', * FROM (SELECT * FROM pixels WHERE frame_idx IN (SELECT frame_idx FROM want) EXCEPT SELECT * FROM want))
SELECT op, frame_idx, count(*)::BIGINT AS n_px, sum(x)::BIGINT AS sum_x FROM d GROUP BY op, frame_idx""")
def mask_diff_patches(spark, sf_dir):
    """The pixels that an accepted mask adds to and takes from a frame's own."""
    want = masks.union(_edits(spark, sf_dir).where("op = 'add'"))
    have = _masks(spark, sf_dir)
    added = masks.numbers(masks.difference(want, have)).withColumn("op", F.lit("add"))
    taken = masks.numbers(masks.difference(have.join(want.select("frame_idx"), "frame_idx", "left_semi"), want)).withColumn("op", F.lit("erase"))
    return added.unionByName(taken).select("op", "frame_idx", "n_px", "sum_x")


@query("patch_replay", f"""-- views: pixels patches
{_EDITS}, last AS (SELECT frame_idx, y, x, arg_max(op, seq) AS op FROM edits GROUP BY ALL),
m AS (SELECT coalesce(p.frame_idx, l.frame_idx) AS frame_idx, coalesce(p.y, l.y) AS y, coalesce(p.x, l.x) AS x FROM pixels p FULL JOIN last l ON p.frame_idx = l.frame_idx AND p.y = l.y AND p.x = l.x WHERE CASE WHEN l.op IS NULL THEN true ELSE l.op = 'add' END)
{COUNT.format(t='m')}""")
def patch_replay(spark, sf_dir):
    return masks.numbers(masks.replay(_masks(spark, sf_dir), _edits(spark, sf_dir)))


@query("dilate_n", f"""-- views: pixels
, m AS (SELECT DISTINCT frame_idx, y + a.d AS y, x + b.d AS x FROM pixels, (SELECT unnest(range(-3, 4)) AS d) a, (SELECT unnest(range(-3, 4)) AS d) b WHERE y + a.d BETWEEN 0 AND 63 AND x + b.d BETWEEN 0 AND 63) {COUNT.format(t='m')}""")
def dilate_n(spark, sf_dir):
    return _mask_counts(frames.each(_painted(spark, sf_dir), lambda nv12, mask, w, h: assemble.grown(np.frombuffer(mask, np.uint8).reshape(h, w), 3).tobytes(), "mask"))


@query("erode_n", f"""-- views: pixels
, n AS (SELECT p.frame_idx, p.y, p.x, count(q.x) AS c FROM pixels p, (SELECT unnest(range(-2, 3)) AS d) a, (SELECT unnest(range(-2, 3)) AS d) b LEFT JOIN pixels q ON q.frame_idx = p.frame_idx AND q.y = p.y + a.d AND q.x = p.x + b.d GROUP BY ALL),
m AS (SELECT * FROM n WHERE c = (least(x + 2, 63) - greatest(x - 2, 0) + 1) * (least(y + 2, 63) - greatest(y - 2, 0) + 1)) {COUNT.format(t='m')}""")
def erode_n(spark, sf_dir):
    return _mask_counts(frames.each(_painted(spark, sf_dir), lambda nv12, mask, w, h: assemble.shrunk(np.frombuffer(mask, np.uint8).reshape(h, w), 2).tobytes(), "mask"))


@query("shift_mask", f"""-- views: pixels
, m AS (SELECT frame_idx, y + frame_idx % 5 - 2 AS y, x + frame_idx % 7 - 3 AS x FROM pixels WHERE y + frame_idx % 5 - 2 BETWEEN 0 AND 63 AND x + frame_idx % 7 - 3 BETWEEN 0 AND 63) {COUNT.format(t='m')}""")
def shift_mask(spark, sf_dir):
    return masks.numbers(masks.shift(_masks(spark, sf_dir), F.col("frame_idx") % 7 - 3, F.col("frame_idx") % 5 - 2))


@query("smooth_prev", f"""-- views: pixels frames
, g AS (SELECT DISTINCT frame_idx + 1 AS frame_idx, y + a.d AS y, x + b.d AS x FROM pixels, (SELECT unnest(range(-1, 2)) AS d) a, (SELECT unnest(range(-1, 2)) AS d) b WHERE y + a.d BETWEEN 0 AND 63 AND x + b.d BETWEEN 0 AND 63),
m AS (SELECT frame_idx, y, x FROM pixels UNION SELECT frame_idx, y, x FROM g WHERE frame_idx IN (SELECT frame_idx FROM frames)) {COUNT.format(t='m')}""")
def smooth_prev(spark, sf_dir):
    """Masks with that of the frame before, grown; also of frames whose own mask is empty."""
    return masks.numbers(masks.smoothed(_masks(spark, sf_dir), view(spark, sf_dir, "frames")))


RUNS_SQL = """-- views: pixels
, f AS (SELECT DISTINCT frame_idx FROM pixels), g AS (SELECT f.frame_idx, p FROM f, (SELECT unnest(range(0, 4096)) AS p)),
v AS (SELECT g.frame_idx, g.p, CASE WHEN q.x IS NULL THEN 0 ELSE 1 END AS val FROM g LEFT JOIN pixels q ON q.frame_idx = g.frame_idx AND q.y * 64 + q.x = g.p),
c AS (SELECT *, CASE WHEN val IS DISTINCT FROM lag(val) OVER w THEN 1 ELSE 0 END AS edge FROM v WINDOW w AS (PARTITION BY frame_idx ORDER BY p)),
r AS (SELECT frame_idx, val, sum(edge) OVER (PARTITION BY frame_idx ORDER BY p) AS run FROM c)
"""


@query("rle_encode", RUNS_SQL + "SELECT frame_idx, run::INT AS run, count(*)::INT AS len, any_value(val)::INT AS val FROM r GROUP BY frame_idx, run")
def rle_encode(spark, sf_dir):
    m = _masks(spark, sf_dir).select("frame_idx", F.posexplode(masks.run_lengths(F.col("spans"), F.col("w"), F.col("h"))).alias("run", "r"))
    return m.select("frame_idx", (F.col("run") + 1).alias("run"), "r.len", "r.val")


@query("rle_decode", "-- views: pixels\n" + COUNT.format(t="pixels"))
def rle_decode(spark, sf_dir):
    """Run lengths in their file form and back: the frame's own pixels."""
    return masks.numbers(masks.from_files(masks.to_files(_masks(spark, sf_dir))))


@query("rle_validate", RUNS_SQL + ", n AS (SELECT frame_idx, run, count(*) AS len FROM r GROUP BY ALL) SELECT frame_idx, frame_idx % 10 <> 3 AS is_valid, (4 + 5 * count(*))::INT AS file_bytes, frame_idx % 10 <> 4 AS reads_back FROM n GROUP BY frame_idx")
def rle_validate(spark, sf_dir):
    """Run lists checked against the frame's size, and through their file form; some are spoiled on purpose."""
    m = _masks(spark, sf_dir)
    files = masks.to_files(m).select("frame_idx", "w", "h", "data")
    k = F.col("frame_idx") % 10
    spoiled = files.withColumn("data", F.when(k == 4, F.substring("data", F.lit(1), F.length("data") - 2)).otherwise(F.col("data")))
    read = masks.from_files(spoiled).select("frame_idx", "whole", F.col("spans").alias("again"))
    size = files.select("frame_idx", F.length("data").alias("file_bytes"))
    valid = masks.rle_valid(masks.run_lengths(F.col("spans"), F.col("w"), F.col("h")), F.col("w"), F.col("h") + F.when(k == 3, 1).otherwise(0))
    return m.join(read, "frame_idx").join(size, "frame_idx").select("frame_idx", valid.alias("is_valid"), "file_bytes", (F.col("whole") & (F.col("again") == F.col("spans"))).alias("reads_back"))


#: Every frame with a mask as luma p (frame_idx, y, x, v, m) and chroma q (frame_idx, y, x, u, w, any4, one), and its mask's box.
GRID_SQL = """-- views: pixels
, k AS (SELECT DISTINCT frame_idx FROM pixels), g AS (SELECT frame_idx, y, x, ((73 * x + 151 * y + (x * y) % 17 + frame_idx * 7) % 256)::INT AS v FROM k, (SELECT unnest(range(0, 64)) AS y) a, (SELECT unnest(range(0, 64)) AS x) b),
p AS (SELECT g.*, CASE WHEN q.x IS NULL THEN 0 ELSE 1 END AS m FROM g LEFT JOIN pixels q ON q.frame_idx = g.frame_idx AND q.y = g.y AND q.x = g.x),
q AS (SELECT frame_idx, y // 2 AS y, x // 2 AS x, ((11 * (x // 2) + 5 * (y // 2) + frame_idx * 3) % 256)::INT AS u, ((7 * (x // 2) + 13 * (y // 2) + frame_idx * 5) % 256)::INT AS w, max(m) AS any4, max(m) FILTER (WHERE y % 2 = 0 AND x % 2 = 0) AS one FROM p GROUP BY ALL),
e AS (SELECT frame_idx, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2 FROM p WHERE m = 1 GROUP BY frame_idx),
"""


def _boxes_sql(pad: int) -> str:
    return f"""b AS (SELECT frame_idx, greatest(x1 - {pad}, 0) AS x1, greatest(y1 - {pad}, 0) AS y1, least(x2 + {pad}, 64) AS x2, least(y2 + {pad}, 64) AS y2 FROM e),
bh AS (SELECT frame_idx, x1 // 2 AS x1, y1 // 2 AS y1, (x2 + 1) // 2 AS x2, (y2 + 1) // 2 AS y2 FROM b),
"""


def _mosaic_sql(out: str, plane: str, box: str, hit: str, cell: int, *values: str) -> str:
    """Blocks' whole-number means over all pixels in the box, written where hit."""
    means = ", ".join(f"sum({v}) // count(*) AS m_{v}" for v in values)
    new = ", ".join(f"CASE WHEN {hit} = 1 THEN m_{v} ELSE {v} END AS {v}" for v in values)
    return f"""{out}c AS (SELECT t.frame_idx, (x - x1) // {cell} AS cx, (y - y1) // {cell} AS cy, {means} FROM {plane} t JOIN {box} z ON z.frame_idx = t.frame_idx AND x >= x1 AND x < x2 AND y >= y1 AND y < y2 GROUP BY ALL),
{out} AS (SELECT t.frame_idx, y, x, {new} FROM {plane} t JOIN {box} z ON z.frame_idx = t.frame_idx LEFT JOIN {out}c c ON c.frame_idx = t.frame_idx AND c.cx = (x - x1) // {cell} AND c.cy = (y - y1) // {cell} AND {hit} = 1)"""


def _blur_sql(out: str, plane: str, box: str, hit: str, r: int, v: str) -> str:
    """Window means along rows, with samples from the plane's left edge to the box's right one, then columns within the box."""
    d = f"(SELECT unnest(range({-r}, {r + 1})) AS d) d"
    return f"""{out}h AS (SELECT a.frame_idx, a.y, a.x, z.y1, z.y2, sum(b.{v}) // {2 * r + 1} AS b FROM {plane} a JOIN {box} z ON z.frame_idx = a.frame_idx AND a.x >= x1 AND a.x < x2 AND a.y >= y1 AND a.y < y2, {d} JOIN {plane} b ON b.frame_idx = a.frame_idx AND b.y = a.y AND b.x = least(greatest(a.x + d.d, 0), z.x2 - 1) GROUP BY ALL),
{out}w AS (SELECT a.frame_idx, a.y, a.x, sum(b.b) // {2 * r + 1} AS b FROM {out}h a, {d} JOIN {out}h b ON b.frame_idx = a.frame_idx AND b.x = a.x AND b.y = least(greatest(a.y + d.d, a.y1), a.y2 - 1) GROUP BY ALL),
{out} AS (SELECT t.frame_idx, t.y, t.x, CASE WHEN {hit} = 1 THEN w_.b ELSE {v} END AS {v} FROM {plane} t LEFT JOIN {out}w w_ ON w_.frame_idx = t.frame_idx AND w_.y = t.y AND w_.x = t.x)"""


def _digest_sql(luma: str, u: str, w: str) -> str:
    one = "SELECT frame_idx, sum({c})::BIGINT AS s, sum({c} * (x + {n} * y))::BIGINT AS t FROM {p} GROUP BY frame_idx"
    a, b, c = one.format(c="v", n=64, p=luma), one.format(c="u", n=32, p=u), one.format(c="w", n=32, p=w)
    return f" SELECT a.frame_idx, a.s AS sum_v, a.t AS moment, b.s AS sum_u, c.s AS sum_w, b.t + c.t AS moment_uv FROM ({a}) a JOIN ({b}) b ON a.frame_idx = b.frame_idx JOIN ({c}) c ON a.frame_idx = c.frame_idx"


def _painted(spark, sf_dir):
    """Every frame of rectangles as a row: NV12 bytes of a fixed pattern, and the mask of its rectangles (eight at most)."""
    lit = spread(view(spark, sf_dir, "rects"), "frame_idx").groupBy("frame_idx").agg(F.collect_list(F.struct("rx", "ry", "rw", "rh")).alias("rects"))

    def paint(batches):
        y, x = np.mgrid[0:S, 0:S]
        cy, cx = np.mgrid[0 : S // 2, 0 : S // 2]
        for b in pieces(batches):
            nv12, masks_ = [], []
            for k, rects in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                m = np.zeros((S, S), np.uint8)
                for r in rects:
                    m[r["ry"] : r["ry"] + r["rh"], r["rx"] : r["rx"] + r["rw"]] = 1
                luma = ((73 * x + 151 * y + (x * y) % 17 + k * 7) % 256).astype(np.uint8)
                uv = np.stack([(11 * cx + 5 * cy + k * 3) % 256, (7 * cx + 13 * cy + k * 5) % 256], axis=-1).astype(np.uint8)
                nv12.append(luma.tobytes() + uv.tobytes())
                masks_.append(m.tobytes())
            side = pa.array([S] * b.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), side, side, pa.array(nv12, pa.binary()), pa.array(masks_, pa.binary())], names=["frame_idx", "w", "h", "nv12", "mask"])

    return lit.mapInArrow(paint, "frame_idx long, w int, h int, nv12 binary, mask binary")


def _digest(frames_df):
    """Sums of each frame's planes, plain and by place: enough to tell frames apart."""

    def run(batches):
        at, half = np.arange(S * S).reshape(S, S), np.arange(S * S // 4).reshape(S // 2, S // 2)
        for b in pieces(batches):
            rows = []
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                y, uv = (p.astype(np.int64) for p in frames.planes(raw, S, S))
                rows.append((k, y.sum(), (y * at).sum(), uv[..., 0].sum(), uv[..., 1].sum(), (uv * half[..., None]).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 6)], names=["frame_idx", "sum_v", "moment", "sum_u", "sum_w", "moment_uv"])

    return frames_df.select("frame_idx", "nv12").mapInArrow(run, "frame_idx long, sum_v long, moment long, sum_u long, sum_w long, moment_uv long")


def _mask_counts(frames_df):
    """The columns of COUNT, from mask bytes; frames without a masked pixel give no row."""

    def run(batches):
        for b in pieces(batches):
            rows = []
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                y, x = np.nonzero(np.frombuffer(raw, np.uint8).reshape(S, S))
                if len(y):
                    rows.append((k, len(y), int(x.sum()), int(y.sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)], names=["frame_idx", "n_px", "sum_x", "sum_y"])

    return frames_df.select("frame_idx", "mask").mapInArrow(run, "frame_idx long, n_px long, sum_x long, sum_y long")


@query("compose_solid", GRID_SQL + "o AS (SELECT frame_idx, y, x, CASE WHEN m = 1 THEN 16 ELSE v END AS v FROM p), c AS (SELECT frame_idx, y, x, CASE WHEN any4 = 1 THEN 128 ELSE u END AS u, CASE WHEN any4 = 1 THEN 128 ELSE w END AS w FROM q)" + _digest_sql("o", "c", "c"))
def compose_solid(spark, sf_dir):
    return _digest(frames.apply(_painted(spark, sf_dir), "solid"))


@query("compose_mosaic", GRID_SQL + _boxes_sql(6) + _mosaic_sql("o", "p", "b", "m", 6, "v") + ",\n" + _mosaic_sql("c", "q", "bh", "any4", 3, "u", "w") + _digest_sql("o", "c", "c"))
def compose_mosaic(spark, sf_dir):
    return _digest(frames.apply(_painted(spark, sf_dir), "mosaic", 6))


@query("box_blur", GRID_SQL + _boxes_sql(9) + _blur_sql("o", "p", "b", "m", 3, "v") + ",\n" + _blur_sql("cu", "q", "bh", "one", 2, "u") + ",\n" + _blur_sql("cw", "q", "bh", "one", 2, "w") + _digest_sql("o", "cu", "cw"))
def box_blur(spark, sf_dir):
    return _digest(frames.apply(_painted(spark, sf_dir), "blur", 3))


@query("rgb_to_nv12", GRID_SQL + """c AS (SELECT frame_idx, y, x, v AS r, (v * 3 + x) % 256 AS g, (v * 5 + y) % 256 AS b FROM p),
l AS (SELECT frame_idx, y, x, floor(16.0::DOUBLE + (r * 65.481::DOUBLE + g * 128.553::DOUBLE + b * 24.966::DOUBLE) / 255 + 0.5::DOUBLE)::BIGINT AS v FROM c),
z AS (SELECT frame_idx, y // 2 AS y, x // 2 AS x, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM c GROUP BY ALL),
t AS (SELECT frame_idx, y, x, floor(128.0::DOUBLE + (r * -37.797::DOUBLE + g * -74.203::DOUBLE + b * 112.0::DOUBLE) / 255 + 0.5::DOUBLE)::BIGINT AS u, floor(128.0::DOUBLE + (r * 112.0::DOUBLE + g * -93.786::DOUBLE + b * -18.214::DOUBLE) / 255 + 0.5::DOUBLE)::BIGINT AS w FROM z)""" + _digest_sql("l", "t", "t"))
def rgb_to_nv12(spark, sf_dir):
    def convert(nv12, mask, w, h):
        v = frames.planes(nv12, w, h)[0].astype(np.int64)
        y, x = np.mgrid[0:h, 0:w]
        return frames.rgb_to_nv12(np.stack([v, (v * 3 + x) % 256, (v * 5 + y) % 256], axis=-1))

    return _digest(frames.each(_painted(spark, sf_dir), convert))


_B = "least(greatest(floor({x} + 0.5::DOUBLE), 0), 255)::BIGINT"
_C = "(v - 16) * 1.164::DOUBLE"


@query("nv12_to_rgba", GRID_SQL + f"""c AS (SELECT p.frame_idx, p.y, p.x, p.v, q.u, q.w FROM p JOIN q ON q.frame_idx = p.frame_idx AND q.y = p.y // 2 AND q.x = p.x // 2),
o AS (SELECT frame_idx, x + 64 * y AS place, {_B.format(x=_C + ' + (w - 128) * 1.596::DOUBLE')} AS r, {_B.format(x=_C + ' - (u - 128) * 0.392::DOUBLE - (w - 128) * 0.813::DOUBLE')} AS g, {_B.format(x=_C + ' + (u - 128) * 2.017::DOUBLE')} AS b FROM c)
SELECT frame_idx, sum(r)::BIGINT AS sum_r, sum(g)::BIGINT AS sum_g, sum(b)::BIGINT AS sum_b, sum(place * (r + 2 * g + 3 * b))::BIGINT AS moment FROM o GROUP BY frame_idx""")
def nv12_to_rgba(spark, sf_dir):
    return _rgba_sums(frames.to_rgba(_painted(spark, sf_dir)))


def _rgba_sums(rows):
    """Sums of the channels of 64 x 64 RGBA pixels, and one by place."""

    def run(batches):
        at = np.arange(S * S)
        for b in pieces(batches):
            rows_ = []
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.frombuffer(raw, np.uint8).reshape(-1, 4).astype(np.int64)
                rows_.append((k, *c[:, :3].sum(axis=0).tolist(), int((at * (c[:, :3] @ [1, 2, 3])).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows_) if rows_ else [[]] * 5)], names=["frame_idx", "sum_r", "sum_g", "sum_b", "moment"])

    return rows.select("frame_idx", "rgba").mapInArrow(run, "frame_idx long, sum_r long, sum_g long, sum_b long, moment long")


@query("render_join", """-- views: frames pixels
, m AS (SELECT frame_idx, count(*) AS n FROM pixels GROUP BY frame_idx)
SELECT f.frame_idx, coalesce(m.n, 0)::BIGINT AS mask_px, m.n IS NULL AS passed_through FROM frames f LEFT JOIN m ON m.frame_idx = f.frame_idx""")
def render_join(spark, sf_dir):
    """Every frame with its mask, or passed through as it is where there is none."""
    m = masks.filled(_masks(spark, sf_dir)).select("frame_idx", masks.area(F.col("spans")).alias("n"))
    return view(spark, sf_dir, "frames").join(m, "frame_idx", "left").select("frame_idx", F.coalesce("n", F.lit(0)).cast("long").alias("mask_px"), F.col("n").isNull().alias("passed_through"))


@query("review_join", """-- views: rects pixels patches
, m AS (SELECT frame_idx, count(*) AS n FROM pixels GROUP BY frame_idx), e AS (SELECT frame_idx, count(*) AS n, max(seq) AS last FROM patches GROUP BY frame_idx), i AS (SELECT frame_idx, count(*) AS n FROM rects GROUP BY frame_idx)
SELECT i.frame_idx, i.n::BIGINT AS instances, coalesce(m.n, 0)::BIGINT AS mask_px, coalesce(e.n, 0)::BIGINT AS edits, e.last AS last_edit FROM i LEFT JOIN m ON m.frame_idx = i.frame_idx LEFT JOIN e ON e.frame_idx = i.frame_idx""")
def review_join(spark, sf_dir):
    count = lambda df, n, *more: df.groupBy("frame_idx").agg(F.count(F.lit(1)).alias(n), *more)
    i, m = count(view(spark, sf_dir, "rects"), "instances"), _masks(spark, sf_dir).select("frame_idx", masks.area(F.col("spans")).alias("mask_px"))
    e = count(view(spark, sf_dir, "patches"), "edits", F.max("seq").alias("last_edit"))
    out = i.join(m, "frame_idx", "left").join(e, "frame_idx", "left")
    return out.select("frame_idx", "instances", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("mask_px", "edits")), "last_edit")


def _soft_sql(out: str, table: str, value: str, k: int) -> str:
    """A Gaussian of k x k places over a value by frame_idx, y, x; nothing lies outside the frame."""
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    g = f"(SELECT d, e / sum(e) OVER () AS g FROM (SELECT d, exp(-(d * d) / (2.0::DOUBLE * {sigma} * {sigma})) AS e FROM (SELECT unnest(range({-(k // 2)}, {k // 2 + 1})) AS d)))"
    one = "SELECT t.frame_idx, {to}, sum(g * t.{v}) AS {o} FROM {t} t, {g} g WHERE {on} GROUP BY ALL"
    rows = one.format(to="t.y, t.x - d AS x", v=value, o="r", t=table, g=g, on="t.x - d BETWEEN 0 AND 63")
    return f"{out}r AS ({rows}), {out} AS ({one.format(to='t.y - d AS y, t.x', v='r', o='b', t=out + 'r', g=g, on='t.y - d BETWEEN 0 AND 63')})"


@query("feathered_blur", GRID_SQL + _soft_sql("s", "p", "v", 7) + ", " + _soft_sql("a", "p", "m", 5) + """, o AS (SELECT p.frame_idx, p.y, p.x, p.v * (1 - a.b) + s.b * a.b AS v FROM p JOIN s ON s.frame_idx = p.frame_idx AND s.y = p.y AND s.x = p.x JOIN a ON a.frame_idx = p.frame_idx AND a.y = p.y AND a.x = p.x)
SELECT frame_idx, round(sum(v), 4) AS sum_v, round(sum(v * (x + 64 * y)) / 4096, 4) AS moment FROM o GROUP BY frame_idx""")
def feathered_blur(spark, sf_dir):
    """Frames' luma blurred under their masks, with edges that fade."""
    from ..operators import drawing

    def run(batches):
        at = np.arange(S * S).reshape(S, S)
        for b in pieces(batches):
            made = [drawing.feathered(frames.planes(raw, S, S)[0], np.frombuffer(m, np.uint8).reshape(S, S), "blur", 7, 2) for raw, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([float(x.sum()) for x in made], pa.float64()), pa.array([float((x * at).sum()) / 4096 for x in made], pa.float64())], names=["frame_idx", "sum_v", "moment"])

    got = _painted(spark, sf_dir).select("frame_idx", "nv12", "mask").mapInArrow(run, "frame_idx long, sum_v double, moment double")
    return got.select("frame_idx", F.round("sum_v", 4).alias("sum_v"), F.round("moment", 4).alias("moment"))


@query("annotated_frames", GRID_SQL + f"""c AS (SELECT p.frame_idx, p.y, p.x, p.v, p.m, q.u, q.w FROM p JOIN q ON q.frame_idx = p.frame_idx AND q.y = p.y // 2 AND q.x = p.x // 2),
o AS (SELECT frame_idx, y, x, m, {_B.format(x=_C + ' + (w - 128) * 1.596::DOUBLE')} AS r, {_B.format(x=_C + ' - (u - 128) * 0.392::DOUBLE - (w - 128) * 0.813::DOUBLE')} AS g, {_B.format(x=_C + ' + (u - 128) * 2.017::DOUBLE')} AS b FROM c),
tk AS (SELECT frame_idx, y, x, CASE WHEN m = 1 THEN least(r * 3 // 4 + 60, 255) ELSE r END AS r, CASE WHEN m = 1 THEN least(g + 90, 255) ELSE g END AS g, CASE WHEN m = 1 THEN least(b * 3 // 4 + 20, 255) ELSE b END AS b FROM o),
l AS (SELECT frame_idx, rect_id, rx + a.x AS x, ry + c.y AS y FROM rects, (SELECT unnest(range(0, 17)) AS x) a, (SELECT unnest(range(0, 17)) AS y) c WHERE a.x <= rw AND c.y <= rh AND rx + a.x <= 63 AND ry + c.y <= 63 AND (a.x < 2 OR a.x + 2 > least(rw, 63 - rx) OR c.y < 2 OR c.y + 2 > least(rh, 63 - ry))),
t AS (SELECT frame_idx, x, y, max(rect_id) AS id FROM l GROUP BY ALL),
z AS (SELECT tk.frame_idx, tk.x + 64 * tk.y AS place, CASE WHEN t.id IS NULL THEN r ELSE ([255, 76, 255, 156, 0, 255, 121, 240])[(t.id % 8 + 1)::INT] END AS r, CASE WHEN t.id IS NULL THEN g ELSE ([76, 175, 165, 39, 230, 105, 85, 240])[(t.id % 8 + 1)::INT] END AS g, CASE WHEN t.id IS NULL THEN b ELSE ([76, 255, 0, 176, 118, 180, 72, 60])[(t.id % 8 + 1)::INT] END AS b FROM tk LEFT JOIN t ON t.frame_idx = tk.frame_idx AND t.x = tk.x AND t.y = tk.y)
SELECT frame_idx, sum(r)::BIGINT AS sum_r, sum(g)::BIGINT AS sum_g, sum(b)::BIGINT AS sum_b, sum(place * (r + 2 * g + 3 * b))::BIGINT AS moment FROM z GROUP BY frame_idx""".replace("-- views: pixels", "-- views: pixels rects"))
def annotated_frames(spark, sf_dir):
    """Every frame with its mask as a tint and its rectangles bordered in the colours of their numbers."""
    from ..operators import drawing

    x, y = F.col("rx").cast("double"), F.col("ry").cast("double")
    boxes = view(spark, sf_dir, "rects").groupBy("frame_idx").agg(F.sort_array(F.collect_list(F.struct(F.col("rect_id").alias("track_id"), x.alias("x1"), y.alias("y1"), (x + F.col("rw")).alias("x2"), (y + F.col("rh")).alias("y2")))).alias("boxes"))
    rows = _painted(spark, sf_dir).select("frame_idx", "w", "h", "nv12").join(_masks(spark, sf_dir).select("frame_idx", "spans"), "frame_idx").join(boxes, "frame_idx")
    return _rgba_sums(drawing.annotated(rows, 2))


@query("polygon_fill", """WITH c AS (SELECT p_partkey AS k, [(p_partkey * 7) % 40, (p_partkey * 5) % 24 + 40, (p_partkey * 3) % 60, (p_partkey * 11) % 50 + 4] AS xs, [(p_partkey * 13) % 20, (p_partkey * 17) % 40, (p_partkey * 19) % 30 + 34, (p_partkey * 23) % 60] AS ys FROM part),
e AS (SELECT k, xs[i] AS x1, ys[i] AS y1, xs[i % 4 + 1] AS x2, ys[i % 4 + 1] AS y2 FROM c, (SELECT unnest(range(1, 5)) AS i)),
r AS (SELECT k, t.y, x1 + (t.y - y1) * (x2 - x1)::DOUBLE / (y2 - y1) AS x FROM e, (SELECT unnest(range(0, 64)) AS y) t WHERE t.y >= least(y1, y2) AND t.y < greatest(y1, y2)),
n AS (SELECT k, y, x, row_number() OVER (PARTITION BY k, y ORDER BY x) AS i FROM r), s AS (SELECT a.k, a.y, greatest(ceil(a.x), 0)::BIGINT AS lo, least(floor(b.x) + 1, 64)::BIGINT AS hi FROM n a JOIN n b ON b.k = a.k AND b.y = a.y AND b.i = a.i + 1 WHERE a.i % 2 = 1),
m AS (SELECT DISTINCT s.k, s.y, t.x FROM s, (SELECT unnest(range(0, 64)) AS x) t WHERE t.x >= lo AND t.x < hi)
SELECT k AS p_partkey, count(*)::BIGINT AS n_px, sum(x)::BIGINT AS sum_x, sum(y)::BIGINT AS sum_y FROM m GROUP BY k""")
def polygon_fill(spark, sf_dir):
    """A four-sided polygon for each part, some of which cross themselves."""
    from ..operators import drawing

    k = F.col("p_partkey")
    at = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    points = F.array(at(k * 7 % 40, k * 13 % 20), at(k * 5 % 24 + 40, k * 17 % 40), at(k * 3 % 60, k * 19 % 30 + 34), at(k * 11 % 50 + 4, k * 23 % 60))
    return masks.numbers(drawing.polygons(spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), "p_partkey").select("p_partkey", points.alias("points")), S, S), ("p_partkey",))
