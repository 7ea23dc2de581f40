"""Queries of geometry and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..registry import query
from ..sources.fixtures import FRAME_H, FRAME_W, view

W, H = FRAME_W, FRAME_H


@query("letterbox_params", """-- views: boxes
SELECT det_id, round(scale, 6) AS scale, new_w, new_h, ((640 - new_w) // 2)::INT AS pad_x, ((640 - new_h) // 2)::INT AS pad_y FROM (
  SELECT det_id, 640.0::DOUBLE / greatest(w, h) AS scale, round(w * (640.0::DOUBLE / greatest(w, h)))::INT AS new_w, round(h * (640.0::DOUBLE / greatest(w, h)))::INT AS new_h
  FROM (SELECT det_id, x2 - x1 AS w, y2 - y1 AS h FROM boxes))""")
def letterbox_params(spark, sf_dir):
    b = view(spark, sf_dir, "boxes")
    p = G.letterbox(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), 640)
    return b.select("det_id", F.round(p["scale"], 6).alias("scale"), *(p[k].alias(k) for k in ("new_w", "new_h", "pad_x", "pad_y")))


@query("unletterbox_box", """-- views: boxes
, u AS (SELECT det_id, src = 1 AS flip, greatest(least((x1 - 0) * 3.0::DOUBLE, 1920), 0) AS a, greatest(least((y1 - 140) * 3.0::DOUBLE, 1080), 0) AS b,
  greatest(least((x2 - 0) * 3.0::DOUBLE, 1920), 0) AS c, greatest(least((y2 - 140) * 3.0::DOUBLE, 1080), 0) AS d FROM boxes)
SELECT det_id, round(CASE WHEN flip THEN greatest(1919 - c, 0) ELSE a END, 6)::DOUBLE AS x1, round(b, 6)::DOUBLE AS y1, round(CASE WHEN flip THEN greatest(1919 - a, 0) ELSE c END, 6)::DOUBLE AS x2, round(d, 6)::DOUBLE AS y2 FROM u""")
def unletterbox_box(spark, sf_dir):
    b = view(spark, sf_dir, "boxes")
    out = G.unletterbox(G.box(), F.lit(1 / 3.0), 0, 140, W, H, F.col("src") == 1)
    return b.select("det_id", *(F.round(c, 6).alias(n) for c, n in zip(out, ("x1", "y1", "x2", "y2"))))


@query("iou_with_previous", """-- views: boxes
, p AS (SELECT *, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, lag(x2) OVER w AS px2, lag(y2) OVER w AS py2 FROM boxes WINDOW w AS (PARTITION BY frame_idx ORDER BY det_id)),
i AS (SELECT *, greatest(least(x2, px2) - greatest(x1, px1), 0) * greatest(least(y2, py2) - greatest(y1, py1), 0) AS x FROM p WHERE px1 IS NOT NULL)
SELECT det_id, round(x / ((x2 - x1) * (y2 - y1) + (px2 - px1) * (py2 - py1) - x), 6) AS iou FROM i""")
def iou_with_previous(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("frame_idx").orderBy("det_id")
    b = view(spark, sf_dir, "boxes")
    b = b.select("det_id", *G_NAMES, *(F.lag(n).over(w).alias("p" + n) for n in G_NAMES)).where("px1 IS NOT NULL")
    return b.select("det_id", F.round(G.iou(G.box(), G.box("p")), 6).alias("iou"))


G_NAMES = ("x1", "y1", "x2", "y2")


@query("rect_mask_area", """-- views: boxes
, r AS (SELECT det_id, greatest(floor(x1 - (x2 - x1) * 0.05::DOUBLE), 0)::BIGINT AS a, greatest(floor(y1 - (y2 - y1) * 0.05::DOUBLE), 0)::BIGINT AS b,
  least(ceil(x2 + (x2 - x1) * 0.05::DOUBLE), 1920)::BIGINT AS c, least(ceil(y2 + (y2 - y1) * 0.05::DOUBLE), 1080)::BIGINT AS d FROM boxes)
SELECT det_id, a AS rx1, b AS ry1, greatest(c, a + 1) AS rx2, greatest(d, b + 1) AS ry2, (greatest(c, a + 1) - a) * (greatest(d, b + 1) - b) AS area FROM r""")
def rect_mask_area(spark, sf_dir):
    x1, y1, x2, y2 = G.rect_span(G.box(), 0.05, W, H)
    return view(spark, sf_dir, "boxes").select("det_id", x1.alias("rx1"), y1.alias("ry1"), x2.alias("rx2"), y2.alias("ry2"), ((x2 - x1) * (y2 - y1)).alias("area"))


@query("head_roi", """-- views: persons
SELECT det_id, round(least(greatest(x1 + (x2 - x1) * 0.08::DOUBLE, 0), 1920), 4)::DOUBLE AS hx1, round(least(greatest(y1 - (y2 - y1) * 0.05::DOUBLE, 0), 1080), 4)::DOUBLE AS hy1,
 round(least(greatest(x2 - (x2 - x1) * 0.08::DOUBLE, 0), 1920), 4)::DOUBLE AS hx2, round(least(greatest(y1 + (y2 - y1) * 0.3::DOUBLE, 0), 1080), 4)::DOUBLE AS hy2 FROM persons""")
def head_roi(spark, sf_dir):
    return view(spark, sf_dir, "persons").select("det_id", *(F.round(c, 4).alias("h" + n) for c, n in zip(G.head_region(G.box(), W, H), G_NAMES)))


@query("face_expand", """-- views: faces
SELECT det_id, CASE WHEN eye_dist IS NULL THEN 12 ELSE 12 + floor(least(greatest(greatest(x2 - x1, 1) * 0.35::DOUBLE - eye_dist, 0), greatest(x2 - x1, 1) * 0.35::DOUBLE) * 0.6::DOUBLE) END::BIGINT AS ex, 12::BIGINT AS ey FROM faces""")
def face_expand(spark, sf_dir):
    return view(spark, sf_dir, "faces").select("det_id", G.face_margin(F.col("x2") - F.col("x1"), F.col("eye_dist"), 12).alias("ex"), F.lit(12).cast("long").alias("ey"))


@query("face_rect", """-- views: faces
, e AS (SELECT *, CASE WHEN eye_dist IS NULL THEN 12 ELSE 12 + floor(least(greatest(greatest(x2 - x1, 1) * 0.35::DOUBLE - eye_dist, 0), greatest(x2 - x1, 1) * 0.35::DOUBLE) * 0.6::DOUBLE) END::BIGINT AS ex FROM faces)
SELECT det_id, greatest(floor(x1)::BIGINT - ex, 0) AS rx1, greatest(floor(y1)::BIGINT - 12, 0) AS ry1, least(floor(x2)::BIGINT + 1 + ex, 1920) AS rx2, least(floor(y2)::BIGINT + 13, 1080) AS ry2 FROM e""")
def face_rect(spark, sf_dir):
    ex = G.face_margin(F.col("x2") - F.col("x1"), F.col("eye_dist"), 12)
    return view(spark, sf_dir, "faces").select("det_id", *(c.alias("r" + n) for c, n in zip(G.face_span(G.box(), ex, 12, W, H), G_NAMES)))


@query("crop_align", """-- views: faces
, c AS (SELECT det_id, least(floor(x1), 1918)::BIGINT AS a, least(floor(y1), 1078)::BIGINT AS b, least(ceil(x2), 1920)::BIGINT AS c, least(ceil(y2), 1080)::BIGINT AS d FROM faces),
e AS (SELECT det_id, a - a % 2 AS a, b, c, d FROM c)
SELECT det_id, a AS crop_x, b AS crop_y, greatest(c, a + 2) - greatest(c, a + 2) % 2 - a AS crop_w, greatest(d, b + 2) - b AS crop_h FROM e""")
def crop_align(spark, sf_dir):
    return view(spark, sf_dir, "faces").select("det_id", *(c.alias(n) for c, n in zip(G.crop_span(G.box(), W, H), ("crop_x", "crop_y", "crop_w", "crop_h"))))


@query("near_edge_drop", """-- views: boxes
SELECT det_id, (x1 < 12 OR y1 < 12 OR x2 > 1908 OR y2 > 1068) AS near_edge, NOT ((x1 < 12 OR y1 < 12 OR x2 > 1908 OR y2 > 1068) AND det_id % 13 > 3) AS emitted FROM boxes""")
def near_edge_drop(spark, sf_dir):
    edge = G.near_edge(G.box(), W, H)
    return view(spark, sf_dir, "boxes").select("det_id", edge.alias("near_edge"), (~(edge & (F.col("det_id") % 13 > 3))).alias("emitted"))


@query("fade_progress", """-- views: boxes
, f AS (SELECT det_id, det_id % 13 AS lost, greatest(x2 - x1, y2 - y1) AS side, CASE WHEN det_id % 13 <= 6 THEN 0 ELSE least((det_id % 13 - 6) / 6.0::DOUBLE, 1) END::DOUBLE AS fade FROM boxes)
SELECT det_id, lost, round(fade, 6) AS fade, ceil(fade * 0.5::DOUBLE * side)::BIGINT AS fade_px FROM f""")
def fade_progress(spark, sf_dir):
    b = view(spark, sf_dir, "boxes").withColumn("lost", F.col("det_id") % 13)
    f = G.fade(F.col("lost"), 12)
    return b.select("det_id", "lost", F.round(f, 6).alias("fade"), G.fade_pixels(f, F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("fade_px"))


@query("hold_dilate", """-- views: boxes
SELECT det_id, least(greatest(round((abs(qty - 25) + abs(score * 10)) * 0.5::DOUBLE * (det_id % 13 + 1))::BIGINT, 6), 24) AS hold_px FROM boxes""")
def hold_dilate(spark, sf_dir):
    return view(spark, sf_dir, "boxes").select("det_id", G.hold_pixels(F.col("qty") - 25, F.col("score") * 10, F.col("det_id") % 13).alias("hold_px"))


@query("auto_bitrate", """SELECT p_partkey, (p_size * 80)::BIGINT AS long_side, CASE WHEN p_size * 80 <= 1280 THEN 3000000 WHEN p_size * 80 <= 1920 THEN 6000000 WHEN p_size * 80 <= 2560 THEN 10000000 ELSE 20000000 END::INT AS bitrate FROM part""")
def auto_bitrate(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("long_side", (F.col("p_size") * 80).cast("long"))
    return p.select("p_partkey", "long_side", G.bitrate(F.col("long_side")).alias("bitrate"))


@query("cosine_pairs", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.vec_id, b.vec_id AS other_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS cos
FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    other = e.select(F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"), (F.col("vec_id") - 1).alias("vec_id"))
    return e.join(other, "vec_id").select("vec_id", "other_id", F.round(G.cosine(F.col("embedding"), F.col("other")), 6).alias("cos"))


@query("l2_normalise", """WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 5)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e)
SELECT vec_id, round(CASE WHEN n > 1e-6 THEN v[1] / n ELSE 0 END, 6)::DOUBLE AS first, round(CASE WHEN n > 1e-6 THEN v[64] / n ELSE 0 END, 6)::DOUBLE AS last FROM n""")
def l2_normalise(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 5)).alias("v"))
    u = e.select("vec_id", G.unit(F.col("v")).alias("u"))
    return u.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"))


@query("format_duration", """SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600)::VARCHAR || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') ELSE lpad((s // 60)::VARCHAR, 2, '0') END || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS shown
FROM (SELECT event_id, greatest(event_id * 3 - 500, 0) AS s FROM events)""")
def format_duration(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", G.h_m_s(F.col("event_id") * 3 - 500).alias("shown"))


@query("eta", """SELECT event_id, round(event_id / (value + 1), 6) AS fps, round(CASE WHEN event_id > 0 THEN greatest(20000 - event_id, 0) / (event_id / (value + 1)) ELSE 0 END, 4)::DOUBLE AS eta_s FROM events WHERE value >= 0""")
def eta(spark, sf_dir):
    """Frames a second so far and seconds left of 20,000 frames; 0 before the first frame."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("value >= 0")
    fps = F.col("event_id") / (F.col("value") + 1)
    left = F.greatest(F.lit(20000) - F.col("event_id"), F.lit(0))
    return e.select("event_id", F.round(fps, 6).alias("fps"), F.round(F.coalesce(F.try_divide(left.cast("double"), fps), F.lit(0.0)), 4).alias("eta_s"))


@query("preview_size", """SELECT p_partkey, pw, greatest(2, ph - ph % 2)::BIGINT AS ph FROM (SELECT p_partkey, least(480, p_size * 40)::BIGINT AS pw, (least(480, p_size * 40) * (p_partkey % 1000 + 16) // (p_size * 40))::BIGINT AS ph FROM part)""")
def preview_size(spark, sf_dir):
    w, h = (F.col("p_size") * 40).cast("long"), F.col("p_partkey") % 1000 + 16
    pw = F.least(F.lit(480).cast("long"), w)
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", pw.alias("pw"), F.floor(pw * h / w).alias("ph"))
    return p.select("p_partkey", "pw", F.greatest(F.lit(2).cast("long"), F.col("ph") - F.col("ph") % 2).alias("ph"))


@query("gaussian_kernel", """WITH k AS (SELECT p_partkey, p_size % 16 * 2 + 3 AS k FROM part), t AS (SELECT p_partkey, k, unnest(range(0, k)) AS i, 0.3::DOUBLE * ((k - 1) / 2.0::DOUBLE - 1) + 0.8::DOUBLE AS sigma FROM k),
g AS (SELECT p_partkey, k, i, exp(-((i - (k - 1) / 2.0::DOUBLE) * (i - (k - 1) / 2.0::DOUBLE)) / (2 * sigma * sigma)) AS e FROM t)
SELECT p_partkey, k::INT AS k, i::INT AS i, round(e / sum(e) OVER (PARTITION BY p_partkey), 8) AS weight FROM g""")
def gaussian_kernel(spark, sf_dir):
    """Weights of a Gaussian for each part, as wide as its size says."""
    k = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size") % 16 * 2 + 3).cast("int").alias("k"))
    sigma = ((F.col("k") - 1) / 2.0 - 1) * 0.3 + 0.8
    e = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.exp(-F.pow(i - (F.col("k") - 1) / 2.0, F.lit(2.0)) / (F.lit(2.0) * sigma * sigma)))
    t = k.withColumn("e", e).withColumn("total", F.aggregate("e", F.lit(0.0), lambda s, x: s + x))
    return t.select("p_partkey", "k", F.posexplode("e").alias("i", "x"), "total").select("p_partkey", "k", "i", F.round(F.col("x") / F.col("total"), 8).alias("weight"))


@query("brush_disc", """-- views: patches
, b AS (SELECT seq, px, py, side, dx.d AS dx, dy.d AS dy FROM patches, (SELECT unnest(range(-6, 7)) AS d) dx, (SELECT unnest(range(-6, 7)) AS d) dy)
SELECT seq, count(*)::BIGINT AS n_px, min(px + dx)::INT AS left_px, max(py + dy)::INT AS bottom_px FROM b WHERE dx * dx + dy * dy <= side * side AND px + dx BETWEEN 0 AND 63 AND py + dy BETWEEN 0 AND 63 GROUP BY seq""")
def brush_disc(spark, sf_dir):
    """A round brush of radius side on a 64 x 64 frame."""
    p = view(spark, sf_dir, "patches")
    r = F.col("side")
    p = p.select("seq", "px", "py", "side", F.explode(F.sequence(-r, r)).alias("dx")).select("*", F.explode(F.sequence(-r, r)).alias("dy"))
    p = p.where((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") <= r * r) & (F.col("px") + F.col("dx")).between(0, 63) & (F.col("py") + F.col("dy")).between(0, 63))
    return p.groupBy("seq").agg(F.count(F.lit(1)).alias("n_px"), F.min(F.col("px") + F.col("dx")).alias("left_px"), F.max(F.col("py") + F.col("dy")).alias("bottom_px"))
