"""Queries over ordered observations: filters, holds, tracking, linking, motion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import box, cosine, fade, iou
from ..functions.shared import spread
from ..operators import link, masks, motion, temporal, track
from ..registry import query
from ..sources.fixtures import view

_K = "{{'p': {p}, 'v': {v}, 'pp': {pp}, 'pv': {pv}, 'vv': {vv}}}"
_PRED = _K.format(p="s.k.p + s.k.v", v="s.k.v", pp="s.k.pp + s.k.pv * 2.0::DOUBLE + s.k.vv + 4.0::DOUBLE", pv="s.k.pv + s.k.vv", vv="s.k.vv + 1.0::DOUBLE")
_UPD = _K.format(p="a.p + a.pp / (a.pp + 1.0::DOUBLE) * (o.z - a.p)", v="a.v + a.pv / (a.pp + 1.0::DOUBLE) * (o.z - a.p)", pp="(1.0::DOUBLE - a.pp / (a.pp + 1.0::DOUBLE)) * a.pp", pv="(1.0::DOUBLE - a.pp / (a.pp + 1.0::DOUBLE)) * a.pv", vv="a.vv - a.pv / (a.pp + 1.0::DOUBLE) * a.pv")


@query("kalman_filter", f"""-- views: obs
, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i FROM obs),
s AS (SELECT user_id, 1::BIGINT AS i, {_K.format(p='z', v='0.0::DOUBLE', pp='100000.0::DOUBLE', pv='0.0::DOUBLE', vv='1000000.0::DOUBLE')} AS k FROM n WHERE i = 1
 UNION ALL SELECT s.user_id, s.i + 1, CASE WHEN o.hit THEN {_UPD} ELSE a END FROM s JOIN n o ON o.user_id = s.user_id AND o.i = s.i + 1, LATERAL (SELECT {_PRED} AS a) AS l(a))
SELECT user_id, round(arg_max(k, i).p, 5) AS p, round(arg_max(k, i).v, 5) AS v FROM s GROUP BY user_id""")
def kalman_filter(spark, sf_dir):
    o = temporal.in_order(view(spark, sf_dir, "obs"), "user_id", "seq", "z", "hit")
    k = o.select("user_id", temporal.kalman(F.col("o")).alias("k"))
    return k.select("user_id", F.round("k.p", 5).alias("p"), F.round("k.v", 5).alias("v"))


@query("oru_reupdate", """-- views: obs
, n AS (SELECT *, lag(z) OVER (PARTITION BY user_id ORDER BY seq) AS last FROM obs), g AS (SELECT seq, z, last, (seq % 6 + 1)::INT AS gap FROM n WHERE last IS NOT NULL),
s AS (SELECT seq, z, gap, 0 AS i, {'p': last, 'v': (z - last) / gap, 'pp': 100000.0::DOUBLE, 'pv': 0.0::DOUBLE, 'vv': 1000000.0::DOUBLE} AS k FROM g
 UNION ALL SELECT s.seq, s.z, s.gap, s.i + 1, {'p': k.p + k.v, 'v': k.v, 'pp': k.pp + k.pv * 2.0::DOUBLE + k.vv + 4.0::DOUBLE, 'pv': k.pv + k.vv, 'vv': k.vv + 1.0::DOUBLE} FROM s WHERE i < gap)
SELECT seq, round(k.p + k.pp / (k.pp + 1.0::DOUBLE) * (z - k.p), 5) AS p, round(k.v + k.pv / (k.pp + 1.0::DOUBLE) * (z - k.p), 5) AS v FROM s WHERE i = gap""")
def oru_reupdate(spark, sf_dir):
    from pyspark.sql import Window

    o = view(spark, sf_dir, "obs").withColumn("last", F.lag("z").over(Window.partitionBy("user_id").orderBy("seq"))).where("last IS NOT NULL")
    k = o.select("seq", temporal.after_gap(F.col("last"), F.col("z"), (F.col("seq") % 6 + 1).cast("int")).alias("k"))
    return k.select("seq", F.round("k.p", 5).alias("p"), F.round("k.v", 5).alias("v"))


@query("ema_fold", """-- views: obs
, n AS (SELECT user_id, CASE WHEN hit THEN 1 ELSE 0 END AS c, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i FROM obs),
s AS (SELECT user_id, i, (c * 255)::BIGINT AS e FROM n WHERE i = 1 UNION ALL SELECT s.user_id, n.i, (n.c * 255 * 179 + s.e * 77) // 256 FROM s JOIN n ON n.user_id = s.user_id AND n.i = s.i + 1)
SELECT user_id, arg_max(e, i) AS e, arg_max(e, i) >= 128 AS lit FROM s GROUP BY user_id""")
def ema_fold(spark, sf_dir):
    o = temporal.in_order(view(spark, sf_dir, "obs"), "user_id", "seq", "hit")
    e = o.select("user_id", temporal.blend(F.transform("o", lambda x: x["hit"].cast("int"))).alias("e"))
    return e.select("user_id", "e", (F.col("e") >= 128).alias("lit"))


@query("lost_shift", """-- views: obs
, i AS (SELECT *, sum(hit::INT) OVER (PARTITION BY user_id ORDER BY seq) AS island FROM obs),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY seq) - CASE WHEN island > 0 THEN 1 ELSE 0 END AS lost FROM i)
SELECT seq, lost::INT AS lost, round(CASE WHEN lost <= 6 THEN 0 ELSE least((lost - 6) / 6.0::DOUBLE, 1) END, 6)::DOUBLE AS fade, (sum(CASE WHEN hit THEN 0 ELSE seq % 9 - 4 END) OVER (PARTITION BY user_id, island ORDER BY seq))::BIGINT AS shift FROM l""")
def lost_shift(spark, sf_dir):
    from pyspark.sql import Window

    h = temporal.holds(view(spark, sf_dir, "obs"), "user_id", "seq")
    w = Window.partitionBy("user_id", "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return h.select("seq", "lost", F.round(fade(F.col("lost"), 12), 6).alias("fade"), F.sum(F.when(F.col("hit"), 0).otherwise(F.col("seq") % 9 - 4)).over(w).alias("shift"))


@query("debounce_350ms", """SELECT event_id FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n IS NULL OR n - ts > INTERVAL 350 MILLISECONDS""")
def debounce_350ms(spark, sf_dir):
    return temporal.debounce(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", "INTERVAL '0.35' SECOND").select("event_id")


@query("sample_every_n", "-- views: frames\nSELECT frame_idx, round(t_ms, 4) AS t_ms FROM frames WHERE frame_idx % 3 = 0")
def sample_every_n(spark, sf_dir):
    return view(spark, sf_dir, "frames").where("frame_idx % 3 = 0").select("frame_idx", F.round("t_ms", 4).alias("t_ms"))


@query("annotate_select", "-- views: frames\nSELECT frame_idx FROM frames WHERE frame_idx % 50 = 0 OR abs(t_ms - 10000) < 33.5 OR abs(t_ms - 20500) < 33.5 OR abs(t_ms - 33333) < 33.5")
def annotate_select(spark, sf_dir):
    """Every 50th frame, and those nearest to asked times."""
    f = view(spark, sf_dir, "frames")
    asked = F.exists(F.array(*(F.lit(float(t)) for t in (10000, 20500, 33333))), lambda t: F.abs(F.col("t_ms") - t) < 33.5)
    return f.where((F.col("frame_idx") % 50 == 0) | asked).select("frame_idx")


@query("preview_sample", "-- views: frames\nSELECT frame_idx, frame_idx % 8 = 0 AS stream, frame_idx % 4 = 0 AS archive FROM frames WHERE frame_idx % 4 = 0")
def preview_sample(spark, sf_dir):
    return view(spark, sf_dir, "frames").where("frame_idx % 4 = 0").select("frame_idx", (F.col("frame_idx") % 8 == 0).alias("stream"), F.lit(True).alias("archive"))


@query("resume_skip", "-- views: frames pixels\nSELECT frame_idx FROM frames WHERE frame_idx >= (SELECT coalesce(max(frame_idx) + 1, 0) FROM pixels)")
def resume_skip(spark, sf_dir):
    """Frames still to be analysed: those from the next after the last stored one."""
    start = view(spark, sf_dir, "pixels").agg(F.coalesce(F.max("frame_idx") + 1, F.lit(0)).alias("start"))
    return view(spark, sf_dir, "frames").join(F.broadcast(start), F.col("frame_idx") >= F.col("start")).select("frame_idx")


@query("next_frame", """-- views: pixels
, k AS (SELECT DISTINCT frame_idx FROM pixels WHERE frame_idx % 11 <> 5)
SELECT (max(frame_idx) + 1)::BIGINT AS next_frame, (max(frame_idx) + 1 - count(*))::BIGINT AS missing FROM k""")
def next_frame(spark, sf_dir):
    """Where an analysis goes on, and how many frames before that have no mask."""
    k = view(spark, sf_dir, "pixels").select("frame_idx").where("frame_idx % 11 <> 5").distinct()
    return k.agg(F.coalesce(F.max("frame_idx") + 1, F.lit(0)).alias("next_frame"), (F.coalesce(F.max("frame_idx") + 1, F.lit(0)) - F.count(F.lit(1))).alias("missing"))


@query("frame_seek", "-- views: frames\n, q AS (SELECT p_partkey, least(greatest(p_partkey * 100.0::DOUBLE - 500, 0), (SELECT max(t_ms) FROM frames) - 100) AS t FROM part)\nSELECT p_partkey, max(frame_idx) AS frame_idx FROM q JOIN frames ON t_ms <= t GROUP BY p_partkey")
def frame_seek(spark, sf_dir):
    """The frame shown at a time, with times clamped to the clip less a frame and a half.

    Times and frames meet in the ten seconds they fall in; where no frame comes before, the last frame of
    earlier stretches holds: an as-of lookup by sorted passes instead of a range join."""
    from pyspark.sql import Window

    f = view(spark, sf_dir, "frames").select("frame_idx", "t_ms")
    end = f.agg((F.max("t_ms") - 100).alias("end"))
    q = spark.read.parquet(f"{sf_dir}/part.parquet").join(F.broadcast(end)).select("p_partkey", F.least(F.greatest(F.col("p_partkey") * 100.0 - 500, F.lit(0.0)), F.col("end")).alias("t_ms"))
    sec = lambda c: F.floor(c / 10_000)
    last = f.groupBy(sec(F.col("t_ms")).alias("sec")).agg(F.max("frame_idx").alias("last"))
    # one row for ten seconds of film: a running maximum over the clip reaches over empty stretches
    last = q.select(sec(F.col("t_ms")).alias("sec")).distinct().join(last, "sec", "full").select("sec", F.max("last").over(Window.orderBy("sec").rowsBetween(Window.unboundedPreceding, -1)).alias("last"))
    both = f.select("t_ms", "frame_idx", F.lit(None).cast("long").alias("p_partkey")).unionByName(q.select("t_ms", F.lit(None).cast("long").alias("frame_idx"), "p_partkey")).withColumn("sec", sec(F.col("t_ms")))
    w = Window.partitionBy("sec").orderBy("t_ms", F.col("p_partkey").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("here", F.max("frame_idx").over(w)).where("p_partkey IS NOT NULL").join(last, "sec", "left")
    return seen.select("p_partkey", F.coalesce("here", "last").alias("frame_idx"))


@query("frame_seek_again", """-- views: frames
, f AS (SELECT user_id % 20 AS v, t_ms, frame_idx, event_type <> 'error' AS good FROM frames), e AS (SELECT v, max(t_ms) - 100.0::DOUBLE AS last FROM f GROUP BY v),
a AS (SELECT p_partkey AS k, p_partkey % 21 AS v, p_partkey * 97.0::DOUBLE - 900 AS at_ms FROM part), t AS (SELECT a.*, greatest(least(at_ms, last), 0.0::DOUBLE) AS t FROM a LEFT JOIN e ON e.v = a.v),
o AS (SELECT k, t.v, t.t, max(f.frame_idx) AS i FROM t LEFT JOIN f ON f.v = t.v AND f.t_ms <= t.t WHERE t.v IN (SELECT v FROM e) GROUP BY ALL),
g AS (SELECT o.*, coalesce(f.good, false) AS good FROM o LEFT JOIN f ON f.frame_idx = o.i),
r AS (SELECT g.k, max(f.frame_idx) AS i FROM g LEFT JOIN f ON f.v = g.v AND f.t_ms <= greatest(g.t - 250, 0) WHERE NOT g.good GROUP BY g.k)
SELECT k AS p_partkey, i AS frame_idx, 1 AS tries FROM g WHERE good UNION ALL SELECT r.k, CASE WHEN f.good THEN r.i END, 2 FROM r LEFT JOIN f ON f.frame_idx = r.i UNION ALL SELECT k, NULL, 2 FROM t WHERE v NOT IN (SELECT v FROM e)""")
def frame_seek_again(spark, sf_dir):
    """Frames of twenty videos at times that parts ask for, one video of which there is not; frames of errors can't be
    read, so what stands a quarter of a second before them is shown."""
    from ..operators import seek

    f = view(spark, sf_dir, "frames").select((F.col("user_id") % 20).alias("video_id"), "t_ms", "frame_idx", (F.col("event_type") != "error").alias("good"))
    k = F.col("p_partkey")
    asks = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (k % 21).alias("video_id"), (k * 97.0 - 900).alias("at_ms"))
    return seek.frames_at(f, asks, 15.0).select("p_partkey", "frame_idx", "tries")


def _videos(spark, sf_dir):
    """A video of sixteen frames for each frame of boxes, which drift slowly, so that tracks hold together."""
    base = view(spark, sf_dir, "boxes").where("score >= 0.1").select(F.col("frame_idx").alias("video_id"), "det_id", "score", "x1", "y1", "x2", "y2")
    base = spread(base, "video_id")  # boxes travel before each becomes many
    seen = base.withColumn("frame_idx", F.explode(F.sequence(F.lit(0), F.lit(15)))).where("(det_id + frame_idx * 7) % 5 <> 0")
    d = F.col("frame_idx") * (F.col("det_id") % 9 - 4)
    dets = seen.select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), "det_id", "score", *((F.col(n) + d).alias(n) for n in ("x1", "y1", "x2", "y2")))
    frames = base.select("video_id").distinct().select("video_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("frame_idx")).withColumn("frame_idx", F.col("frame_idx").cast("long"))
    return dets, frames


@query("track_batch")
def track_batch(spark, sf_dir):
    dets, frames = _videos(spark, sf_dir)
    t = track.track(dets, frames)
    return t.select("video_id", "frame_idx", "track_id", "lost", F.round("fade", 6).alias("fade"), F.round("score", 6).alias("score"), *(F.round(n, 3).alias(n) for n in ("x1", "y1", "x2", "y2", "shift_x", "shift_y")))


@query("assemble_masks")
def assemble_masks(spark, sf_dir):
    """Masks of small videos end to end: every third frame is looked at, persons are tracked and held between, faces
    follow them. A frame of rectangles is one of a video's frames; pixels and places of each mask."""
    from ..operators import assemble

    r = view(spark, sf_dir, "rects").select((F.col("frame_idx") % 4).alias("video_id"), F.floor(F.col("frame_idx") / 4).alias("frame_idx"), F.col("rect_id").alias("det_id"), ((F.col("rect_id") % 60 + 40) / 100.0).alias("score"), *(F.col(c).cast("double").alias(n) for c, n in (("rx", "x1"), ("ry", "y1"))), (F.col("rx") + F.col("rw") + 8).cast("double").alias("x2"), (F.col("ry") + F.col("rh") + 16).cast("double").alias("y2"))
    faces = r.where("det_id % 3 = 0").select("video_id", "frame_idx", "det_id", "score", (F.col("x1") + 2).alias("x1"), (F.col("y1") + 1).alias("y1"), (F.col("x1") + 8).alias("x2"), (F.col("y1") + 9).alias("y2"), F.lit(None).cast("double").alias("eye_dist"))
    made = assemble.assemble(r.select("video_id", "frame_idx").distinct(), r, faces, 64, 64, every=3, face_expand=1)
    return masks.numbers(made, ("video_id", "frame_idx"), empty=True).select("video_id", "frame_idx", "n_px", (F.col("sum_x") + 64 * F.col("sum_y")).alias("moment"))


#: Two standing figures in each part's video, faint on some frames and unseen on others; their masks change within
#: their boxes. A faint one is followed, but begins no track.
_FIGURES = """WITH RECURSIVE e AS (SELECT p_partkey AS v, k, f FROM part, (SELECT unnest(range(0, 2)) AS k), (SELECT unnest(range(0, 10)) AS f)),
s AS (SELECT *, (f * 3 + k + v) % 4 = 1 AS faint FROM e WHERE (f + k * 2 + v) % 5 <> 0),
b AS (SELECT v, k, min(f) AS born FROM s WHERE NOT faint GROUP BY ALL),
d AS (SELECT s.v, s.k, s.f, row_number() OVER (PARTITION BY s.v, s.k ORDER BY s.f) AS i, s.k * 24 + 2 + (s.f + s.v) % 3 * 2 AS mx, 3 + s.f % 2 * 3 AS my FROM s JOIN b ON b.v = s.v AND b.k = s.k AND s.f >= b.born),
g AS (SELECT v, k, k * 24 + 2 + a.x AS x, 3 + c.y AS y FROM b, (SELECT unnest(range(0, 11)) AS x) a, (SELECT unnest(range(0, 11)) AS y) c),
c AS (SELECT d.v, d.k, d.i, d.f, g.x, g.y, CASE WHEN g.x >= mx AND g.x < mx + 7 AND g.y >= my AND g.y < my + 8 THEN 255 ELSE 0 END AS now FROM d JOIN g ON g.v = d.v AND g.k = d.k),
r AS (SELECT v, k, i, f, x, y, now AS grey FROM c WHERE i = 1 UNION ALL SELECT c.v, c.k, c.i, c.f, c.x, c.y, (c.now * 90 + r.grey * 166) // 256 FROM r JOIN c ON c.v = r.v AND c.k = r.k AND c.x = r.x AND c.y = r.y AND c.i = r.i + 1),
l AS (SELECT e.v, e.f, e.k, max(d.f) AS seen FROM e JOIN d ON d.v = e.v AND d.k = e.k AND d.f <= e.f GROUP BY ALL),
m AS (SELECT l.v, l.f, r.x, r.y FROM l JOIN r ON r.v = l.v AND r.k = l.k AND r.f = l.seen WHERE r.grey >= 128),
z AS (SELECT v, f, x, y FROM m UNION SELECT v, f + 1, x + a.d, y + b.d FROM m, (SELECT unnest(range(-1, 2)) AS d) a, (SELECT unnest(range(-1, 2)) AS d) b WHERE f < 9)
SELECT p_partkey AS video_id, t.f::BIGINT AS frame_idx, count(z.x)::BIGINT AS n_px, coalesce(sum(z.x), 0)::BIGINT AS sum_x, coalesce(sum(z.y), 0)::BIGINT AS sum_y FROM part JOIN (SELECT unnest(range(0, 10)) AS f) t ON true LEFT JOIN z ON z.v = p_partkey AND z.f = t.f GROUP BY ALL"""


@query("assemble_figures", _FIGURES)
def assemble_figures(spark, sf_dir):
    """Masks of every frame, from detections with masks: followed through faint and missed frames, blended over the
    frames that saw them, smoothed in time."""
    from ..operators import assemble

    parts = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("video_id")), "video_id")  # before each becomes many
    e = parts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumn("frame_idx", F.explode(F.sequence(F.lit(0), F.lit(9)).cast("array<bigint>")))
    f, k, v = F.col("frame_idx"), F.col("k"), F.col("video_id")
    mx, my, x = k * 24 + 2 + (f + v) % 3 * 2, 3 + f % 2 * 3, (k * 24).cast("double")
    score = F.when((f * 3 + k + v) % 4 == 1, 0.2).otherwise(0.9 - k * 0.1)
    seen = e.where((f + k * 2 + v) % 5 != 0).select("video_id", "frame_idx", (v * 10 + k).alias("det_id"), score.alias("score"), x.alias("x1"), F.lit(1.0).alias("y1"), (x + 20).alias("x2"), F.lit(20.0).alias("y2"), masks.rectangle(mx, my, mx + 7, my + 8, 64, 32).alias("spans"))
    none = seen.select("video_id", "frame_idx", "det_id", "score", "x1", "y1", "x2", "y2", F.lit(None).cast("double").alias("eye_dist")).where("false")
    made = assemble.assemble(e.select("video_id", "frame_idx").distinct(), seen, none, 64, 32, blend=(90, 166))
    return masks.numbers(made, ("video_id", "frame_idx"), empty=True)


def _sums_sql(rect: str) -> str:
    """n, x and y sums of a rectangle's pixels, from columns a, b, c, d with a suffix: [a, b) x [c, d)."""
    a, b, c, d = (f"{n}{rect}" for n in "abcd")
    w, h = f"greatest({b} - {a}, 0)", f"greatest({d} - {c}, 0)"
    return f"{w} * {h} AS n{rect}, ({a} + {b} - 1) * {w} * {h} // 2 AS x{rect}, ({c} + {d} - 1) * {h} * {w} // 2 AS y{rect}"


#: A video of three frames for each part, with two persons and three faces; where a mask comes from goes by part, person
#: and frame. The first face joins its host's mask in every second size of part, the second is alone, the third too unsure.
_ARCHIVE = f"""WITH p AS (SELECT p_partkey AS v, t.f, k.k, p_size % 2 = 0 AND k.k = 0 AS face, CASE WHEN (p_partkey + k.k + t.f) % 3 = 0 THEN 'refined' WHEN (p_partkey + k.k) % 2 = 0 THEN 'matched' ELSE 'rect' END AS source FROM part, (SELECT unnest(range(0, 3)) AS f) t, (SELECT unnest([0, 1]) AS k) k),
m AS (SELECT *, k * 60 + CASE source WHEN 'refined' THEN 12 WHEN 'matched' THEN 4 ELSE 2 END AS a1, k * 60 + CASE source WHEN 'refined' THEN 36 WHEN 'matched' THEN 24 ELSE 46 END AS b1, CASE source WHEN 'refined' THEN 12 WHEN 'matched' THEN 4 ELSE 0 END AS c1, CASE source WHEN 'refined' THEN 76 WHEN 'matched' THEN 84 ELSE 88 END AS d1, 17 AS a2, CASE WHEN face THEN 40 ELSE 17 END AS b2, 5 AS c2, 28 AS d2 FROM p),
o AS (SELECT *, greatest(a1, a2) AS a3, least(b1, b2) AS b3, greatest(c1, c2) AS c3, least(d1, d2) AS d3 FROM m), n AS (SELECT *, {_sums_sql('1')}, {_sums_sql('2')}, {_sums_sql('3')} FROM o),
g AS (SELECT p_partkey AS v, t.f, p_partkey % 2 = 0 AS good, CASE WHEN p_partkey % 2 = 0 THEN 134 ELSE 127 END AS a1, CASE WHEN p_partkey % 2 = 0 THEN 144 ELSE 150 END AS b1, CASE WHEN p_partkey % 2 = 0 THEN 24 ELSE 17 END AS c1, CASE WHEN p_partkey % 2 = 0 THEN 34 ELSE 40 END AS d1 FROM part, (SELECT unnest(range(0, 3)) AS f) t), z AS (SELECT *, {_sums_sql('1')} FROM g)
SELECT v AS video_id, f::BIGINT AS frame_idx, 0 AS kind, k::BIGINT AS instance_id, source, round((0.8::DOUBLE - 0.1::DOUBLE * k) * CASE WHEN source = 'refined' THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END, 6) AS score, (n1 + n2 - n3)::BIGINT AS n_px, (x1 + x2 - x3)::BIGINT AS sum_x, (y1 + y2 - y3)::BIGINT AS sum_y FROM n
UNION ALL SELECT v, f, 1, 0, CASE WHEN good THEN 'refined' ELSE 'rect' END, 0.9::DOUBLE, n1, x1, y1 FROM z"""


@query("archive_figures", _ARCHIVE)
def archive_figures(spark, sf_dir):
    """Instances with their masks, from two detectors' boxes, faces, and a made model that refines prompts."""
    from ..operators import archive

    w, h = 160, 96
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("video_id"), "p_size"), "video_id")  # before each becomes many
    part = part.withColumn("frame_idx", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")))
    number = lambda x: F.lit(x).cast("double")
    e = part.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    k, v, f = F.col("k"), F.col("video_id"), F.col("frame_idx")
    left = k * 60 + 4
    half = F.when((v + k) % 2 == 0, 20).otherwise(4)
    box = (left.cast("double").alias("x1"), number(4).alias("y1"), (left + 40).cast("double").alias("x2"), number(84).alias("y2"))
    seen = e.withColumn("src", F.explode(F.array(F.lit(0), F.lit(1)))).select("video_id", "frame_idx", (k * 2 + F.col("src")).cast("long").alias("det_id"), "src", (0.8 - 0.1 * k).alias("score"), *box, F.when(F.col("src") == 0, masks.rectangle(left, F.lit(4), left + half, F.lit(84), w, h)).alias("spans"))
    face = lambda n, x, y, side, score, on=F.lit(True): part.where(on).select("video_id", "frame_idx", F.lit(n).cast("long").alias("det_id"), F.lit(score).alias("score"), number(x).alias("x1"), number(y).alias("y1"), number(x + side).alias("x2"), number(y + side).alias("y2"), F.lit(None).cast("double").alias("eye_dist"))
    faces = face(0, 20, 8, 16, 0.9, F.col("p_size") % 2 == 0).unionByName(face(1, 130, 20, 16, 0.9)).unionByName(face(2, 110, 60, 10, 0.5))

    def refine(prompts):
        who = (F.col("x1") - 4) / 60
        sure = F.when(F.col("x1") < 110, (v + who + f) % 3 == 0).otherwise(v % 2 == 0)
        inset = F.when(F.col("x1") < 110, 8).otherwise(4)
        last = F.when(F.col("x1") < 110, 8).otherwise(2)
        return prompts.select("video_id", "frame_idx", "prompt_id", F.when(sure, 0.9).otherwise(0.3).alias("quality"), F.lit(w).alias("w"), F.lit(h).alias("h"), masks.rectangle(F.col("x1") + inset, F.col("y1") + inset, F.col("x2") - last, F.col("y2") - last, w, h).alias("spans"))

    got = archive.analyze_videos(part.select("video_id", "frame_idx"), seen, faces, refine, None, w, h, face_expand=3)
    n = masks.numbers(got, ("video_id", "frame_idx", "instance_id"), also=("kind", "source", "score"))
    return n.select("video_id", "frame_idx", F.col("kind").cast("int").alias("kind"), "instance_id", "source", F.round("score", 6).alias("score"), "n_px", "sum_x", "sum_y")


@query("track_known", """WITH d AS (SELECT p_partkey AS video_id, unnest(range(0, 3)) AS k FROM part), e AS (SELECT video_id, k, unnest(range(0, 10)) AS frame_idx FROM d),
s AS (SELECT * FROM e WHERE (frame_idx + k * 2 + video_id) % 5 <> 0), b AS (SELECT video_id, k, min(frame_idx) AS born FROM s GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY born, (k + video_id) % 3) - 1 AS track_id FROM b),
a AS (SELECT e.video_id, e.frame_idx, n.track_id, e.k, (SELECT max(s.frame_idx) FROM s WHERE s.video_id = e.video_id AND s.k = e.k AND s.frame_idx <= e.frame_idx) AS seen FROM e JOIN n ON n.video_id = e.video_id AND n.k = e.k AND e.frame_idx >= n.born)
SELECT video_id, frame_idx::BIGINT AS frame_idx, track_id::BIGINT AS track_id, (frame_idx - seen)::INT AS lost, (k * 200)::DOUBLE AS x1, (video_id * 10 + k)::BIGINT AS det_id, seen::BIGINT AS seen_at FROM a""")
def track_known(spark, sf_dir):
    """Three standing figures in each part's video, each unseen in every fifth frame: numbers in order of first sight and score."""
    d = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("video_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    e = d.withColumn("frame_idx", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("frame_idx", F.col("frame_idx").cast("long"))
    seen = e.where((F.col("frame_idx") + F.col("k") * 2 + F.col("video_id")) % 5 != 0)
    x = F.col("k") * 200.0
    dets = seen.select("video_id", "frame_idx", (F.col("video_id") * 10 + F.col("k")).alias("det_id"), (0.9 - (F.col("k") + F.col("video_id")) % 3 * 0.1).alias("score"), x.alias("x1"), F.lit(0.0).alias("y1"), (x + 100).alias("x2"), F.lit(150.0).alias("y2"))
    t = track.track(dets, e.select("video_id", "frame_idx").distinct())
    return t.select("video_id", "frame_idx", "track_id", "lost", "x1", "det_id", "seen_at")


@query("track_stream")
def track_stream(spark, sf_dir):
    """The same tracks from a stream of frames with state for each video."""
    from ..streaming.tracks import stream_once

    dets, frames = _videos(spark, sf_dir)
    t = stream_once(dets, frames)
    return t.select("video_id", "frame_idx", "track_id", "lost", F.round("score", 6).alias("score"))


@query("masklet_link_frame", """-- views: persons
, e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), r AS (SELECT frame_idx, det_id, x1, y1, x2, y2, det_id % 500 AS vid FROM persons),
p AS (SELECT a.frame_idx, a.det_id AS ref_id, b.det_id AS inst_id, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS x, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS area, e.v AS v, f.v AS w
 FROM r a JOIN r b ON b.frame_idx = a.frame_idx AND a.det_id % 2 = 0 AND b.det_id % 2 = 1 AND b.det_id % 12 <= 8 JOIN e ON e.vec_id = a.vid JOIN e f ON f.vec_id = b.vid),
s AS (SELECT frame_idx, ref_id, inst_id, x / (area - x) * 0.6::DOUBLE + greatest(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))), 0) * 0.4::DOUBLE AS s FROM p),
o AS (SELECT frame_idx, row_number() OVER (PARTITION BY frame_idx ORDER BY s DESC, ref_id, inst_id) AS i, {'ref_id': ref_id, 'inst_id': inst_id, 's': s} AS q FROM s WHERE s > 0.3),
t AS (SELECT frame_idx, 1::BIGINT AS i, [q] AS done FROM o WHERE i = 1
 UNION ALL SELECT t.frame_idx, t.i + 1, CASE WHEN len(list_filter(t.done, lambda d: d.ref_id = o.q.ref_id OR d.inst_id = o.q.inst_id)) = 0 THEN list_append(t.done, o.q) ELSE t.done END FROM t JOIN o ON o.frame_idx = t.frame_idx AND o.i = t.i + 1),
z AS (SELECT frame_idx, unnest(arg_max(done, i)) AS d FROM t GROUP BY frame_idx)
SELECT frame_idx, d.ref_id AS ref_id, d.inst_id AS inst_id, round(d.s, 5) AS score FROM z""")
def masklet_link_frame(spark, sf_dir):
    # persons name at most 500 vectors, which meet them where their frame's pairs are made
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("abs(vec_id) < 500").select("vec_id", F.col("embedding").alias("emb"))
    p = spread(view(spark, sf_dir, "persons"), "frame_idx").withColumn("vec_id", F.col("det_id") % 500).join(F.broadcast(e), "vec_id")
    refs = p.where("det_id % 2 = 0").withColumnRenamed("det_id", "ref_id")
    memory = p.where("det_id % 2 = 1").withColumn("missed", F.col("det_id") % 12).withColumnRenamed("det_id", "inst_id")
    return link.link(refs, memory).select("frame_idx", "ref_id", "inst_id", F.round("score", 5).alias("score"))


@query("gmc_shift", """WITH f AS (SELECT (p_partkey % 8)::BIGINT AS video_id, p_partkey // 8 AS frame_idx FROM part)
SELECT video_id, frame_idx::BIGINT AS frame_idx, CASE WHEN lag(frame_idx) OVER w IS NULL THEN 0 ELSE 3 * (video_id % 3) END::BIGINT AS dx, CASE WHEN lag(frame_idx) OVER w IS NULL THEN 0 ELSE 2 * (video_id % 2) END::BIGINT AS dy FROM f WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)""")
def gmc_shift(spark, sf_dir):
    """Motion found between frames of a pattern that a made camera moves, in whole pixels."""
    ids = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), "p_partkey").select((F.col("p_partkey") % 8).alias("video_id"), F.floor(F.col("p_partkey") / 8).alias("frame_idx"))

    def draw(batches):
        import numpy as np

        at = np.arange(128)
        for pdf in batches:
            # cells of pseudo-random brightness, moved a little further in each frame
            made = []
            for v, f in zip(pdf["video_id"], pdf["frame_idx"]):
                (x, to_x), (y, to_y) = (np.unique((at - by) // 5, return_inverse=True) for by in (3 * f * (v % 3), 2 * f * (v % 2)))
                cx, cy = x[None, :], y[:, None]
                cells = ((cx * 73 + cy * 151 + (cx * cy) % 17 * 31 + (cx * cx * 7 + cy * cy * 13) % 101) % 256).astype(np.uint8)
                made.append(cells[np.ix_(to_y, to_x)].tobytes())
            yield pdf.assign(w=128, h=128, luma=made)

    frames = ids.mapInPandas(draw, "video_id long, frame_idx long, w int, h int, luma binary")
    return motion.motions(frames).select("video_id", "frame_idx", F.round("dx").cast("long").alias("dx"), F.round("dy").cast("long").alias("dy"))
