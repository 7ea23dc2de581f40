"""Queries of run reports, sweeps and job bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources.fixtures import view

_PER = """-- views: boxes
, f AS (SELECT frame_idx, count(*) FILTER (WHERE flag = 'A' AND score >= {conf})::DOUBLE AS persons, count(*) FILTER (WHERE flag = 'R' AND score >= {face})::DOUBLE AS faces, count(*) FILTER (WHERE flag = 'N') AS tracks, sum(qty) AS infer, sum((x2 - x1) * (y2 - y1)) / 20736.0::DOUBLE AS cover FROM boxes GROUP BY frame_idx)"""


def _frames(spark, sf_dir):
    b = view(spark, sf_dir, "boxes")
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return b, F.sum(area) / 20736.0


@query("run_report", _PER.format(conf=0.35, face=0.6) + " SELECT count(*)::BIGINT AS frames, round(sum(infer), 4) AS infer_total, round(avg(persons), 6) AS mean_persons, round(avg(faces), 6) AS mean_faces, round(avg(cover), 5) AS mean_cover_pct, round(100.0::DOUBLE * count(*) FILTER (WHERE frame_idx % 2 = 0 AND persons < 10 AND tracks > 0) / greatest(count(*), 1), 6) AS held_pct FROM f")
def run_report(spark, sf_dir):
    """One row for a run: means over frames, and the share of detected frames that live on held tracks."""
    b, cover = _frames(spark, sf_dir)
    count = lambda c: F.count_if(c).cast("double")
    f = b.groupBy("frame_idx").agg(count((F.col("flag") == "A") & (F.col("score") >= 0.35)).alias("persons"), count((F.col("flag") == "R") & (F.col("score") >= 0.6)).alias("faces"), F.count_if(F.col("flag") == "N").alias("tracks"), F.sum("qty").alias("infer"), cover.alias("cover"))
    held = (F.col("frame_idx") % 2 == 0) & (F.col("persons") < 10) & (F.col("tracks") > 0)
    n = F.count(F.lit(1))
    return f.agg(n.alias("frames"), F.round(F.sum("infer"), 4).alias("infer_total"), F.round(F.avg("persons"), 6).alias("mean_persons"), F.round(F.avg("faces"), 6).alias("mean_faces"), F.round(F.avg("cover"), 5).alias("mean_cover_pct"), F.round(F.lit(100.0) * F.count_if(held) / F.greatest(n, F.lit(1)), 6).alias("held_pct"))


@query("sweep_grid", """-- views: boxes
, p AS (SELECT * FROM (VALUES (0.25::DOUBLE), (0.35::DOUBLE), (0.5::DOUBLE)) a(conf), (VALUES (0.5::DOUBLE), (0.6::DOUBLE)) b(face)),
f AS (SELECT conf, face, frame_idx, count(*) FILTER (WHERE flag = 'A' AND score >= conf) AS persons, count(*) FILTER (WHERE flag = 'R' AND score >= face) AS faces FROM boxes, p GROUP BY ALL)
SELECT conf, face, round(avg(persons), 6) AS mean_persons, round(avg(faces), 6) AS mean_faces FROM f GROUP BY conf, face""")
def sweep_grid(spark, sf_dir):
    """A report for each combination of parameters; the grid is a handful of rows."""
    grid = [(c, f) for c in (0.25, 0.35, 0.5) for f in (0.5, 0.6)]
    p = F.broadcast(spark.createDataFrame(grid, "conf double, face double"))
    b = view(spark, sf_dir, "boxes").join(p)
    f = b.groupBy("conf", "face", "frame_idx").agg(F.count_if((F.col("flag") == "A") & (F.col("score") >= F.col("conf"))).alias("persons"), F.count_if((F.col("flag") == "R") & (F.col("score") >= F.col("face"))).alias("faces"))
    return f.groupBy("conf", "face").agg(F.round(F.avg("persons"), 6).alias("mean_persons"), F.round(F.avg("faces"), 6).alias("mean_faces"))


@query("queue_summary", "SELECT count(*) FILTER (WHERE event_type = 'purchase')::BIGINT AS done, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS failed, count(*)::BIGINT AS total FROM events")
def queue_summary(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.agg(F.count_if(F.col("event_type") == "purchase").alias("done"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count(F.lit(1)).alias("total"))


_NEXT = """CASE WHEN state = 'none' AND ev = 'signup' THEN 'queued' WHEN state = 'queued' AND ev = 'view' THEN 'running' WHEN state = 'queued' AND ev = 'click' THEN 'cancelled'
 WHEN state = 'running' AND ev = 'purchase' THEN 'done' WHEN state = 'running' AND ev = 'error' THEN 'failed' WHEN state = 'running' AND ev = 'click' THEN 'stopping' WHEN state = 'stopping' AND ev IN ('purchase', 'error', 'view') THEN 'cancelled' ELSE state END"""


@query("job_fsm", f"""WITH RECURSIVE n AS (SELECT user_id, event_type AS ev, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 'none' AS state FROM events UNION ALL SELECT s.user_id, n.i, {_NEXT} FROM s JOIN n ON n.user_id = s.user_id AND n.i = s.i + 1)
SELECT user_id, arg_max(state, i) AS state, arg_max(state, i) IN ('done', 'failed', 'cancelled') AS terminal FROM s GROUP BY user_id""")
def job_fsm(spark, sf_dir):
    """A job's state after its events in order; finished jobs never move again, a running one is asked to stop first."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("ev")))).alias("e"))
    moves = {("none", "signup"): "queued", ("queued", "view"): "running", ("queued", "click"): "cancelled", ("running", "purchase"): "done", ("running", "error"): "failed", ("running", "click"): "stopping", **{("stopping", x): "cancelled" for x in ("purchase", "error", "view")}}

    def step(state, x):
        out = state
        for (was, ev), to in moves.items():
            out = F.when((state == was) & (x["ev"] == ev), to).otherwise(out)
        return out

    s = e.select("user_id", F.aggregate("e", F.lit("none"), step).alias("state"))
    return s.select("user_id", "state", F.col("state").isin("done", "failed", "cancelled").alias("terminal"))


@query("fifo_next", "SELECT p_size, min(p_partkey) FILTER (WHERE p_partkey % 3 = 0) AS next_id, count(*) FILTER (WHERE p_partkey % 7 = 1) = 0 AS idle FROM part GROUP BY p_size")
def fifo_next(spark, sf_dir):
    """For each queue its first waiting entry, and whether nothing runs there."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.groupBy("p_size").agg(F.min(F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey"))).alias("next_id"), (F.count_if(F.col("p_partkey") % 7 == 1) == 0).alias("idle"))


_WINDOWS = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY w) AS i, n / 2.0::DOUBLE AS fps, busy / 2.0::DOUBLE AS ratio FROM (SELECT user_id, epoch_us(ts) // 2000000 AS w, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 0.3::DOUBLE ELSE 1.6::DOUBLE END) AS busy FROM events GROUP BY ALL)"


@query("busy_windows", f"SELECT user_id, i::INT AS i, round(fps, 4) AS fps, round(ratio, 6) AS ratio FROM ({_WINDOWS})")
def busy_windows(spark, sf_dir):
    """Two-second windows by event time: events a second and the share of time they kept busy."""
    return _busy(spark, sf_dir).select("user_id", "i", F.round("fps", 4).alias("fps"), F.round("ratio", 6).alias("ratio"))


def _busy(spark, sf_dir):
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = e.groupBy("user_id", F.window("ts", "2 seconds").alias("w")).agg((F.count(F.lit(1)) / 2.0).alias("fps"), (F.sum(F.when(F.col("event_type") == "error", 0.3).otherwise(1.6)) / 2.0).alias("ratio"))
    return w.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("w.start")).alias("i"), "fps", "ratio")


@query("adaptive_ladder", f"""WITH RECURSIVE w AS ({_WINDOWS}), s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 0 AS starved, false AS reduced, 1 AS every FROM w
 UNION ALL SELECT s.user_id, w.i, CASE WHEN b.bound AND starved = 0 THEN 1 ELSE 0 END, reduced OR (b.bound AND starved = 1), every + CASE WHEN b.bound AND starved = 1 AND reduced AND every < 3 THEN 1 ELSE 0 END
 FROM s JOIN w ON w.user_id = s.user_id AND w.i = s.i + 1, LATERAL (SELECT ratio > 0.7 AND fps < 0.85 * 30 AS bound) AS b)
SELECT user_id, arg_max(reduced, i) AS reduced, arg_max(every, i)::INT AS every FROM s GROUP BY user_id""")
def adaptive_ladder(spark, sf_dir):
    """Steps down under load: two starved windows in a row first give up batching, then sample more thinly, never back."""
    w = _busy(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("i", "fps", "ratio"))).alias("w"))
    start = F.struct(F.lit(0).alias("starved"), F.lit(False).alias("reduced"), F.lit(1).alias("every"))

    def step(s, x):
        bound = (x["ratio"] > 0.7) & (x["fps"] < 0.85 * 30)
        act = bound & (s["starved"] == 1)
        return F.struct(F.when(bound & ~act, 1).otherwise(0).alias("starved"), (s["reduced"] | act).alias("reduced"), (s["every"] + F.when(act & s["reduced"] & (s["every"] < 3), 1).otherwise(0)).alias("every"))

    s = w.select("user_id", F.aggregate("w", start, step).alias("s"))
    return s.select("user_id", "s.reduced", "s.every")


@query("recent_files", "SELECT c, source FROM (SELECT c, source, row_number() OVER (PARTITION BY c ORDER BY last DESC) AS k FROM (SELECT doc_id % 10 AS c, source, max(doc_id) AS last FROM documents GROUP BY ALL)) WHERE k <= 8")
def recent_files(spark, sf_dir):
    """The eight sources last opened, each once, newest first, for each of ten users."""
    from pyspark.sql import Window

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy((F.col("doc_id") % 10).alias("c"), "source").agg(F.max("doc_id").alias("last"))
    return d.withColumn("k", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("last")))).where("k <= 8").select("c", "source")
