"""Queries of stored masks, edits, ordered results and progress."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.shared import shared_dir
from ..operators import masks
from ..registry import query
from ..sources import store
from ..sources.fixtures import view
from .masks import _EDITS, COUNT, S, _edits, _masks


@query("mask_store", """-- views: pixels
, k AS (SELECT frame_idx, count(*) FILTER (WHERE frame_idx % 3 <> 1 OR x < 40) AS n_px FROM pixels WHERE frame_idx % 7 <> 5 GROUP BY frame_idx)
SELECT r.frame_idx, CASE WHEN k.frame_idx IS NULL THEN 'missing' WHEN r.frame_idx % 7 = 4 THEN 'corrupt' WHEN r.frame_idx % 7 = 6 THEN 'size' ELSE 'ok' END AS state, CASE WHEN r.frame_idx % 7 NOT IN (4, 6) THEN k.n_px END::BIGINT AS n_px
FROM (SELECT DISTINCT frame_idx FROM rects) r LEFT JOIN k ON k.frame_idx = r.frame_idx""")
def mask_store(spark, sf_dir):
    """Masks written, some of them twice, and read back by frame; some are missing, spoiled or of another size."""
    path = f"{shared_dir(spark)}/masks-{uuid.uuid4().hex}"
    k = F.col("frame_idx") % 7
    m = _masks(spark, sf_dir).where(k != 5)
    narrow = masks.intersection(m, m.where("frame_idx % 3 = 1").select("frame_idx", "w", "h", masks.rectangle(F.lit(0), F.lit(0), F.lit(40), F.lit(S), S, S).alias("spans")))

    def packed(some):
        data = F.when(k == 4, F.substring("data", 1, 7)).otherwise(F.col("data"))
        return masks.to_files(some).select("frame_idx", F.when(k == 6, S + 2).otherwise(S).alias("w"), F.lit(S).alias("h"), data.alias("data"))

    store.save_masks(packed(m), path, 1)
    store.save_masks(packed(masks.filled(narrow)), path, 2)
    frames = view(spark, sf_dir, "rects").select("frame_idx").distinct()
    got = store.load_masks(frames, path, S, S)
    return got.select("frame_idx", "state", masks.area(F.col("spans")).alias("n_px"))


@query("instance_store", """-- views: rects
, i AS (SELECT * FROM rects WHERE rw > 4), c AS (SELECT frame_idx, rect_id, rx + a.x AS x, ry + b.y AS y FROM i, (SELECT unnest(range(0, 16)) AS x) a, (SELECT unnest(range(0, 16)) AS y) b WHERE a.x < rw AND b.y < rh),
t AS (SELECT frame_idx, x, y, max(rect_id) AS id FROM c GROUP BY ALL), f AS (SELECT DISTINCT frame_idx FROM rects)
SELECT i.frame_idx, i.rect_id AS instance_id, count(t.x)::BIGINT AS n_px, coalesce(sum(t.x + 64 * t.y), 0)::BIGINT AS moment FROM i LEFT JOIN t ON t.frame_idx = i.frame_idx AND t.id = i.rect_id GROUP BY ALL""")
def instance_store(spark, sf_dir):
    """Instances written twice, read back, and the pixels in which each is on top."""
    path = f"{shared_dir(spark)}/instances-{uuid.uuid4().hex}"
    r = view(spark, sf_dir, "rects")
    x, y = F.col("rx"), F.col("ry")
    found = r.select("frame_idx", F.col("rect_id").alias("instance_id"), F.lit(0).alias("kind"), F.lit(0.9).alias("score"), *(c.cast("double").alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), (x, y, x + F.col("rw"), y + F.col("rh")))), masks.rectangle(x, y, x + F.col("rw"), y + F.col("rh"), S, S).alias("spans"))
    store.save_instances(r, found, path, 1, S, S)
    store.save_instances(r, found.where(F.col("x2") - F.col("x1") > 4), path, 2, S, S)
    loaded = store.load_instances(r.select("frame_idx").distinct(), path, S, S).where("state = 'ok'")
    return masks.numbers(store.instance_image(loaded, S, S), ("frame_idx", "instance_id"), empty=True).select("frame_idx", "instance_id", "n_px", (F.col("sum_x") + 64 * F.col("sum_y")).alias("moment"))


@query("edit_log", f"""-- views: pixels patches
{_EDITS}, kept AS (SELECT * FROM edits WHERE NOT (frame_idx = 3 AND seq < 5000) AND NOT (frame_idx = 8)),
last AS (SELECT frame_idx, y, x, arg_max(op, seq) AS op FROM kept GROUP BY ALL),
m AS (SELECT coalesce(p.frame_idx, l.frame_idx) AS frame_idx, coalesce(p.y, l.y) AS y, coalesce(p.x, l.x) AS x FROM pixels p FULL JOIN last l ON p.frame_idx = l.frame_idx AND p.y = l.y AND p.x = l.x WHERE CASE WHEN l.op IS NULL THEN true ELSE l.op = 'add' END)
{COUNT.format(t='m')}""")
def edit_log(spark, sf_dir):
    """Edits appended, those of two frames undone, and what is left replayed over the masks."""
    path = f"{shared_dir(spark)}/edits-{uuid.uuid4().hex}"
    store.append_edits(_edits(spark, sf_dir), path)
    store.clear_frame(spark, path, 3, 4999)
    store.clear_frame(spark, path, 8, 1 << 60)
    return masks.numbers(masks.replay(_masks(spark, sf_dir), store.stored_edits(spark, path)))


@query("ordered_results", "SELECT user_id, event_id, row_number() OVER w - 1 = rank AS ready FROM (SELECT user_id, event_id, rank + CASE WHEN rank > 4 AND user_id % 3 = 0 THEN 1 ELSE 0 END AS rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rank FROM events)) WINDOW w AS (PARTITION BY user_id ORDER BY rank)")
def ordered_results(spark, sf_dir):
    """Which results may be passed on in order; every third stream lacks its fifth."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = e.withColumn("n", n).withColumn("n", F.col("n") + F.when((F.col("n") > 4) & (F.col("user_id") % 3 == 0), 1).otherwise(0))
    return store.in_order(e, "user_id", "n").select("user_id", "event_id", "ready")


@query("progress_ticks", "WITH t AS (SELECT event_id * 40 AS at_ms, event_id + 1 AS frames FROM events) SELECT at_ms // 250 AS tick, max(at_ms)::BIGINT AS at_ms, max(frames)::BIGINT AS frames, round(max(frames) * 100.0::DOUBLE / (SELECT count(*) FROM events), 3) AS pct, max(frames) >= (SELECT count(*) FROM events) AS final FROM t GROUP BY 1")
def progress_ticks(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") * 40).alias("at_ms"), (F.col("event_id") + 1).alias("frames"))
    return store.progress_of(e, e.count())


@query("sweep_report", "-- views: boxes\nSELECT flag AS label, format('{:.2f}', avg(score)) AS fps, format('{:.3f}', avg(qty)) AS mean_persons, format('{:.3f}', avg(tax)) AS mean_faces, format('{:.3f}', min(score)) AS mask_cov_pct, format('{:.2f}', max(score)) AS held_pct FROM boxes GROUP BY flag")
def sweep_report(spark, sf_dir):
    b = view(spark, sf_dir, "boxes").groupBy(F.col("flag").alias("label")).agg(F.avg("score").alias("fps"), F.avg("qty").alias("mean_persons"), F.avg("tax").alias("mean_faces"), F.min("score").alias("mask_cov_pct"), F.max("score").alias("held_pct"))
    return store.report_rows(b)


@query("model_readiness", "SELECT count(*)::BIGINT AS models, count(*) FILTER (WHERE doc_id % 4 <> 2 AND doc_id % 9 <> 0)::BIGINT AS ready, sum(n_chars)::BIGINT AS bytes, coalesce(sum(n_chars) FILTER (WHERE doc_id % 4 <> 2 AND doc_id % 9 <> 0), 0)::BIGINT AS ready_bytes FROM documents")
def model_readiness(spark, sf_dir):
    """Listed files that are there in full size, and how much of all that is; some are missing, some too short."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = d.select(F.col("doc_id").cast("string").alias("file"), F.col("n_chars").cast("long").alias("bytes"))
    found = m.where(F.col("file") % 4 != 2).select("file", (F.col("bytes") - F.when(F.col("file") % 9 == 0, 1).otherwise(0)).alias("bytes"))
    return store.readiness(m, found)
