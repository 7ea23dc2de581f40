"""Queries of tensor decoding, over tensors made of the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decode, geometry
from ..functions.shared import beside, spread
from ..registry import query


def _emb(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


@query("decode_anchor", """WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(0, 12)) AS c FROM embeddings),
b AS (SELECT vec_id, c, e[4 * 12 + c + 1] AS s, e[c + 1] AS cx, e[12 + c + 1] AS cy, e[24 + c + 1] AS w, e[36 + c + 1] AS h FROM t)
SELECT vec_id, c::INT AS anchor, round(s, 6) AS score, round(cx - w / 2, 6) AS x1, round(cy - h / 2, 6) AS y1, round(cx + w / 2, 6) AS x2, round(cy + h / 2, 6) AS y2 FROM b WHERE s >= 0.1""")
def decode_anchor(spark, sf_dir):
    d = decode.anchors(_emb(spark, sf_dir), "embedding", 12, 4, 0.1)
    return d.select("vec_id", "anchor", *(F.round(c, 6).alias(c) for c in ("score", "x1", "y1", "x2", "y2")))


@query("decode_e2e", """WITH t AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i % 6 = 0 THEN floor(abs(x) * 10) ELSE x END) AS e, unnest(range(0, 10)) AS k FROM embeddings)
SELECT vec_id, k::INT AS k, round(e[k * 6 + 1], 6) AS x1, round(e[k * 6 + 2], 6) AS y1, round(e[k * 6 + 3], 6) AS x2, round(e[k * 6 + 4], 6) AS y2, round(e[k * 6 + 5], 6) AS score FROM t WHERE e[k * 6 + 6] = 0 AND e[k * 6 + 5] >= 0.05""")
def decode_e2e(spark, sf_dir):
    t = _emb(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x, i: F.when(i % 6 == 5, F.floor(F.abs(x.cast("double")) * 10).cast("double")).otherwise(x.cast("double"))).alias("t"))
    return decode.finished(t, "t", 6, 0.05).select("vec_id", "k", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2", "score")))


@query("decode_yunet", """WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS e, unnest([8, 16, 32]) AS s FROM embeddings),
b AS (SELECT vec_id, s, sqrt(greatest(least(e[1] + 0.5::DOUBLE, 1), 0) * greatest(least(e[2] + 0.5::DOUBLE, 1), 0)) AS score, (vec_id % 20 + e[3]) * s AS cx, (vec_id // 20 % 20 + e[4]) * s AS cy, exp(e[5]) * s AS w, exp(e[6]) * s AS h FROM t)
SELECT vec_id, s::INT AS stride, round(score, 6) AS score, round(cx - w / 2, 6) AS x1, round(cy - h / 2, 6) AS y1, round(cx + w / 2, 6) AS x2, round(cy + h / 2, 6) AS y2 FROM b""")
def decode_yunet(spark, sf_dir):
    e, out = _emb(spark, sf_dir), None
    v = lambda i: F.col("embedding")[i].cast("double")
    for s in (8, 16, 32):
        b = decode.grid_face(v(0) + 0.5, v(1) + 0.5, v(2), v(3), v(4), v(5), F.col("vec_id") % 20, F.floor(F.col("vec_id") / 20) % 20, s)
        rows = e.select("vec_id", F.lit(s).alias("stride"), *(F.round(c, 6).alias(n) for n, c in b.items()))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("decode_gd", """WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT *, 1 / (1 + exp(-greatest(e[1], e[2]) * 10)) AS score FROM t)
SELECT vec_id, round(score, 6) AS score, round(least(greatest((e[3] + 0.5::DOUBLE - abs(e[5]) / 2) * 1920, 0), 1920), 4)::DOUBLE AS x1, round(least(greatest((e[4] + 0.5::DOUBLE - abs(e[6]) / 2) * 1080, 0), 1080), 4)::DOUBLE AS y1,
 round(least(greatest((e[3] + 0.5::DOUBLE + abs(e[5]) / 2) * 1920, 0), 1920), 4)::DOUBLE AS x2, round(least(greatest((e[4] + 0.5::DOUBLE + abs(e[6]) / 2) * 1080, 0), 1080), 4)::DOUBLE AS y2 FROM s WHERE score >= 0.35""")
def decode_gd(spark, sf_dir):
    """Boxes of a text-prompted detector: the better of two token logits, centre and size relative to the frame."""
    v = lambda i: F.col("embedding")[i].cast("double")
    score = decode.sigmoid(F.greatest(v(0), v(1)) * 10)
    cx, cy, w, h = v(2) + 0.5, v(3) + 0.5, F.abs(v(4)), F.abs(v(5))
    px = lambda x, side: F.round(geometry.clamp(x * side, 0.0, float(side)), 4)
    return _emb(spark, sf_dir).where(score >= 0.35).select("vec_id", F.round(score, 6).alias("score"), px(cx - w / 2, 1920).alias("x1"), px(cy - h / 2, 1080).alias("y1"), px(cx + w / 2, 1920).alias("x2"), px(cy + h / 2, 1080).alias("y2"))


@query("retina_priors", """WITH i AS (SELECT p_partkey, (p_size % 5 + 2) * 16 AS w, (p_size % 7 + 2) * 16 AS h FROM part), p AS (SELECT * FROM i, (VALUES (8, 16), (8, 32), (16, 64), (16, 128), (32, 256), (32, 512)) AS t(step, size)),
g AS (SELECT *, unnest(range(0, ((h + step - 1) // step)::BIGINT)) AS "row" FROM p), c AS (SELECT *, unnest(range(0, ((w + step - 1) // step)::BIGINT)) AS col FROM g)
SELECT p_partkey, step::INT AS step, "row"::INT AS "row", col::INT AS col, size::INT AS size, round((col + 0.5::DOUBLE) * step / w, 8) AS cx, round(("row" + 0.5::DOUBLE) * step / h, 8) AS cy, round(size / w::DOUBLE, 8) AS pw, round(size / h::DOUBLE, 8) AS ph FROM c""")
def retina_priors(spark, sf_dir):
    """Prior boxes of an image of each part's size."""
    i = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", ((F.col("p_size") % 5 + 2) * 16).alias("w"), ((F.col("p_size") % 7 + 2) * 16).alias("h"))
    # a grid hangs on its image's size alone: each size's is made once (35 of them, of some 200 priors), then dealt out
    prior = F.struct("step", "row", "col", "size", *(F.round(c, 8).alias(c) for c in ("cx", "cy", "pw", "ph")))
    grids = decode.priors_of(i.select("w", "h").distinct()).groupBy("w", "h").agg(F.collect_list(prior).alias("priors"))
    return beside(spread(i, "p_partkey"), grids, ("w", "h")).select("p_partkey", F.explode("priors").alias("p")).select("p_partkey", "p.*")


@query("retina_decode", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e, (vec_id % 20 + 0.5::DOUBLE) * 32 / 640 AS cx, (vec_id // 20 % 20 + 0.5::DOUBLE) * 32 / 640 AS cy FROM embeddings),
b AS (SELECT vec_id, (cx + e[1] * 0.1::DOUBLE * 0.4::DOUBLE) * 640 AS x, (cy + e[2] * 0.1::DOUBLE * 0.4::DOUBLE) * 640 AS y, 0.4::DOUBLE * exp(e[3] * 0.2::DOUBLE) * 640 AS w, 0.4::DOUBLE * exp(e[4] * 0.2::DOUBLE) * 640 AS h FROM e)
SELECT vec_id, round(x - w / 2, 4) AS x1, round(y - h / 2, 4) AS y1, round(x + w / 2, 4) AS x2, round(y + h / 2, 4) AS y2 FROM b WHERE w >= 2 AND h >= 2""")
def retina_decode(spark, sf_dir):
    """Priors of 256 pixels on the coarsest grid, moved by a model's offsets; boxes under two pixels go."""
    v = lambda i: F.col("embedding")[i].cast("double")
    e = _emb(spark, sf_dir).withColumn("cx", (F.col("vec_id") % 20 + 0.5) * 32 / 640).withColumn("cy", (F.floor(F.col("vec_id") / 20) % 20 + 0.5) * 32 / 640)
    b = [c * 640 for c in decode.with_variance(F.col("cx"), F.col("cy"), F.lit(0.4), F.lit(0.4), v(0), v(1), v(2), v(3))]
    return e.where((b[2] - b[0] >= 2) & (b[3] - b[1] >= 2)).select("vec_id", *(F.round(c, 4).alias(n) for c, n in zip(b, ("x1", "y1", "x2", "y2"))))


@query("proto_mask", """WITH e AS (SELECT a.vec_id, list_transform(range(0, 64), lambda i: 1 / (1 + exp(-10 * (a.embedding[i + 1]::DOUBLE * b.embedding[i + 1]::DOUBLE + a.embedding[1]::DOUBLE * b.embedding[64 - i]::DOUBLE)))) AS g FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
p AS (SELECT vec_id, unnest(range(0, 20)) AS y, g FROM e), q AS (SELECT vec_id, y, unnest(range(0, 28)) AS x, g FROM p)
SELECT vec_id, count(*)::BIGINT AS n_px, sum(x + 28 * y)::BIGINT AS moment FROM q WHERE g[(y * 8 // 20) * 8 + x * 8 // 28 + 1] > 0.5 GROUP BY vec_id""")
def proto_mask(spark, sf_dir):
    """Two coefficients times 8 x 8 prototypes, cut at one half there, then spread over a 28 x 20 box by nearest cells."""
    e = _emb(spark, sf_dir)
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("p"))
    d = lambda c, i: F.get(F.col(c), i).cast("double")
    g = e.join(other, "vec_id").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: decode.sigmoid((d("embedding", i) * d("p", i) + d("embedding", F.lit(0)) * d("p", F.lit(63) - i)) * 10) > 0.5).alias("g"))
    q = g.select("vec_id", "g", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("y")).select("vec_id", "g", "y", F.explode(F.sequence(F.lit(0), F.lit(27))).alias("x"))
    q = q.where(F.get("g", decode.gathered(F.col("y"), F.lit(8), F.lit(20)) * 8 + decode.gathered(F.col("x"), F.lit(8), F.lit(28))))
    return q.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n_px"), F.sum(F.col("x") + F.col("y") * 28).cast("long").alias("moment"))


@query("low_res_to_frame", """WITH p AS (SELECT vec_id, embedding AS e, unnest(range(0, 18)) AS y FROM embeddings), q AS (SELECT vec_id, e, y, unnest(range(0, 32)) AS x FROM p)
SELECT vec_id, count(*)::BIGINT AS n_px, sum(x + 32 * y)::BIGINT AS moment FROM q WHERE e[(y * 8 // 18) * 8 + x * 8 // 32 + 1] > 0 GROUP BY vec_id""")
def low_res_to_frame(spark, sf_dir):
    """Low-resolution logits over 0, spread to a frame by nearest cells."""
    e = _emb(spark, sf_dir).select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(17))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("x"))
    e = e.where(F.get("embedding", decode.gathered(F.col("y"), F.lit(8), F.lit(18)) * 8 + decode.gathered(F.col("x"), F.lit(8), F.lit(32))) > 0)
    return e.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n_px"), F.sum(F.col("x") + F.col("y") * 32).cast("long").alias("moment"))


@query("best_candidate", """WITH c AS (SELECT vec_id, unnest(embedding[1:3]) AS s, generate_subscripts(embedding[1:3], 1) - 1 AS k FROM embeddings)
SELECT vec_id, arg_max(k, (s, -k))::INT AS k, round(max(s)::DOUBLE, 6) AS score FROM c GROUP BY vec_id""")
def best_candidate(spark, sf_dir):
    """Of three candidate masks the best by its own estimate, the first of equals."""
    c = _emb(spark, sf_dir).select("vec_id", F.posexplode(F.slice("embedding", 1, 3)).alias("k", "s"))
    best = c.groupBy("vec_id").agg(F.max(F.struct("s", (-F.col("k")).alias("nk"))).alias("m"))
    return best.select("vec_id", (-F.col("m.nk")).alias("k"), F.round(F.col("m.s").cast("double"), 6).alias("score"))
