"""Folds over ordered observations: Kalman filtering, re-update after gaps, fixed-point blending, holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of a blend, of 256, and the grey from which a pixel is set.
BLEND_NEW, BLEND_OLD, GREY_SET = 179, 77, 128


def in_order(df: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """(key, o): a key's observations in order, as structs. A key is one track, so its list is bounded by it."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("o"))


def kalman_start(z: Column, scale: float) -> Column:
    big = scale * scale
    return F.struct(z.alias("p"), F.lit(0.0).alias("v"), F.lit(10.0 * big).alias("pp"), F.lit(0.0).alias("pv"), F.lit(100.0 * big).alias("vv"))


def kalman_predict(s: Column, scale: float) -> Column:
    """One frame ahead at constant velocity."""
    qp, qv = (0.02 * scale) ** 2, (0.01 * scale) ** 2
    return F.struct((s["p"] + s["v"]).alias("p"), s["v"].alias("v"), (s["pp"] + s["pv"] * 2.0 + s["vv"] + qp).alias("pp"), (s["pv"] + s["vv"]).alias("pv"), (s["vv"] + qv).alias("vv"))


def kalman_update(s: Column, z: Column, scale: float) -> Column:
    total = s["pp"] + (0.01 * scale) ** 2
    gain_p, gain_v, off = s["pp"] / total, s["pv"] / total, z - s["p"]
    keep = F.lit(1.0) - gain_p
    return F.struct((s["p"] + gain_p * off).alias("p"), (s["v"] + gain_v * off).alias("v"), (keep * s["pp"]).alias("pp"), (keep * s["pv"]).alias("pv"), (s["vv"] - gain_v * s["pv"]).alias("vv"))


def kalman(observations: Column, scale: float = 100.0) -> Column:
    """Filtered state (p, v, pp, pv, vv) after a key's ordered observations o (fields z, hit); a missed one only predicts."""
    first = observations[0]

    def step(s: Column, o: Column) -> Column:
        ahead = kalman_predict(s, scale)
        return F.transform(F.array(ahead), lambda a: F.when(o["hit"], kalman_update(a, o["z"], scale)).otherwise(a))[0]

    return F.aggregate(F.slice(observations, F.lit(2), F.size(observations)), kalman_start(first["z"], scale), step)


def after_gap(last: Column, z: Column, gap: Column, scale: float = 100.0) -> Column:
    """State after a gap: begun anew at the last observation with the gap's mean speed, run over the gap, then updated."""
    g = F.greatest(gap, F.lit(1))
    begun = F.struct(last.alias("p"), ((z - last) / g).alias("v"), F.lit(10.0 * scale * scale).alias("pp"), F.lit(0.0).alias("pv"), F.lit(100.0 * scale * scale).alias("vv"))
    run = F.aggregate(F.sequence(F.lit(1), g.cast("int")), begun, lambda s, _: kalman_predict(s, scale))
    return F.transform(F.array(run), lambda s: kalman_update(s, z, scale))[0]


def blend(values: Column) -> Column:
    """Fixed-point moving average of 0/1 values, 0 to 255; starts at the first value."""
    one = lambda v: v.cast("long") * 255
    return F.aggregate(F.slice(values, F.lit(2), F.size(values)), one(values[0]), lambda e, c: F.floor((one(c) * 179 + e * 77) / 256))


def holds(df: DataFrame, key: str, order: str) -> DataFrame:
    """df (with hit) and lost: observations since the last hit; island: how many hits so far."""
    w = Window.partitionBy(key).orderBy(order)
    out = df.withColumn("island", F.sum(F.col("hit").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "island").orderBy(order)
    return out.withColumn("lost", F.when(F.col("island") > 0, F.row_number().over(inside) - 1).otherwise(F.row_number().over(inside)))


def debounce(df: DataFrame, key: str, at: str, quiet: str) -> DataFrame:
    """Rows after which nothing of their key comes for longer than quiet."""
    after = F.lead(at).over(Window.partitionBy(key).orderBy(at, "event_id"))
    return df.withColumn("_next", after).where(F.col("_next").isNull() | (F.col("_next") - F.col(at) > F.expr(quiet))).drop("_next")


def follows(new: int, old: int) -> bool:
    """Whether a blend with these weights, of 256, is always the last mask: one sight sets a pixel, and one miss unsets it."""
    return new * 255 // 256 >= GREY_SET > old * 255 // 256
