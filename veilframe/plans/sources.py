"""Queries of text scans, names and stored results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import spread
from ..registry import query
from ..sources import probe

# Reports in the form that the usual media tool prints.
REPORTS = [
    ("walk.mp4", "Input #0, mov, from 'walk.mp4':\n  Duration: 00:00:42.25, start: 0.000000, bitrate: 3412 kb/s\n  Stream #0:0[0x1](und): Video: hevc (Main 10) (hev1 / 0x31766568), yuv420p10le(tv, bt709), 1280x720, 3301 kb/s, 24 fps, 24 tbr, 12288 tbn\n  Stream #0:1[0x2](und): Audio: opus, 48000 Hz, mono", 1280, 720, 24.0, "hevc", 1014, "opus", 42.25),
    ("phone.mov", "Input #0\n  Duration: 00:01:40.00, start: 0\n  Stream #0:0: Video: h264 (Baseline), yuv420p, 720x1280 [SAR 1:1 DAR 9:16], 25 tbr\n    displaymatrix: rotation of 90.00 degrees", 1280, 720, 25.0, "h264", 2500, "", 100.0),
    ("film.mkv", "  Duration: 01:02:03.50, start: 0\n  Stream #0:0: Video: av1, yuv420p10le, 3840x2160, 29.97 fps, 1k tbn\n  Stream #0:1: Audio: truehd, 48000 Hz\n  Stream #0:2: Audio: ac3, 48000 Hz", 3840, 2160, 29.97, "av1", 111593, "truehd,ac3", 3723.5),
    ("cam.avi", "  Duration: N/A\n  Stream #0:0: Video: mjpeg, yuvj422p, 640x480, 90k tbn", 640, 480, 30.0, "mjpeg", None, "", None),
    ("odd.ts", "  Duration: 00:00:08.00\n  Stream #0:0: Video: mpeg2video, yuv420p, 704x576, 90000 fps, 50 tbr", 704, 576, 30.0, "mpeg2video", 240, "", 8.0),
]


#: What a part's report says of its picture, rate, sound and turn.
_CODECS, _SOUNDS = ("hevc (Main 10)", "h264 (Baseline)", "av1"), ("aac (LC)", "opus", "truehd")

_PROBE = f"""WITH p AS (SELECT p_partkey AS k, (640 + p_size % 5 * 160) AS a, (360 + p_size % 7 * 40) AS b, p_partkey % 4 AS rate, p_partkey % 3 AS turn, p_partkey % 3 AS sounds, p_partkey % 90 + 5 AS secs, (['hevc', 'h264', 'av1'])[(p_partkey % 3 + 1)::INT] AS codec FROM part),
r AS (SELECT *, CASE rate WHEN 0 THEN 24.0::DOUBLE WHEN 1 THEN 29.97::DOUBLE WHEN 2 THEN 50.0::DOUBLE ELSE 30.0::DOUBLE END AS fps FROM p)
SELECT 'part-' || k || '.mp4' AS path, CASE WHEN turn = 1 THEN b ELSE a END::INT AS width, CASE WHEN turn = 1 THEN a ELSE b END::INT AS height, fps, codec, round(secs * fps)::BIGINT AS total_frames, CASE sounds WHEN 0 THEN '' WHEN 1 THEN 'aac' ELSE 'aac,opus' END AS audio FROM r"""


@query("probe_parse", _PROBE)
def probe_parse(spark, sf_dir):
    """Media reports, one for each part, in the form that the usual media tool prints: rates, base rates, none and
    impossible ones, turned pictures, several sound tracks."""
    k, size = F.col("p_partkey"), F.col("p_size")
    a, b, secs = 640 + size % 5 * 160, 360 + size % 7 * 40, k % 90 + 5
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    rate = F.when(k % 4 == 0, ", 24 fps, 24 tbr").when(k % 4 == 1, ", 29.97 fps").when(k % 4 == 2, ", 50 tbr, 90k tbn").otherwise(", 90000 fps")
    lines = F.concat(
        F.format_string("Input #0, mov, from 'part-%d.mp4':\n  Duration: %02d:%02d:%02d.00, start: 0.000000\n  Stream #0:0[0x1](und): Video: ", k, F.lit(0), F.floor(secs / 60), secs % 60), pick(_CODECS, k % 3), F.lit(" (tag / 0x31766568), yuv420p, "), a.cast("string"), F.lit("x"), b.cast("string"), rate, F.lit("\n"),
        F.when(k % 3 == 1, "    displaymatrix: rotation of -90.00 degrees\n").otherwise(""),
        F.when(k % 3 >= 1, F.concat(F.lit("  Stream #0:1[0x2](und): Audio: "), F.lit(_SOUNDS[0]), F.lit(", 48000 Hz, stereo\n"))).otherwise(""),
        F.when(k % 3 == 2, F.concat(F.lit("  Stream #0:2: Audio: "), F.lit(_SOUNDS[1]), F.lit(", 48000 Hz, mono\n"))).otherwise(""),
    )
    r = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size"), "p_partkey").select(F.format_string("part-%d.mp4", k).alias("path"), lines.alias("stderr"))
    return probe.parse(r).select("path", "width", "height", "fps", "codec", "total_frames", F.array_join("audio_codecs", ",").alias("audio"))


@query("output_name", "SELECT p_partkey, regexp_replace(p_name, ' ', '_', 'g') || '_mosaic_' || (['fast', 'balanced', 'fine'])[(p_size % 3 + 1)::INT] || '.mp4' AS output, regexp_replace(p_name, ' ', '_', 'g') || '_masks' AS masks_dir FROM part")
def output_name(spark, sf_dir):
    stem = F.regexp_replace("p_name", " ", "_")
    tag = F.element_at(F.array(F.lit("fast"), F.lit("balanced"), F.lit("fine")), F.col("p_size") % 3 + 1)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat(stem, F.lit("_mosaic_"), tag, F.lit(".mp4")).alias("output"), F.concat(stem, F.lit("_masks")).alias("masks_dir"))


@query("stderr_tail", "WITH l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS l FROM documents) SELECT doc_id, left(array_to_string(l[-3:], ' | '), 240) AS tail FROM l")
def stderr_tail(spark, sf_dir):
    """The last three lines that are not blank, on one line of at most 240 characters."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(x) != "")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", lines.alias("l"))
    n = F.size("l")
    return d.select("doc_id", F.substring(F.array_join(F.slice("l", F.greatest(n - 2, F.lit(1)), F.lit(3)), " | "), 1, 240).alias("tail"))


@query("queue_restore", "SELECT event_id, event_type AS name, 'balanced' AS preset, event_id % 4 <> 1 AS face FROM events WHERE event_id % 7 <> 3")
def queue_restore(spark, sf_dir):
    """Waiting jobs out of JSON: missing keys take defaults, malformed options lose the row."""
    k = F.col("event_id")
    made = F.when(k % 7 == 3, F.lit('{"name": "x", "opts": 5')).otherwise(F.concat(F.lit('{"name": "'), F.col("event_type"), F.lit('", "opts": {'), F.when(k % 4 == 1, '"face": false').otherwise(""), F.lit("}}")))
    j = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.from_json(made, "name string, opts struct<preset:string,face:boolean>").alias("j")).where("j.opts IS NOT NULL")
    return j.select("event_id", "j.name", F.coalesce("j.opts.preset", F.lit("balanced")).alias("preset"), F.coalesce("j.opts.face", F.lit(True)).alias("face"))


@query("gpu_vendor", "WITH d AS (SELECT n_nationkey // 2 AS machine, CASE n_nationkey % 3 WHEN 0 THEN 'amd' WHEN 1 THEN 'intel' END AS v FROM nation) SELECT machine::BIGINT AS machine, CASE WHEN count(DISTINCT v) = 1 THEN any_value(v) END AS vendor FROM d GROUP BY machine")
def gpu_vendor(spark, sf_dir):
    """The one known maker among a machine's device ids in hexadecimal; none where they are mixed."""
    ids = F.when(F.col("n_nationkey") % 3 == 0, "0x1002").when(F.col("n_nationkey") % 3 == 1, "0x8086").otherwise("0xffff")
    n = F.conv(F.substring(ids, 3, 4), 16, 10).cast("int")
    known = F.when(n == 0x1002, "amd").when(n == 0x8086, "intel")
    d = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.floor(F.col("n_nationkey") / 2).cast("long").alias("machine"), known.alias("v"))
    s = d.groupBy("machine").agg(F.collect_set("v").alias("s"))
    return s.select("machine", F.when(F.size("s") == 1, F.col("s")[0]).alias("vendor"))
