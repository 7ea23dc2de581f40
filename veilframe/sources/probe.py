"""Media facts out of a tool's printed report: one row a path, from lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse(reports: DataFrame) -> DataFrame:
    """(path, width, height, fps, codec, duration, total_frames, rotation, has_audio, audio_codecs) of reports (path, stderr).

    The first video line counts. Where a line has no rate its base rate counts; a rate must lie between 0 and 1000, else it is 30.
    A picture turned by about 90 degrees has its sides exchanged."""
    lines = F.split("stderr", "\n")
    first = F.get(F.filter(lines, lambda x: x.rlike(r"Stream #.*: Video:")), F.lit(0))
    sound = F.transform(F.filter(lines, lambda x: x.rlike(r"Stream #.*: Audio:")), lambda x: F.regexp_extract(x, r"Audio: ([^ ,(]+)", 1))
    r = reports.select("path", "stderr", first.alias("v"), sound.alias("audio_codecs"))
    # tags in hexadecimal look like sizes; a size has sides of 2 to 8192
    size = r"(?<![0-9A-Za-z])[0-9]{1,5}x[0-9]{1,5}(?![0-9A-Za-z])"
    side_of = lambda x, i: F.split_part(x, F.lit("x"), F.lit(i)).cast("int")
    sizes = F.filter(F.regexp_extract_all("v", F.lit(size), F.lit(0)), lambda x: side_of(x, 1).between(2, 8192) & side_of(x, 2).between(2, 8192))
    number = lambda p: F.expr(f"try_cast(nullif(regexp_extract(v, '{p}', 1), '') AS double)")
    fps, base = number(r"([0-9.]+) fps"), number(r"([0-9.]+) tbr")
    sane = lambda x: F.when((x > 0) & (x < 1000), x)
    d = r"Duration: ([0-9]+):([0-9]{2}):([0-9]{2}(?:\.[0-9]+)?)"
    part = lambda i: F.expr(f"try_cast(nullif(regexp_extract(stderr, '{d}', {i}), '') AS double)".replace("\\", "\\\\"))
    turn = F.expr(r"try_cast(nullif(regexp_extract(stderr, 'rotation of (-?[0-9.]+) degrees', 1), '') AS double)")
    r = r.select("path", "audio_codecs", F.regexp_extract("v", r"Video: ([^ ,(]+)", 1).alias("codec"), F.get(sizes, F.lit(0)).alias("wh"), F.coalesce(sane(F.coalesce(fps, base)), F.lit(30.0)).alias("fps"), (part(1) * 3600 + part(2) * 60 + part(3)).alias("duration"), F.coalesce(turn, F.lit(0.0)).alias("rotation"))
    r = r.where("wh IS NOT NULL").select("*", side_of(F.col("wh"), 1).alias("w"), side_of(F.col("wh"), 2).alias("h"))
    side = F.abs(F.abs("rotation") - 90) < 1
    return r.select(
        "path", F.when(side, F.col("h")).otherwise(F.col("w")).alias("width"), F.when(side, F.col("w")).otherwise(F.col("h")).alias("height"), "fps", "codec", "duration",
        F.round(F.col("duration") * F.col("fps")).cast("long").alias("total_frames"), "rotation", (F.size("audio_codecs") > 0).alias("has_audio"), "audio_codecs",
    )
