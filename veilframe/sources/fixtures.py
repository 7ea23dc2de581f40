"""Views of visual observations over the star-schema tables, in SQL that Spark and DuckDB read alike.

Keys come from the tables' own columns, so a view needs no global numbering and scales with its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FRAME_W, FRAME_H = 1920, 1080

#: A frame holds the lines of 25 consecutive orders: about a hundred boxes.
VIEWS: dict[str, tuple[str, str]] = {
    "boxes": (
        "lineitem",
        """SELECT CAST(floor(l_orderkey / CAST(25 AS DOUBLE)) AS BIGINT) AS frame_idx,
  ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS det_id,
  CAST(l_linenumber % 2 AS INT) AS src,
  CAST(l_discount AS DOUBLE) * CAST(9 AS DOUBLE) + ((l_orderkey * 31 + l_linenumber * 17 + l_partkey * 7 + l_suppkey * 3) % 997) / CAST(9970 AS DOUBLE) AS score,
  CAST((l_partkey * 7) % 1500 AS DOUBLE) AS x1, CAST((l_suppkey * 11 + l_partkey) % 900 AS DOUBLE) AS y1,
  CAST((l_partkey * 7) % 1500 AS DOUBLE) + CAST(l_quantity AS DOUBLE) * CAST(4 AS DOUBLE) + CAST(40 AS DOUBLE) AS x2,
  CAST((l_suppkey * 11 + l_partkey) % 900 AS DOUBLE) + CAST(l_quantity AS DOUBLE) * CAST(3 AS DOUBLE) + CAST(60 AS DOUBLE) AS y2,
  l_returnflag AS flag, CAST(l_tax AS DOUBLE) AS tax, CAST(l_quantity AS DOUBLE) AS qty
FROM lineitem""",
    ),
    "persons": ("boxes", "SELECT frame_idx, det_id, score, x1, y1, x2, y2 + CAST(200 AS DOUBLE) AS y2 FROM boxes WHERE flag = 'A'"),
    "faces": (
        "boxes",
        """SELECT frame_idx, det_id, score, x1 + CAST(20 AS DOUBLE) AS x1, y1 + CAST(10 AS DOUBLE) AS y1, x1 + CAST(30 AS DOUBLE) + qty AS x2, y1 + CAST(22 AS DOUBLE) + qty * CAST(1.25 AS DOUBLE) AS y2,
  CASE WHEN tax > CAST(0.01 AS DOUBLE) THEN qty * tax * CAST(5 AS DOUBLE) END AS eye_dist
FROM boxes WHERE flag = 'R'""",
    ),
    # one observation of a user's value for each event; a missed one where the event is an error
    "obs": ("events", "SELECT user_id, event_id AS seq, CAST(value AS DOUBLE) AS z, event_type <> 'error' AS hit FROM events"),
    "frames": ("events", "SELECT event_id AS frame_idx, CAST(event_id AS DOUBLE) * CAST(1000 AS DOUBLE) / CAST(15 AS DOUBLE) AS t_ms, user_id, event_type FROM events"),
    # rectangles of up to 16 pixels a side on a 64 x 64 grid, one for each part, eight parts to a frame
    "rects": ("part", "SELECT CAST(floor(p_partkey / CAST(8 AS DOUBLE)) AS BIGINT) AS frame_idx, p_partkey AS rect_id, CAST((p_partkey * 13) % 48 AS INT) AS rx, CAST((p_partkey * 29) % 48 AS INT) AS ry, CAST(p_size % 12 AS INT) + 4 AS rw, CAST(p_size % 9 AS INT) + 4 AS rh FROM part"),
    "pixels": ("rects", ""),
    "patches": ("orders", "SELECT o_orderkey AS seq, CAST(o_custkey % 200 AS BIGINT) AS frame_idx, CASE WHEN o_orderstatus = 'F' THEN 'erase' ELSE 'add' END AS op, CAST((o_orderkey * 7) % 56 AS INT) AS px, CAST((o_orderkey * 11) % 56 AS INT) AS py, CAST(o_orderkey % 5 AS INT) + 2 AS side FROM orders"),
}

DUCK_PIXELS = "SELECT DISTINCT frame_idx, y::INT AS y, x::INT AS x FROM (SELECT frame_idx, unnest(range(ry, ry + rh)) AS y, rx, rw FROM rects) AS a, unnest(range(rx, rx + rw)) AS t(x)"
SPARK_PIXELS = "SELECT DISTINCT frame_idx, y, x FROM (SELECT frame_idx, explode(sequence(ry, ry + rh - 1)) AS y, rx, rw FROM rects) LATERAL VIEW explode(sequence(rx, rx + rw - 1)) t AS x"


def needs(name: str) -> list[str]:
    """The views that a view stands on, itself last."""
    base = VIEWS[name][0]
    return [*(needs(base) if base in VIEWS else []), name]


def fill(sql: str) -> str:
    """DuckDB SQL with a WITH list for the views named in a first line `-- views: a b`."""
    first, _, rest = sql.strip().partition("\n")
    if not first.startswith("-- views:"):
        return sql
    wanted = list(dict.fromkeys(v for name in first.removeprefix("-- views:").split() for v in needs(name)))
    text = {v: DUCK_PIXELS if v == "pixels" else VIEWS[v][1] for v in wanted}
    return "WITH RECURSIVE " + ",\n".join(f"{v} AS ({text[v]})" for v in wanted) + rest


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, text = VIEWS[name]
    source = view(spark, sf_dir, base) if base in VIEWS else spark.read.parquet(f"{sf_dir}/{base}.parquet")
    text = SPARK_PIXELS if name == "pixels" else text
    return spark.sql(text.replace(f"FROM {base}", "FROM {source}"), source=source)
