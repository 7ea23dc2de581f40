"""Queries of presets, parameter merging, manifests and ordered candidate choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query

# The five presets (id, conf, face_expand, detect_every, batch, flags face track smooth face_roi tta).
PRESETS = [
    ("speed", 0.35, 12, 1, 4, True, True, False, False, False),
    ("balanced", 0.35, 12, 1, 4, True, True, True, False, False),
    ("accurate", 0.30, 12, 1, 2, True, True, True, True, False),
    ("extreme", 0.25, 14, 1, 1, True, True, True, True, True),
    ("archive", 0.20, 16, 1, 1, True, True, True, True, True),
]
_PRESET_DDL = "id string, conf double, face_expand int, detect_every int, batch int, face boolean, track boolean, smooth boolean, face_roi boolean, tta boolean"
_PRESET_SQL = "(VALUES " + ", ".join(f"('{p[0]}', {p[1]}::DOUBLE, {p[2]}, {p[3]}, {p[4]}, {', '.join(str(x).lower() for x in p[5:])})" for p in PRESETS) + ") AS p(id, conf, face_expand, detect_every, batch, face, track, smooth, face_roi, tta)"


def presets(spark):
    return spark.createDataFrame(PRESETS, _PRESET_DDL)


@query("preset_table", f"SELECT c_custkey, p.* FROM customer JOIN {_PRESET_SQL} ON p.id = (['speed', 'balanced', 'accurate', 'extreme', 'archive'])[(c_nationkey % 5 + 1)::INT]")
def preset_table(spark, sf_dir):
    """Each customer with all that its preset sets."""
    names = F.array(*(F.lit(p[0]) for p in PRESETS))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.element_at(names, (F.col("c_nationkey") % len(PRESETS) + 1).cast("int")).alias("id"))
    return c.join(F.broadcast(presets(spark)), "id")  # five rows


_NAMES = "['speed', 'balanced', 'accurate', 'extreme', 'archive']"


@query("param_merge", f"""WITH c AS (SELECT c_custkey, ({_NAMES})[(c_custkey % 5 + 1)::INT] AS id, CASE WHEN c_custkey % 4 = 0 THEN 0.5::DOUBLE END AS conf, (c_custkey % 3)::INT AS every, (c_custkey % 3)::INT AS tri FROM customer)
SELECT c_custkey, c.id AS preset, coalesce(c.conf, p.conf) AS conf, CASE WHEN c.every = 0 THEN p.detect_every ELSE c.every END::INT AS detect_every, CASE c.tri WHEN 0 THEN p.smooth WHEN 1 THEN true ELSE false END AS smooth FROM c JOIN {_PRESET_SQL} ON p.id = c.id""")
def param_merge(spark, sf_dir):
    """Asked for over preset: null or 0 leaves the preset's value; a tri-state is 0 preset, 1 on, 2 off."""
    names = F.array(*(F.lit(p[0]) for p in PRESETS))
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.element_at(names, (k % 5 + 1).cast("int")).alias("id"), F.when(k % 4 == 0, F.lit(0.5)).alias("own_conf"), F.nullif((k % 3).cast("int"), F.lit(0)).alias("own_every"), (k % 3).alias("tri"))
    j = c.join(F.broadcast(presets(spark)), "id")
    smooth = F.when(F.col("tri") == 0, F.col("smooth")).otherwise(F.col("tri") == 1)
    return j.select("c_custkey", F.col("id").alias("preset"), F.coalesce("own_conf", "conf").alias("conf"), F.coalesce("own_every", "detect_every").alias("detect_every"), smooth.alias("smooth"))


_FILES = "m AS (SELECT doc_id, upper(sha256(text)) AS expected FROM documents), f AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) AS actual FROM documents WHERE doc_id % 17 <> 0)"


def _manifest(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = d.select("doc_id", F.upper(F.sha2("text", 256)).alias("expected"))
    text = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return m, d.where("doc_id % 17 <> 0").select("doc_id", F.sha2(text, 256).alias("actual"))


@query("manifest_verify", f"WITH {_FILES} SELECT m.doc_id, CASE WHEN f.actual IS NULL THEN 'missing' WHEN lower(m.expected) = lower(f.actual) THEN 'ok' ELSE 'corrupt' END AS status FROM m LEFT JOIN f ON f.doc_id = m.doc_id")
def manifest_verify(spark, sf_dir):
    """Listed files against found ones: ok, corrupt or missing; hashes compare whatever their case."""
    m, f = _manifest(spark, sf_dir)
    status = F.when(F.col("actual").isNull(), "missing").when(F.lower("expected") == F.lower("actual"), "ok").otherwise("corrupt")
    return m.join(f, "doc_id", "left").select("doc_id", status.alias("status"))


@query("verify_counters", f"WITH {_FILES} SELECT count(*) FILTER (WHERE lower(expected) = actual)::BIGINT AS ok, count(*) FILTER (WHERE lower(expected) <> actual)::BIGINT AS fail, count(*) FILTER (WHERE actual IS NULL)::BIGINT AS miss FROM m LEFT JOIN f ON f.doc_id = m.doc_id")
def verify_counters(spark, sf_dir):
    m, f = _manifest(spark, sf_dir)
    j = m.join(f, "doc_id", "left")
    return j.agg(F.count_if(F.lower("expected") == F.col("actual")).alias("ok"), F.count_if(F.lower("expected") != F.col("actual")).alias("fail"), F.count_if(F.col("actual").isNull()).alias("miss"))


@query("preset_ready", """WITH n AS (SELECT s_suppkey, unnest(['body', 'face', 'tracker']) AS part, unnest([s_suppkey % 4, s_suppkey % 5, s_suppkey % 3]) AS k FROM supplier)
SELECT s_suppkey, bool_and(k <> 0) AS ready, coalesce(string_agg(part, ',' ORDER BY part) FILTER (WHERE k = 0), '') AS missing FROM n GROUP BY s_suppkey""")
def preset_ready(spark, sf_dir):
    """Whether all components of a preset are there, and which are not."""
    k = F.col("s_suppkey")
    parts = F.array(*(F.struct(F.lit(n).alias("part"), (k % m != 0).alias("there")) for n, m in (("body", 4), ("face", 5), ("tracker", 3))))
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.explode(parts).alias("p")).select("s_suppkey", "p.*")
    return n.groupBy("s_suppkey").agg(F.every("there").alias("ready"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("there"), F.col("part")))), ",").alias("missing"))


@query("resolve_first", "WITH c AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders) SELECT o_custkey, arg_min(o_orderkey, pos) AS chosen FROM c WHERE o_orderkey % 3 <> 0 GROUP BY o_custkey")
def resolve_first(spark, sf_dir):
    """Of each list of candidates the first that exists."""
    from pyspark.sql import Window

    c = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("pos"))
    return c.where("o_orderkey % 3 <> 0").groupBy("o_custkey").agg(F.min_by("o_orderkey", "pos").alias("chosen"))


# Ancestors of a program and of the working folder that are looked through.
PROGRAM_UP, FOLDER_UP = 10, 3


@query("search_roots", f"""WITH p AS (SELECT page_id, string_split(url, '/') AS parts FROM pages WHERE url IS NOT NULL), n AS (SELECT page_id, parts, len(parts) AS n, greatest(len(parts) - 2, 1) AS m FROM p),
a AS (SELECT page_id, list_concat(list_transform(range(0, least(n, {PROGRAM_UP})), lambda k: array_to_string(parts[1:n - k], '/')), list_transform(range(0, least(m, {FOLDER_UP})), lambda k: array_to_string(parts[1:m - k], '/'))) AS l FROM n),
r AS (SELECT page_id, unnest(l) AS root, generate_subscripts(l, 1) AS i FROM a), d AS (SELECT page_id, root, min(i) AS i FROM r WHERE root <> '' GROUP BY page_id, root)
SELECT page_id, root, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS pos FROM d""")
def search_roots(spark, sf_dir):
    """Folders to look through: ancestors of a program's path (here a page's), nearest first, then those of the folder
    it runs in (two up), each once, at their first place."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.split("url", "/", -1).alias("parts"))
    n = F.size("parts")
    m = F.greatest(n - 2, F.lit(1))
    up = lambda of, most: F.transform(F.sequence(F.lit(0), F.least(of, F.lit(most)) - 1), lambda k: F.array_join(F.slice("parts", F.lit(1), of - k), "/"))
    roots = F.array_distinct(F.filter(F.concat(up(n, PROGRAM_UP), up(m, FOLDER_UP)), lambda x: x != ""))
    return p.where("parts IS NOT NULL").select("page_id", F.posexplode(roots).alias("pos", "root"))


@query("encoder_chain", """WITH c AS (SELECT n_nationkey, unnest(['hevc_vt', 'hevc_nvenc', 'hevc_vaapi', 'libx265']) AS enc, unnest(range(0, 4)) AS pos FROM nation)
SELECT n_nationkey, string_agg(enc, ',' ORDER BY pos) AS chain FROM c WHERE pos = 3 OR (n_nationkey + pos) % 3 = 0 GROUP BY n_nationkey""")
def encoder_chain(spark, sf_dir):
    """Wanted encoders that the machine has, in order, and the software one at the end in any case."""
    chain = ["hevc_vt", "hevc_nvenc", "hevc_vaapi", "libx265"]
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    have = F.filter(F.array(*map(F.lit, chain)), lambda e, i: (i == len(chain) - 1) | ((F.col("n_nationkey") + i) % 3 == 0))
    return n.select("n_nationkey", F.array_join(F.array_distinct(have), ",").alias("chain"))


@query("batch_variant", "SELECT p_partkey, regexp_replace(p_name || '.onnx', '\\.onnx$', '-b4.onnx') AS name FROM part")
def batch_variant(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.regexp_replace(F.concat("p_name", F.lit(".onnx")), r"\.onnx$", "-b4.onnx").alias("name"))


@query("style_parse", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'solid' WHEN p_partkey % 3 = 1 THEN 'mosaic' ELSE 'blur' END AS style, CASE WHEN p_partkey % 3 = 1 THEN least(greatest(p_size * 4, 2), 128) WHEN p_partkey % 3 = 2 THEN least(greatest(p_size * 2, 1), 64) ELSE 0 END::INT AS amount FROM part")
def style_parse(spark, sf_dir):
    """How to hide, with the amount held in its bounds: cells of 2 to 128 pixels, radii of 1 to 64."""
    k, s = F.col("p_partkey") % 3, F.col("p_size")
    amount = F.when(k == 1, F.least(F.greatest(s * 4, F.lit(2)), F.lit(128))).when(k == 2, F.least(F.greatest(s * 2, F.lit(1)), F.lit(64))).otherwise(0)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.when(k == 0, "solid").when(k == 1, "mosaic").otherwise("blur").alias("style"), amount.cast("int").alias("amount"))


@query("label_lookup", "WITH m AS (SELECT * FROM (VALUES ('click', 'Klick'), ('view', 'Ansicht'), ('purchase', 'Kauf')) AS t(k, v)) SELECT event_id, coalesce(m.v, event_type) AS label FROM events LEFT JOIN m ON m.k = event_type")
def label_lookup(spark, sf_dir):
    """A label in another language, or the key itself."""
    words = F.create_map(*(F.lit(x) for p in (("click", "Klick"), ("view", "Ansicht"), ("purchase", "Kauf")) for x in p))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.coalesce(F.try_element_at(words, F.col("event_type")), F.col("event_type")).alias("label"))


@query("choice_whitelist", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'auto' END AS choice FROM events WHERE event_id - 500 >= 0")
def choice_whitelist(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_id") - 500 >= 0)
    return e.select("event_id", F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).otherwise("auto").alias("choice"))


@query("audio_transcode", """WITH a AS (SELECT o_orderkey, ['aac', CASE o_orderkey % 4 WHEN 0 THEN 'TrueHD' WHEN 1 THEN 'dts' WHEN 2 THEN 'mp3' ELSE 'mlp' END] AS codecs, CASE o_orderkey % 3 WHEN 0 THEN 'mp4' WHEN 1 THEN 'mkv' ELSE 'mov' END AS ext FROM orders)
SELECT o_orderkey, ext IN ('mp4', 'mov', 'm4v') AND len(list_filter(codecs, lambda c: lower(c) IN ('truehd', 'mlp', 'dts'))) > 0 AS transcode FROM a""")
def audio_transcode(spark, sf_dir):
    """Whether any sound track must be coded anew for the container."""
    k = F.col("o_orderkey")
    codecs = F.array(F.lit("aac"), F.when(k % 4 == 0, "TrueHD").when(k % 4 == 1, "dts").when(k % 4 == 2, "mp3").otherwise("mlp"))
    ext = F.when(k % 3 == 0, "mp4").when(k % 3 == 1, "mkv").otherwise("mov")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (ext.isin("mp4", "mov", "m4v") & F.exists(codecs, lambda c: F.lower(c).isin("truehd", "mlp", "dts"))).alias("transcode"))


@query("track_palette", "SELECT c_custkey, (['red', 'green', 'blue', 'cyan', 'magenta', 'yellow', 'orange', 'white'])[(c_custkey % 8 + 1)::INT] AS color FROM customer")
def track_palette(spark, sf_dir):
    colors = F.array(*map(F.lit, ("red", "green", "blue", "cyan", "magenta", "yellow", "orange", "white")))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.element_at(colors, (F.col("c_custkey") % 8 + 1).cast("int")).alias("color"))
