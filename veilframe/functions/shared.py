"""The folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where everything runs on one machine and spark.checkpoint.dir is not set.
LOCAL_SHARED = "/tmp/checkpoints/veilframe"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only on a local master, since executors don't see one another's."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or LOCAL_SHARED


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once into the shared folder and read back: what stands on it runs without what it stands on."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes up to which a small table is sent to a large one's rows.
SENT_BYTES = 64 << 20


def beside(large: DataFrame, small: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """large with small's columns where keys are equal, else nulls. small is stored; where its files hold at most
    SENT_BYTES and its rows at most a million it is sent to large's rows, which stay where they are, else both meet by keys."""
    from pyspark.sql import functions as F

    kept = stored(small, "beside")
    jvm = kept.sparkSession.sparkContext._jvm
    conf = kept.sparkSession.sparkContext._jsc.hadoopConfiguration()
    size = sum(f.getLen() for path in (jvm.org.apache.hadoop.fs.Path(x) for x in kept.inputFiles()) for f in [path.getFileSystem(conf).getFileStatus(path)])
    if size <= SENT_BYTES // 8 and kept.count() <= 1_000_000:  # files are packed: rows may be some times as large
        kept = F.broadcast(kept)
    return large.join(kept, list(keys), "left")


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that meets the other by keys and is never sent whole: sizes that are guessed from files know
    nothing of rows that were made from a row, so that a side of any size may pass for a small one."""
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as the session's shuffles have. Rows of little size but much work would else be
    gathered into a few tasks by their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
