"""Session and shared-storage helpers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str = "local[*]", partitions: int = 8, app: str = "sprigwork", **conf: str) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Where the setting is absent on a local master (tests, a laptop) a temporary folder is made, set in the session and removed
    at exit; on a cluster that would be one machine's folder, so it is an error there.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share; it is not set")
        path = tempfile.mkdtemp(prefix="sprigwork-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set(CHECKPOINT_KEY, path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sprigwork/{name}-{uuid.uuid4().hex}"


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over as many tasks as the cluster runs, for work that costs far more than its bytes say.

    With keys: by these, in the session's number of shuffle partitions, which adaptive execution would else merge by size.
    Without: only if the scan has fewer partitions than the cluster has slots (a few small files).
    """
    spark = df.sparkSession
    if keys:
        return df.repartition(partitions_of(spark), *keys)
    slots = spark.sparkContext.defaultParallelism
    if df._jdf.queryExecution().executedPlan().nodeName().startswith("Adaptive"):
        return df  # it shuffles anyhow; asking for its partitions would run it
    return df.repartition(slots) if df._jdf.rdd().getNumPartitions() < slots else df


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df marked for broadcast if its counted rows are few, else as it is (the join then shuffles)."""
    return F.broadcast(df) if df.count() <= rows else df


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
