"""Spark session and shared-folder helpers.

Cluster jobs read their settings from the session the cluster gives them; the
helpers here only fill in what is unset (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at scale. AQE re-plans joins from runtime sizes (the size
# check behind every broadcast), coalesces small shuffle partitions and splits
# skewed ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "valorum", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the scale settings.

    ``master`` and ``shuffle_partitions`` are for local runs; on a cluster leave
    them unset so the cluster's own values stay in force.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SCALE_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a local master that names none (tests) gets a scratch folder. On a cluster every executor would
    write to its own disk, so there an unnamed folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="valorum-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", named)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (for written tables and stream state)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, *parts])


def work_table(df, label: str):
    """Write ``df`` as a Parquet work table in the shared folder and read it back.

    Cuts the lineage of an expensive intermediate that several branches of a plan
    read (it is computed once, survives executor loss, and gives AQE exact sizes). The shuffle files
    of the job that writes it go when it ends; else they stay until the driver happens to collect its garbage.
    """
    import uuid

    spark = df.sparkSession
    path = shared_path(spark, "work", f"{label}-{uuid.uuid4().hex}")
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before) if before is not None else spark.conf.unset(_DROP_SHUFFLES)
    return spark.read.parquet(path)


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def drop_table(table) -> None:
    """Delete a work table that nothing reads any more: what was made of it must be written."""
    spark = table.sparkSession
    jvm = spark._jvm
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        if "/work/" not in folder:
            raise ValueError(f"not a work table: {folder}")
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df, min_partitions: int | None = None):
    """Deal the rows of a small input over the cluster's cores (or ``min_partitions``) before CPU-heavy row work.

    A frame read from few files (or one row group) arrives as few tasks. If the planner's size of the frame already
    makes a split for every core, it is returned as it is: nothing is shuffled at scale. A smaller one is dealt out, so a
    partition holds less than a split. Starts no job.
    """
    spark = df.sparkSession
    wanted = min_partitions or spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if int(str(plan.stats().sizeInBytes())) >= split * wanted:
        return df
    return df.repartition(wanted)
