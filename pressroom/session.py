"""Session helpers: a local session for tests/bench and the checkpoint folder.

On a cluster the session comes from the caller; the library only reads its
settings.  ``spark.checkpoint.dir`` must name a shared folder there; a local
temporary folder is chosen only when the setting is absent (tests, bench).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "pressroom") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # page rows are large: small Arrow batches keep the JVM and the HTML
        # tokenizer working side by side instead of one after the other
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PRESSROOM_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The reliable checkpoint folder of this session, set only if unset.

    Under Spark Connect the folder is the server's setting and is not touched.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: no driver-side context
        return spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # one machine (tests, bench)
        conf_dir = tempfile.mkdtemp(prefix="pressroom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table next to the checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system that it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def materialize(df):
    """Write ``df`` as Parquet next to the checkpoint folder now and continue from it.

    Used where one costly intermediate feeds two branches (so it is computed
    once) or must not change between two reads.  It cuts lineage, so a lost
    executor re-reads the written files instead of recomputing, and readers that
    need few columns read few columns.
    """
    path = shared_path(df.sparkSession, f"step-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
