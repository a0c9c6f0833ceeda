"""SparkSession construction and session-derived settings.

Everything here is plain Spark configuration. Library functions never
create a session themselves; they take one (or a DataFrame) from the caller.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this package relies on.  UTC matters for
# unix_seconds(cast(ntz as timestamp)) (V11); AQE gives runtime broadcast
# decisions from measured sizes, partition coalescing and skew-join splits.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "tillpoint", extra: dict | None = None) -> SparkSession:
    """Session for tests and local runs.  On a cluster, use the cluster's
    own session and call :func:`ensure_conf` on it."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_conf(spark: SparkSession) -> SparkSession:
    """Apply the runtime-settable part of BASE_CONF to an existing session."""
    for k, v in BASE_CONF.items():
        if k == "spark.ui.enabled":
            continue
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a running session: leave as is
            pass
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session.  Only when it is
    unset (local tests) do we pick a fresh scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (a machine-local folder "
                               "does not survive executor loss on a cluster)")
        d = tempfile.mkdtemp(prefix="tillpoint-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_table(spark: SparkSession, name: str) -> str:
    """A new folder of its own under the shared checkpoint folder, for a table
    that lives as long as the job."""
    base = spark.sparkContext.getCheckpointDir() or ensure_checkpoint_dir(spark)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a scratch table, read back: cuts lineage as a reliable
    checkpoint does, but computes ``df`` once (an eager checkpoint counts the
    rows first and computes the last stage again to save it), takes less
    space, and readers get only the columns they use."""
    path = scratch_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
