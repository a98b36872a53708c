"""Written tables between the rounds of iterative plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset: in one JVM (a local master, as in tests) a temporary folder, which goes with the
    driver; on a cluster a folder of the warehouse, which driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isEmpty():
        return held.get().rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lattica-stages"
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="lattica-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: no lineage to repeat if an executor is lost, and sizes are known."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica-stage-{uuid.uuid4().hex}"
    _made.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended
            return
