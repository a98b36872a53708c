"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.plans.staging import shared_dir

_written: list[tuple[SparkSession, str]] = []


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def free(df: DataFrame) -> str:
    """A beginning of names that no column of df has."""
    start = "_"
    while any(c.lower().startswith(start) for c in df.columns):
        start += "_"
    return start


def settled() -> None:
    """Gives a Python worker's free memory back at the end of a task: workers live on beside the executor's heap."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/lattica-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended already; its folder is not reachable any more
            return


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges (a, b)``: one row ``(node, component)`` per node, component its smallest node.

    Every round takes the least label among the neighbours and then follows that label's own label,
    so paths halve. Labels are a written table each round: hot nodes are split by adaptive skew joins,
    and the minimum is combined before the shuffle.
    """
    both = table(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        hooked = table(labels.join(near, "node").select("node", F.least("component", "m").alias("component")), "labels")
        up = hooked.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped = table(hooked.join(up, "component").select("node", F.col("up").alias("component")), "labels")
        moved = labels.withColumnRenamed("component", "was").join(jumped, "node").where("was <> component").limit(1).count()
        labels = jumped
        if not moved:
            return labels
