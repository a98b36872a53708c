"""Ingestion of new subjects as a stream: each batch appends the incidence rows of subjects that are not there yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def ingest_hits(spark: SparkSession, source: str, out: str, checkpoint: str, schema: str = "subject string, cluster int, vertex long", late: str | None = None) -> StreamingQuery:
    """Counts hits of Parquet files that appear under source into ``out``, partitioned by subject; a subject is counted once, in the batch
    that brings it first, whose number its rows carry.

    A batch that is repeated after a failure writes its subjects again and adds nothing twice: partitions are overwritten as a whole. Rows
    of a subject that an earlier batch has brought are not counted; they go to ``late`` (by default out with "_late"), partitioned by batch.
    """
    late = late or out.rstrip("/") + "_late"

    def append(batch: DataFrame, number: int) -> None:
        # a folder that is there but cannot be read is an error: no subject is taken for new because of it
        done = spark.read.schema(f"{schema}, n long, batch long").parquet(out).where(F.col("batch") != number).select("subject").distinct() if there(spark, out) else batch.select("subject").limit(0)
        new = batch.join(done, "subject", "left_anti").groupBy("subject", "cluster", "vertex").agg(F.count("*").alias("n"), F.lit(number).cast("long").alias("batch"))
        again = batch.join(done, "subject", "left_semi").withColumn("batch", F.lit(number).cast("long"))
        again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(late)
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("subject").parquet(out)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
