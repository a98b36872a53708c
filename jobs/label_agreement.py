"""Agreement of two parcellations of the day, kept up to date while events arrive.

Events are units of two label maps: the parts of the day of ``first`` minutes and of ``second`` minutes. A run takes the files of
events that are new since the last one, counts the labels that meet, for each subject (event_type), and adds the counts to those
of earlier runs; then it writes, for each subject and label of the first map, the label of the second map of greatest Jaccard index.

    python -m jobs.label_agreement --events s3a://bucket/events --output s3a://bucket/agreement --checkpoint s3a://bucket/agreement-mark
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import main
from lattica.operators import labels as L
from lattica.streaming.ingest import there

log = logging.getLogger("label_agreement")
UNKNOWN = "unknown"
CELLS = "event_type string, u int, v int, n long, batch long"
OUT = "u int, v int, n long, jaccard double, event_type string"


def part_of_day(minutes: int) -> Column:
    """Number of the part of the day, from 1; 0, the background, for events without a time."""
    return F.coalesce(F.floor((F.hour("ts") * 60 + F.minute("ts")) / minutes).cast("int") + 1, F.lit(0))


def watched(path: str) -> str:
    """The path as a pattern that nothing else matches: streams take folders and patterns, and the table may be one file."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def take_new(spark: SparkSession, events: str, cells: str, checkpoint: str, first: int, second: int) -> int:
    """Counts the events of new files into ``cells``, a folder for each batch; the number of new events.

    The checkpoint knows the files taken. A batch that broke off comes again with its number and replaces its folder.
    """
    def add(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("event_type", "u", "v").agg(F.count("*").alias("n")).withColumn("batch", F.lit(number).cast("long"))
        counts.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(cells)  # a row for each two labels

    source = spark.readStream.schema(spark.read.parquet(events).schema).parquet(watched(events))
    labelled = source.select(F.coalesce("event_type", F.lit(UNKNOWN)).alias("event_type"), part_of_day(first).alias("u"), part_of_day(second).alias("v"))
    stream = labelled.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    return sum(p["numInputRows"] for p in stream.recentProgress)


def agreement(cells: DataFrame) -> DataFrame:
    """(event_type, u, v, n, jaccard) of ``cells (event_type, u, v, n)``: for each label u the label v that agrees best; a table of labels."""
    total = cells.groupBy("event_type", "u", "v").agg(F.sum("n").alias("n"))
    over = lambda x: F.sum("n").over(Window.partitionBy("event_type", x))
    sized = total.withColumns({"nu": over("u"), "nv": over("v")})
    # labels of all subjects side by side, so that one matching serves all
    number = F.dense_rank().over(Window.orderBy("event_type")).cast("long") * 1441
    sized = sized.withColumns({"gu": F.when(F.col("u") != 0, number + F.col("u")).otherwise(0), "gv": F.when(F.col("v") != 0, number + F.col("v")).otherwise(0)})
    best = L.best_jaccard(sized.where("gu <> 0 and gv <> 0").select(F.col("gu").alias("u"), F.col("gv").alias("v"), "n", "nu", "nv"), sized.select(F.col("gu").alias("label")))
    best = best.select(F.col("u").alias("gu"), F.col("v").alias("gv"), "jaccard")
    return best.join(sized, ["gu", "gv"]).select("event_type", "u", "v", "n", F.round("jaccard", 6).alias("jaccard"))


def run(spark: SparkSession, events: str, output: str, checkpoint: str, *, first: int = 180, second: int = 210) -> DataFrame:
    """Takes the new files of events and writes the agreement of all events so far to output, a folder for each subject; returns it read back.

    output/cells holds the counts, output/agreement the result. A run without new files changes nothing in the counts and writes
    the same result. A file counts once; events that come again in another file are other events.
    """
    new = take_new(spark, events, f"{output}/cells", checkpoint, first, second)
    log.info("took %d new events from %s", new, events)
    counted = spark.read.schema(CELLS).parquet(f"{output}/cells") if there(spark, f"{output}/cells") else spark.createDataFrame([], CELLS)
    agreement(counted).coalesce(1).write.mode("overwrite").partitionBy("event_type").parquet(f"{output}/agreement")
    out = spark.read.schema(OUT).parquet(f"{output}/agreement").select("event_type", "u", "v", "n", "jaccard")
    log.info("wrote %d labels to %s/agreement", out.count(), output)
    return out


if __name__ == "__main__":
    main("label_agreement", run, ("events", "output", "checkpoint"))
