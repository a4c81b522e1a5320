"""Reading folders as streams and running a stream to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sievemill.session import shared_dir


def stream_table(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).format(fmt).load(folder)


def stream_lines(spark: SparkSession, folder: str, pattern: str = "*", files_per_trigger: int | None = None) -> DataFrame:
    """New lines of the files of a folder, as column ``value``.  The checkpoint remembers what was
    read; a rotated file is a new file."""
    reader = spark.readStream.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(folder)


def run_to_end(stream: DataFrame, mode: str = "append", partition_by: str | None = None, home: str | None = None) -> DataFrame:
    """Run a stream over everything available and read back what it wrote.

    Output and checkpoint lie in ``home``, a folder that all executors share (none given: a new one in the shared
    folder).  A later run with the same ``home`` goes on where the one before ended, with its state.
    ``complete`` keeps the last full result.
    """
    spark = stream.sparkSession
    home = home or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{home}/out"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{home}/checkpoint")
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
        if partition_by:
            writer = writer.partitionBy(partition_by)
        query = writer.start()
    else:
        # written per epoch, so that a repeated epoch replaces itself
        query = writer.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")).start()
    query.awaitTermination()
    written = spark.read.schema(stream.schema).parquet(out) if mode == "append" else spark.read.parquet(out)
    if mode == "append":
        return written
    last = written.selectExpr("max(epoch) as m").first()["m"]
    return written.where(f"epoch = {last}").drop("epoch")
