"""Late rows of a stream as an output of their own, instead of rows that a watermark drops unseen."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.session import shared_dir


def split_late(stream: DataFrame, ts: str, delay: str, home: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run a stream over everything available: (rows on time, late rows, counts per trigger).

    As with Spark's watermark, a trigger's mark is the greatest ``ts`` of all triggers before it, less ``delay`` (such as
    "10 minutes"); a row behind the mark is late, wherever it would go.  The first trigger has no mark.  Rows without a
    time are on time.  Both outputs have the columns of the stream and ``epoch``, the trigger; the counts are
    (epoch, mark, on_time, late).

    Everything lies in ``home``, a folder that all executors share; a run with the same ``home`` goes on there.  A trigger
    writes into folders named by its epoch, and its mark comes from the epochs before it only, so one that is repeated
    after a failure replaces what it had written.  What is kept between triggers is one row each.  The columns ``epoch`` and
    ``_late`` must not be in the stream.
    """
    taken = {"epoch", "_late"} & {c.lower() for c in stream.columns}
    if taken:
        raise ValueError(f"columns of these names are added: {sorted(taken)}")
    spark = stream.sparkSession
    home = home or f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    told = "epoch long, newest timestamp, mark timestamp, on_time long, late long"

    def counts() -> DataFrame:
        # the column in the rows, not the folder's name, so that a folder without any trigger can be read too
        return spark.read.schema(told).option("recursiveFileLookup", "true").parquet(f"{home}/told")

    def trigger(df: DataFrame, epoch: int) -> None:
        earlier = counts().where(F.col("epoch") < epoch) if epoch else None
        micros = earlier.agg(F.unix_micros(F.max("newest") - F.expr(f"INTERVAL {delay}")).alias("mark")).first()["mark"] if epoch else None
        mark = F.timestamp_micros(F.lit(micros).cast("long"))
        moment = F.col(ts).cast("timestamp")
        behind = F.coalesce(moment < mark, F.lit(False))
        marked = df.withColumn("_late", behind)
        marked.write.mode("overwrite").partitionBy("_late").parquet(f"{home}/rows/epoch={epoch}")
        written = spark.read.schema(marked.schema).parquet(f"{home}/rows/epoch={epoch}")
        written.agg(
            F.lit(epoch).cast("long").alias("epoch"), F.max(moment).alias("newest"), mark.alias("mark"),
            F.count_if(~F.col("_late")).alias("on_time"), F.count_if("_late").alias("late"),
        ).write.mode("overwrite").parquet(f"{home}/told/trigger={epoch}")

    schema = T.StructType(list(stream.schema.fields)).add("epoch", "long").add("_late", "boolean")
    # folders without rows, for a stream that has nothing to read yet
    spark.createDataFrame([], schema).write.mode("append").partitionBy("epoch", "_late").parquet(f"{home}/rows")
    spark.createDataFrame([], told).write.mode("ignore").parquet(f"{home}/told")
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{home}/checkpoint").foreachBatch(trigger).start()
    query.awaitTermination()
    rows = spark.read.schema(schema).option("basePath", f"{home}/rows").parquet(f"{home}/rows")
    return rows.where("not _late").drop("_late"), rows.where("_late").drop("_late"), counts().select("epoch", "mark", "on_time", "late")
