"""Session set-up, size limits and lineage cutting.

Every operator that could meet an unbounded group first measures it and compares it with one of
the limits below.  Under the limit the plain Spark form runs; beyond it a second, equally exact
form runs that splits the group.  The limits are session settings, so tests can lower them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LIMITS = {
    # rows one window / grouped-map task may hold
    "sievemill.groupRows": 2_000_000,
    # bytes of the rows of such a task
    "sievemill.groupBytes": 256 << 20,
    # distinct values one exact percentile buffer may hold
    "sievemill.percentileValues": 200_000,
    # rows per range chunk when an ordered group is split
    "sievemill.chunkRows": 1_000_000,
    # bytes per such chunk
    "sievemill.chunkBytes": 128 << 20,
    # rows of a table that may be broadcast or turned into literals
    "sievemill.broadcastRows": 100_000,
    # rows of one bucket compared at once in the fuzzy match
    "sievemill.leaderBlock": 32,
    # bytes that one pass of the fuzzy match may shuffle, whatever the table's size
    "sievemill.passBytes": 128 << 20,
}


def limit(spark: SparkSession, name: str) -> int:
    """Current value of a size limit."""
    return int(spark.conf.get(name, str(LIMITS[name])))


def build_session(app: str = "sievemill", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Put the run-time settings results depend on onto a session built elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, as the cluster names it in ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="sievemill-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors do not matter."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """As ``cut``, with aggregates over ``df`` that are observed by the very job that writes it."""
    seen = Observation()
    out = cut(df.observe(seen, *[e.alias(name) for name, e in counts.items()]))
    return out, {name: int(n or 0) for name, n in seen.get.items()}


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Like a checkpoint this ends the lineage.  Unlike one it forgets how rows were dealt out, so a later join
    shuffles both its sides and adaptive execution may split their large partitions.  A table that is joined with
    its own aggregate takes the aggregate through here.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stored/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def configured(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for a while."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: shuffle files go when the job that made them has ended, not when the driver happens to collect its garbage
BRIEF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


class Scratch:
    """Tables in the shared folder that an operator writes for itself and gives back once they have served."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, f"{shared_dir(spark).rstrip('/')}/scratch/{uuid.uuid4().hex}"
        self._at: dict[int, tuple[DataFrame, str]] = {}

    def write(self, parts: Iterable[DataFrame]) -> DataFrame:
        """One table of all ``parts``, each written before the next is asked for."""
        path, schema = f"{self.top}/{uuid.uuid4().hex}", None
        for part in parts:
            part.write.mode("append").option("compression", "zstd").parquet(path)
            schema = part.schema
        table = self.spark.read.schema(schema).parquet(path)
        self._at[id(table)] = table, path
        return table

    def drop(self, table: DataFrame) -> None:
        self._delete(self._at.pop(id(table))[1])

    def close(self) -> None:
        self._at.clear()
        self._delete(self.top)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def cores(spark: SparkSession) -> int:
    """Partitions that keep every core busy: the cores there are, or the shuffle partitions if these are more."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Few but costly rows dealt out over all cores, by a hash of ``cols`` (else of nothing, in turn).

    A partition count that is asked for is kept by adaptive execution, which would otherwise merge
    small partitions without knowing how long their rows take.  Hashing once more makes it a
    partitioning of its own: one by the bare columns may be dropped in favour of a merged earlier one.
    """
    n = cores(df.sparkSession)
    return df.repartition(n, F.xxhash64(*cols)) if cols else df.repartition(n)
