"""What the operators of this subpackage share: column mapping over Arrow, stored tables, components."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.session import prepare, shared_dir

#: bytes of rows that a worker gets at once; a single longer row is a batch of its own
BATCH_BYTES = 4 << 20
#: edges up to which a round of ``components`` writes a file per core instead of one per shuffle partition
FEW_EDGES = 50_000
#: bytes of text that one step of a task handles at once; a single longer text is a step of its own
STEP_BYTES = 4 << 20


def worker_store() -> dict:
    """A dictionary of the running Python process, kept between tasks.

    Functions are shipped by value, so a module's own globals start anew with every task.
    """
    holder = sys.modules.setdefault("_sievemill_worker", types.ModuleType("_sievemill_worker"))
    return holder.__dict__.setdefault("kept", {})


def prepare_texts(spark: SparkSession) -> SparkSession:
    """As ``prepare``; a worker also gets ``BATCH_BYTES`` of rows at once instead of all the texts of a task in one batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(name, None)
    if given is None or not 0 < int(given.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return prepare(spark)


def hand_back() -> None:
    """Give freed memory back to the system; a worker lives on and would keep it for tasks to come."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library may have no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *own: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for tasks that leave nothing behind: what other operators keep in the worker goes before, what was freed after.

    ``own`` are the first parts of the keys in ``worker_store`` that stay, for ``run`` to find again.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_store()
        for key in [k for k in kept if (k[0] if isinstance(k, tuple) else k) not in own]:
            del kept[key]
        try:
            yield from run(batches)
        finally:
            hand_back()

    return tidied


def spare(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with as many underscores as it takes to clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of a string column as UTF-8, about ``limit`` bytes at a time, with the first one's index.

    A null counts as an empty text; callers that tell them apart look at the column itself.
    """
    held, size, first = [], 0, 0
    for i, v in enumerate(column.cast(pa.large_binary())):
        text = v.as_py() or b""
        if held and size + len(text) > limit:
            yield first, held
            held, size, first = [], 0, i
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def annotate(df: DataFrame, inputs: Sequence[str], fields: Sequence[T.StructField],
             make: Callable[[list[pa.Array]], Iterable[Sequence]]) -> DataFrame:
    """``df`` with further columns that ``make`` computes from the ``inputs`` of one Arrow batch.

    Rows, their order and their partitions stay.  A field whose name is taken gets a spare one.
    """
    names = []
    for f in fields:
        names.append(spare(df.select("*", *[F.lit(0).alias(n) for n in names]), f.name))
    schema = T.StructType(list(df.schema.fields) + [T.StructField(n, f.dataType, True) for n, f in zip(names, fields)])
    at = [df.columns.index(c) for c in inputs]
    kinds = [T_ARROW[type(f.dataType)] for f in fields]
    labels = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make([batch.column(i) for i in at])
            new = [m if isinstance(m, pa.Array) else pa.array(m, k) for m, k in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=labels)

    return df.mapInArrow(tidy(run), schema)


T_ARROW = {
    T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.StringType: pa.string(),
    T.BooleanType: pa.bool_(), T.BinaryType: pa.binary(),
}


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Like a checkpoint this ends the lineage.  Unlike one it forgets how rows were dealt out, so a later join
    shuffles both its sides and adaptive execution may split their large partitions.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(column, folds: int, fold: int):
    """True for rows whose crc32 of the id as text leaves ``fold`` modulo ``folds``; a null id is never held out."""
    return F.coalesce(F.crc32(F.encode(column.cast("string"), "UTF-8")) % F.lit(folds) == F.lit(fold), F.lit(False))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b longs): one row (id, root) per vertex that has an edge.

    ``root`` is the smallest id of the component.  Rounds of large and small stars: every vertex first ties its
    larger neighbours to the smallest one it knows, then its smaller ones, until nothing changes; a path halves each
    round.  The smallest neighbours are stored before they are joined back, so that a hub's rows can be split.
    Loops count as no edge.  Rounds over few edges run and write in no more tasks than there are cores: each file that
    an executor writes also costs it some short processes, and all those tasks are but their start.
    """
    wide = edges.sparkSession.sparkContext.defaultParallelism

    def held(df: DataFrame) -> DataFrame:
        return stored(df.coalesce(wide) if state[0] <= FEW_EDGES else df)

    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        both = now.union(now.select("b", "a"))
        low = held(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        # larger neighbours of a go to the smallest of a and its neighbours
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        now = held(large)
        low = held(now.groupBy("a").agg(F.min("b").alias("m")))
        # smaller neighbours of a, and a itself, go to the smallest neighbour
        small = now.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = held(small.union(low.select("a", F.col("m").alias("b"))).where("a > b").distinct())
    roots = now.select(F.col("b").alias("id")).distinct().withColumn("root", F.col("id"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(roots)
