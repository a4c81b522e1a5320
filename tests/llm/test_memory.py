"""What a worker holds: the batches it gets, the arrays of a step, and what stays between tasks."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievemill.llm import common, features
from tests.conftest import DATA

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def batch_sizes(df):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([batch.nbytes], pa.int64())], names=["n", "size"])

    return df.mapInArrow(sizes, "n bigint, size bigint").collect()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_hand_workers_small_batches(spark, documents, name, stage):
    wide = spark.range(0, 400, 1, 1).select("id", F.repeat(F.lit("x"), 100_000).alias("text"))
    spark.conf.unset(ARROW_BYTES)
    stage(spark, documents, DATA)
    got = batch_sizes(wide)
    assert sum(r["n"] for r in got) == 400
    assert max(r["size"] for r in got) < 2 * common.BATCH_BYTES  # 40 MB in one batch before


def test_a_lower_limit_of_the_session_stays(spark):
    spark.conf.set(ARROW_BYTES, "100000")
    common.prepare_texts(spark)
    assert spark.conf.get(ARROW_BYTES) in ("100000", "100000b")
    spark.conf.unset(ARROW_BYTES)


def test_features_take_little_memory():
    texts = pa.array([" ".join(f"word{(i * j) % 7919}" for j in range(500)) for i in range(1, 800)])  # some 3 MB
    tracemalloc.start()
    try:
        for block in features.blocks(texts):
            assert block.shape[1] == features.DIMS
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()


def test_a_task_drops_what_other_operators_keep():
    kept = common.worker_store()
    before = dict(kept)
    kept.clear()
    kept.update({("words", "path"): 1, ("bpe", "path", "pattern"): 2, "letters": 3})

    def run(batches):
        yield from batches

    try:
        assert list(common.tidy(run, "words")([1, 2])) == [1, 2]
        assert kept == {("words", "path"): 1}
        assert list(common.tidy(run)([])) == [] and not kept
    finally:
        kept.clear()
        kept.update(before)


def test_rounds_over_few_edges_write_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda session: str(tmp_path))
    settings = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        path = [(i, i + 1) for i in range(300) if i % 100 != 99] + [(1000, i) for i in range(1001, 1400)]
        found = {r["id"]: r["root"] for r in common.components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
        assert found == {i: 1000 if i >= 1000 else i // 100 * 100 for i in [*range(300), *range(1000, 1400)]}
        files = sorted(len(list(p.glob("part-*"))) for p in (tmp_path / "llm").iterdir())
        assert len(files) > 8 and files[-2] <= spark.sparkContext.defaultParallelism  # all but the first table
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
