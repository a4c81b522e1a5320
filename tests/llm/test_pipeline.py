"""The pipeline, stage by stage, and the registered queries."""

import sys

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sievemill.llm import chunks, quality, rules, simhash
from tests.conftest import DATA


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
        out.append(docs)
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "simhash near-dedup", "substring dedup", "best-fit packing"]


def test_columns_stay_until_the_last(steps):
    for df in steps[1:-1]:
        assert df.schema == steps[0].schema


def test_each_stage_does_what_its_operator_says(spark, steps, labels):
    docs, good, passed, single, cut, packed = steps
    scored = {r["doc_id"]: r["predicted"] for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert ids(good) == sorted(i for i, p in scored.items() if p == 1)
    judged = {r["doc_id"]: r["kept"] for r in rules.apply_rules(good, rules.train(docs, labels)).collect()}
    assert ids(passed) == sorted(i for i, k in judged.items() if k)
    assert ids(single) == sorted({r["component_id"] for r in simhash.near_duplicates(passed).collect()})
    texts = {r["doc_id"]: r["text"] for r in chunks.drop_repeats(single).collect()}
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == texts
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    assert {r["doc_id"] for r in packed.collect()} == set(texts)


def test_clean_documents_pass_the_quality_stages(steps, labels):
    clean = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(clean & set(ids(steps[1]))) >= 0.99 * len(clean)


def test_no_long_passage_stays_in_two_documents(steps):
    seen = {}
    for r in steps[4].collect():
        words = (r["text"] or "").split()
        for k in range(len(words) - 50):
            seen.setdefault(" ".join(words[k : k + 51]), set()).add(r["doc_id"])
    assert not [s for s, d in seen.items() if len(d) > 1]


def test_run_equals_the_stages(spark, steps):
    key = lambda r: (r["doc_id"], r["piece"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(key, steps[-1].collect()))


def test_stages_take_odd_documents(spark, odd_documents):
    docs, none = odd_documents, odd_documents.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd_documents, DATA)
        assert kept.columns == odd_documents.columns
        kept.count()
        docs = stage(spark, docs, DATA)
        assert stage(spark, none, DATA).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() >= 0


def test_queries_are_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names


def test_entry_imports_without_the_subpackage(monkeypatch):
    import importlib

    for gone in ("corpus_pipeline", "sievemill.llm"):
        with monkeypatch.context() as m:
            for name in [n for n in sys.modules if n.startswith(gone)]:
                m.delitem(sys.modules, name)

            class Gone:
                @staticmethod
                def find_spec(name, *_):
                    if name == gone or name.startswith(gone + "."):
                        raise ModuleNotFoundError(f"No module named {name!r}", name=name)

            m.setattr(sys, "meta_path", [Gone, *sys.meta_path])
            import sievemill

            m.delattr(sievemill, "llm", raising=False)
            fresh = importlib.reload(entry)
            assert "pipeline" not in fresh.queries() and "profile_customer" in fresh.queries()
    importlib.reload(entry)
    assert "pipeline" in entry.queries()
