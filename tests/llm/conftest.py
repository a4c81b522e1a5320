import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tests.conftest import DATA  # noqa: E402

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture
def odd_documents(spark):
    """Nulls, empty and blank texts, repeated rows and ids, a very long text, and extra columns whose names clash."""
    long = " ".join(f"word{i % 977} other{i % 31}," for i in range(30_000))
    rows = [
        (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \t\n ", None, None, None), (4, "a", "de", "s", 1), (4, "a", "de", "s", 1), (None, "no id here", "fr", "s", 5),
        (None, None, None, None, None), (5, long, "en", "s", 9), (6, long, "en", "s", 9), (7, "ünï çödé 漢字 \U0001f600 été", "fr", "s", 3), (8, "…" * 500, "en", "s", 500),
    ]
    made = [(*r, 0.25, "clash", -1, True, "x", 3, 4) for r in rows]
    return spark.createDataFrame(made, DOCUMENT + ", score double, fingerprint string, _key int, kept boolean, offset string, _owner int, _kept_id int")
