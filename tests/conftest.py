import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sievemill.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_limits(spark):
    """Size limits so low that every operator takes its split form."""
    low = {"sievemill.groupRows": "10", "sievemill.chunkRows": "7", "sievemill.percentileValues": "5", "sievemill.broadcastRows": "2"}
    for k, v in low.items():
        spark.conf.set(k, v)
    yield
    for k in low:
        spark.conf.unset(k)


@pytest.fixture
def events(spark):
    return spark.read.parquet(f"{DATA}/events.parquet")
