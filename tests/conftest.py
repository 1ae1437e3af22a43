import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from prismal.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "8g", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture()
def spread(spark):
    """Force the plans for large inputs: no one-task shortcut, no broadcast by estimate."""
    keys = {"spark.prismal.oneTaskBytes": "1", "spark.prismal.quantileBytes": "1", "spark.prismal.broadcastBytes": "0"}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield spark
    for key in keys:
        spark.conf.unset(key)
