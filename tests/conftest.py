from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from wardline.plans import quantiles, skew  # noqa: E402
from wardline.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    settings = {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    }
    session = build_session("tests", "local[4]", **settings)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def folder():
    return SMALL


@pytest.fixture()
def crowded(spark):
    """Settings under which ordinary groups count as heavy, no table is broadcast as a lookup, percentiles need brackets."""
    spark.conf.set(quantiles.BRACKET_ROWS, "20")
    spark.conf.set(skew.MIN_ROWS, "20")
    spark.conf.set(skew.BROADCAST_ROWS, "0")
    yield
    spark.conf.unset(quantiles.BRACKET_ROWS)
    spark.conf.unset(skew.MIN_ROWS)
    spark.conf.unset(skew.BROADCAST_ROWS)
