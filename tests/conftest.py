from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from silvergrain.session import local_session, tune  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", app="silvergrain-tests")
    tune(session)
    yield session
    session.stop()


@pytest.fixture
def many_slices(spark):
    """Keeps all shuffle partitions apart, so that small inputs still span several slices."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.fixture
def data_dir():
    return DATA
