from __future__ import annotations

import os

import pytest

import oracle
from fareloom.session import local_session
from fareloom.staging import scratch

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(cpus=8, memory="6g", app="tests")
    session.sparkContext.setLogLevel("ERROR")
    with scratch(session):
        yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.fixture
def many_slices(spark):
    """Keep every range partition, so small inputs still cross slice borders."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")
