"""Every query for training data runs, and gives what its SQL gives where there is any."""

from __future__ import annotations

from pathlib import Path

import pytest

from quaymill.llm.queries import QUERIES, SQL
from tests.oracle import FOLDER, compare, connect

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    compare(spark, name, QUERIES[name], SQL.get(name), con)
