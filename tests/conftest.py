from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from quaymill.session import get_session

    return get_session("local[4]", 4, **{"spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC"})


@pytest.fixture(scope="session")
def rows():
    """A DataFrame's rows as sorted tuples."""

    def of(df) -> list[tuple]:
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return of
