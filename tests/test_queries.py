"""Every core query runs and gives what its SQL gives."""

from __future__ import annotations

from importlib import import_module
from pathlib import Path

import pytest

from tests.oracle import FOLDER, compare, connect

CORE = ["data_quality", "relational", "expressions", "spatial", "modelling", "streams"]
SLOW = {"q_model_performance", "q_best_model"}
CASES = [(n, f, m.SQL.get(n)) for m in (import_module(f"quaymill.plans.{x}") for x in CORE) for n, f in m.QUERIES.items() if n not in SLOW]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name,make,sql", CASES, ids=[c[0] for c in CASES])
def test_query(spark, con, name, make, sql):
    compare(spark, name, make, sql, con)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_spatial_queries_leave_no_row_out(spark, con):
    from quaymill.plans import spatial

    n, parts = (con.sql(f"select count(*) from {t}").fetchall()[0][0] for t in ("embeddings", "part"))
    labels = con.sql("select count(distinct label) from embeddings").fetchall()[0][0]
    assert spatial.QUERIES["q_line_length"](spark, FOLDER).agg({"parts": "sum"}).first()[0] == n - labels
    assert all(spatial.QUERIES[q](spark, FOLDER).select("id").distinct().count() == n for q in ("q_nearest_line", "q_distance_count", "q_snapped", "q_catchments"))
    assert spatial.QUERIES["q_bounded_reach"](spark, FOLDER).select("source").distinct().count() == parts


def test_model_queries_do_the_surveyed_job(monkeypatch):
    from inspect import signature

    from quaymill.plans import modelling, spatial

    seen = {}

    def spy(name):
        real = signature(getattr(spatial.G if name == "morans_i" else modelling.L, name))

        def f(*args, **how):
            b = real.bind(*args, **how)
            b.apply_defaults()
            seen.setdefault(name, []).append(b.arguments)

        return f

    for name in ("model_table", "bootstrap_intervals", "best_model"):
        monkeypatch.setattr(modelling.L, name, spy(name))
    monkeypatch.setattr(spatial.G, "morans_i", spy("morans_i"))
    monkeypatch.setattr(modelling, "_train", lambda s, d: None)
    monkeypatch.setattr(modelling, "cut", lambda x, name: x)
    monkeypatch.setattr(spatial, "_points", lambda s, d: None)
    for q in (modelling.q_model_performance, modelling.q_best_model, modelling.q_bootstrap_intervals, spatial.q_morans_i):
        q(None, "")
    assert len(seen["model_table"]) == 2
    for c in seen["model_table"]:
        assert sorted(c["kinds"]) == ["boosting", "elastic_net", "linear", "random_forest"] and c["folds"] >= 5 and not c["how"]
    assert signature(modelling.L.regressor).parameters["trees"].default == 500
    assert seen["bootstrap_intervals"][0]["replicates"] == 1000 and seen["morans_i"][0]["permutations"] >= 300


def test_pivot_has_every_date(spark, con):
    from quaymill.plans import relational

    dates = [r[0] for r in con.sql("select distinct strftime(ts, '%Y-%m-%d %a') from events where ts is not null order by 1").fetchall()]
    assert relational.QUERIES["q_pivot_hour_date"](spark, FOLDER).columns == ["hour", *dates] and len(dates) > 3
