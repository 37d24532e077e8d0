"""python -m quaymill list | run QUERY --data FOLDER [--out FOLDER] [--master URL] | explain QUERY --data FOLDER"""

from __future__ import annotations

import argparse
from importlib import import_module

from quaymill.session import get_session, steps

PLANS = ("data_quality", "relational", "expressions", "spatial", "modelling", "streams")


def queries() -> dict:
    out: dict = {}
    for name in PLANS:
        out |= import_module(f"quaymill.plans.{name}").QUERIES
    return out


def main() -> None:
    p = argparse.ArgumentParser(prog="quaymill", description=__doc__)
    p.add_argument("what", choices=["list", "run", "explain"])
    p.add_argument("query", nargs="?")
    p.add_argument("--data", help="folder of the tables")
    p.add_argument("--out", help="folder for the result as Parquet; else the first rows are shown")
    p.add_argument("--master", default="local[*]")
    a = p.parse_args()
    if a.what == "list":
        print("\n".join(sorted(queries())))
        return
    if a.query not in queries() or not a.data:
        p.error("name a query of 'list' and --data")
    spark = get_session(a.master)
    with steps(spark):
        df = queries()[a.query](spark, a.data)
        if a.what == "explain":
            df.explain("formatted")
        elif a.out:
            df.write.mode("overwrite").parquet(a.out)
        else:
            df.show(20, truncate=60)


if __name__ == "__main__":
    main()
