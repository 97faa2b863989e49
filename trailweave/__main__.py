"""``python -m trailweave demo NAME QUESTION`` or ``python -m trailweave eval [worlds|extraction|maps]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from trailweave.plans import evaluate
from trailweave.plans.query import query
from trailweave.sources import documents as D


def main() -> None:
    p = argparse.ArgumentParser(prog="trailweave")
    sub = p.add_subparsers(dest="what", required=True)
    d = sub.add_parser("demo")
    d.add_argument("name", choices=sorted(D.DEMOS))
    d.add_argument("question")
    d.add_argument("--mode", default="graph")
    e = sub.add_parser("eval")
    e.add_argument("study", nargs="?", default="worlds", choices=("worlds", "extraction", "maps"))
    a = p.parse_args()
    spark = SparkSession.builder.appName("trailweave").getOrCreate()
    if a.what == "demo":
        objects, edges = D.demo(spark, a.name)
        out = query(spark.createDataFrame([(0, a.question)], "qid int, text string"), objects, edges, a.mode)
        for r in out.orderBy("rank").collect():
            print(r.explain)
    else:
        out = {"worlds": evaluate.run_worlds, "extraction": evaluate.run_extraction, "maps": evaluate.run_learned_maps}[a.study](spark)
        print(evaluate.markdown(out.orderBy(*out.columns[:2]), out.columns))


if __name__ == "__main__":
    main()
