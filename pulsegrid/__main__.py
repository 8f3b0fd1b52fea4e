"""python -m pulsegrid convert|cluster|velocities|evaluate: the operators on files."""

from __future__ import annotations

import argparse
import json


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="pulsegrid")
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("convert", "cluster", "velocities"):
        s = sub.add_parser(name)
        s.add_argument("source")
        s.add_argument("target")
        s.add_argument("-m", "--method", default={"cluster": "stdbscan", "velocities": "all"}.get(name))
        s.add_argument("--options", type=json.loads, default={}, help="JSON of the method's options")
        s.add_argument("--dt", type=int, default=1000)
    e = sub.add_parser("evaluate")
    e.add_argument("source")
    e.add_argument("target")
    e.add_argument("-m", "--method", default="all")
    a = p.parse_args(argv)

    from pyspark.sql import SparkSession

    from .functions.expr import cluster_column, polarity_column
    from .operators.cluster import cluster_events
    from .operators.evaluate import evaluate_clusters
    from .operators.velocity import METHODS, estimate_velocities
    from .sources.files import convert, read_events, write_events

    spark = SparkSession.builder.getOrCreate()
    if a.what == "convert":
        convert(spark, a.source, a.target, **a.options)
        return
    df = read_events(spark, a.source)
    if a.what == "cluster":
        write_events(cluster_events(df, a.method, **a.options), a.target)
    elif a.what == "velocities":
        c = cluster_column(df)
        write_events(estimate_velocities(df, a.dt, c, polarity_column(df), METHODS if a.method == "all" else (a.method,)), a.target)
    else:
        other = read_events(spark, a.target)
        print(json.dumps(evaluate_clusters(df, other, cluster_column(df), cluster_column(other), a.method)))


if __name__ == "__main__":
    main()
