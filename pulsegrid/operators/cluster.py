"""One door to all clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .density import stdbscan
from .dstream import DStream
from .hdbscan import hdbscan
from .meanshift import meanshift

METHODS = ("stdbscan", "hdbscan", "meanshift", "dstream")


def cluster_events(df: DataFrame, method: str = "stdbscan", label: str = "cluster", **options) -> DataFrame:
    """df with `label`. Options are those of the method; hdbscan and meanshift also take time_scale (t is multiplied by it)
    in the place of threshold (t is divided by it)."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    if "time_scale" in options:
        options["threshold"] = 1 / options.pop("time_scale")
    if method == "stdbscan":
        return stdbscan(df, label=label, **options)
    if method == "hdbscan":
        return hdbscan(df, label=label, **options)
    if method == "meanshift":
        return meanshift(df, label=label, **options)
    return DStream(**options).cluster(df, label)
