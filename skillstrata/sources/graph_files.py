"""The graph as CSV folders, one for each node and edge table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from skillstrata.sources.files import read_csv, write_csv
from skillstrata.sources.lake import at_once


def export_graph(tables: Mapping[str, DataFrame], out_dir: str) -> dict[str, str]:
    """Writes ``{name: table}`` and returns ``{name: path}``.

    Gzipped, as graph databases load it: ids repeat, and plain text takes several times the space.
    """
    paths = {name: f"{out_dir.rstrip('/')}/{name}" for name in tables}
    at_once([partial(write_csv, table, paths[name], compression="gzip") for name, table in tables.items()])
    return paths


def read_graph(spark: SparkSession, paths: Mapping[str, str], like: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Reads exported tables back with the schemas of ``like``."""
    return {name: read_csv(spark, path, like[name].schema) for name, path in paths.items()}
