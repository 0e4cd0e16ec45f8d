"""All registered queries of the engine and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesselon.plans import logs, raster, requests, streams

QUERIES = {**raster.QUERIES, **requests.QUERIES, **logs.QUERIES, **streams.QUERIES}
ORACLE_SQL = {**raster.ORACLE_SQL, **requests.ORACLE_SQL, **logs.ORACLE_SQL, **streams.ORACLE_SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, features and nearest centroids of every image: one row per image with its label and score."""
    return QUERIES["r26_topk_labels"](spark, sf_dir)
