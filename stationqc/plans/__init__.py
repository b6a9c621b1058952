"""Registered queries over the derived panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incidents, qc
from . import more_queries as _more
from . import queries as _registered
from .layers import layers


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents of the model-free checks, and their minutes, by station."""
    runs = incidents.detect_runs(layers(spark, sf_dir).features, qc.threshold_mask(), need=1, win=1)
    return runs.groupBy("station").agg(F.count("*").alias("incidents"), F.sum(F.col("end") - F.col("onset")).alias("minutes")).orderBy("station")


def queries():
    assert _more
    return dict(_registered.QUERIES)


def oracle_sql():
    return dict(_registered.SQL)
