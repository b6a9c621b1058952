"""The derived panel: weather-like observations made of ``lineitem`` by one SQL text that Spark and DuckDB both read.

Values have four digits, as sensors round theirs; without that, Spark's decimals and DuckDB's doubles differ in the sixth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PANEL = """r AS (SELECT CAST(l_suppkey % 60 AS BIGINT) AS station, CAST(floor((l_suppkey % 60) / 7) AS BIGINT) AS city,
  CAST(row_number() OVER (PARTITION BY l_suppkey % 60 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS BIGINT) AS minute,
  l_quantity AS q, l_discount AS d, l_tax AS x FROM lineitem),
c AS (SELECT station, city, minute, (minute + station * 17) % 500 AS k,
  CASE WHEN (minute + city * 37) % 700 BETWEEN 600 AND 679 THEN 1 ELSE 0 END AS wx,
  28.0 + abs((minute % 1440) - 720) / 120.0 + (d - 0.05) AS t0, 1000.0 + abs((minute % 720) - 360) / 360.0 + (x - 0.04) AS p0,
  60.0 - abs((minute % 1440) - 720) / 60.0 + (q - 25.0) / 50.0 AS h0 FROM r),
w AS (SELECT station, city, minute, k, wx, t0 - 6.0 * wx AS t0, p0, h0 + 8.0 * wx AS h0 FROM c),
panel AS (SELECT station, city, minute, wx,
  round(CAST(CASE WHEN k BETWEEN 300 AND 309 THEN NULL WHEN k BETWEEN 350 AND 354 THEN -99.9 WHEN k BETWEEN 100 AND 129 THEN 30.0 WHEN k BETWEEN 200 AND 202 THEN t0 + 12.0 ELSE t0 END AS DOUBLE), 4) AS T_raw,
  round(CAST(CASE WHEN k BETWEEN 300 AND 309 THEN NULL WHEN k BETWEEN 350 AND 354 THEN 0.0 WHEN k BETWEEN 400 AND 459 THEN p0 + 9.0 ELSE p0 END AS DOUBLE), 4) AS P_raw,
  round(CAST(CASE WHEN k BETWEEN 300 AND 309 THEN NULL WHEN k BETWEEN 350 AND 354 THEN -99.9 WHEN k BETWEEN 470 AND 471 THEN 130.0 ELSE h0 END AS DOUBLE), 4) AS RH_raw,
  CASE WHEN k BETWEEN 100 AND 129 THEN 'stuck' WHEN k BETWEEN 200 AND 202 THEN 'spike' WHEN k BETWEEN 300 AND 309 OR k BETWEEN 350 AND 354 THEN 'comm_error'
    WHEN k BETWEEN 400 AND 459 THEN 'level_shift' WHEN k BETWEEN 470 AND 471 THEN 'spike' ELSE '' END AS anom FROM w)"""

STATIONS = """s0 AS (SELECT DISTINCT CAST(l_suppkey % 60 AS BIGINT) AS station, CAST(floor((l_suppkey % 60) / 7) AS BIGINT) AS city FROM lineitem),
stations AS (SELECT station, city, CAST(CASE WHEN station = 59 THEN 95.0 ELSE 72.0 + 2.5 * (city % 3) + 0.13 * (station % 7) END AS DOUBLE) AS lon,
  CAST(CASE WHEN station = 59 THEN 34.0 ELSE 12.0 + 3.0 * floor(city / 3) + 0.11 * ((station * 3) % 7) END AS DOUBLE) AS lat, CAST(10.0 + 40.0 * city AS DOUBLE) AS elev FROM s0)"""


#: The panel without its faults, as a history to learn from and to put labelled faults into.
CLEAN = PANEL[: PANEL.index("panel AS")] + "clean AS (SELECT station, city, minute, wx, round(CAST(t0 AS DOUBLE), 4) AS T_raw, round(CAST(p0 AS DOUBLE), 4) AS P_raw, round(CAST(h0 AS DOUBLE), 4) AS RH_raw FROM w)"


def _sql(spark: SparkSession, sf_dir: str, text: str, name: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(f"WITH {text.replace('FROM lineitem', 'FROM {lineitem}')} SELECT * FROM {name}", lineitem=lines)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, city, minute, wx, T_raw, P_raw, RH_raw, anom: 60 stations, dense minutes from 0."""
    return _sql(spark, sf_dir, PANEL, "panel")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, STATIONS, "stations")


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`panel`, without faults and labels."""
    return _sql(spark, sf_dir, CLEAN, "clean")


def highland(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Another network, of the same lines dealt out by part: colder, of thinner air and damper.  Its clean panel and its stations."""
    by_part = lambda text: text.replace("l_suppkey % 60", "l_partkey % 60")
    rows = _sql(spark, sf_dir, by_part(CLEAN), "clean")
    return rows.withColumns({"T_raw": rows.T_raw - 9.0, "P_raw": rows.P_raw - 140.0, "RH_raw": rows.RH_raw + 6.0}), _sql(spark, sf_dir, by_part(STATIONS), "stations")
