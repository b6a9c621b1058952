"""Exact percentiles of columns whose values don't fit a task: counts of ranges bracket each rank, and only the values of its range are told apart."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import delete, scratch_path

#: Ranges of the first pass: so many to a factor of e, of either sign.
FINE = 256
#: Pieces that a range is cut into where it holds too many values.
PIECES = 1 << 16


def _kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df``, stored, so that the next pass doesn't start from the first."""
    path = scratch_path(spark, "selection")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(kept: DataFrame) -> None:
    """Deletes what :func:`_kept` stored."""
    delete(kept.sparkSession, unquote(kept.inputFiles()[0].rsplit("/", 1)[0]))


def _range(x: Column) -> Column:
    """The range of a value: it never falls where the value grows (``ln`` doesn't either), and zero has one of its own."""
    place = lambda y: 1 + F.floor((F.least(F.ln(y), F.lit(1000.0)) + 800.0) * FINE)
    return F.when(x > 0, place(x)).when(x < 0, -place(-x)).otherwise(F.lit(0).cast("long"))


def quantiles(rows: DataFrame, by: list[str], points: dict[str, tuple[Column, float]], most: int = 1_000_000) -> DataFrame:
    """(``by``, the names of ``points``): percentiles by linear interpolation, as ``percentile`` gives them; null where a group has no value.

    ``points``: name to (column, share).  Nulls and NaN don't count; ``by`` must not be null.  The first pass counts ranges, each 0.4 % of
    its values wide; the last one counts the different values of the ranges where the ranks lie.  While such a range holds over ``most`` values that
    differ, a pass in between cuts it into ``PIECES`` between its least and its greatest.  All are counts by key, which combine
    before the shuffle: no task sorts values, and equal ones are one row.
    """
    # every pass reads the values again: each is stored once (given as one object, also for several shares), and ``rows`` are made once
    columns = {id(c): (c, f"value_{i}") for i, (c, _) in enumerate(points.values())}
    kept = _kept(rows.sparkSession, rows.select(*by, *[c.cast("double").alias(n) for c, n in columns.values()]))
    found = stored_quantiles(kept, by, {n: (columns[id(c)][1], p) for n, (c, p) in points.items()}, most)
    if by:  # groups without a value too
        found = _kept(rows.sparkSession, kept.select(*by).distinct().join(found, by, "left"))
    _drop(kept)
    return found


def stored_quantiles(rows: DataFrame, by: list[str], points: dict[str, tuple[str, float]], most: int = 1_000_000) -> DataFrame:
    """As :func:`quantiles`, of columns of ``rows`` that are stored, or made quickly of stored ones; groups without a value are left out."""
    spark = rows.sparkSession
    columns = list(dict.fromkeys(c for c, _ in points.values()))
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("of"), (F.col(c) + 0.0).alias("x")) for i, c in enumerate(columns)]))
    values = rows.select(*by, one.alias("v")).select(*by, "v.*").where("x IS NOT NULL AND NOT isnan(x)").withColumn("range", _range(F.col("x")))
    target, cell = [*by, "of"], [*by, "of", "range", "lo", "hi"]

    def ranks(counted: DataFrame, within: list[str], order: str) -> DataFrame:
        """``counted`` with below: the values of the same ``within`` that come before."""
        return counted.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))

    counted = values.groupBy(*target, "range").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    counted = first = _kept(spark, counted)
    at = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(columns.index(c)).alias("for"), F.lit(float(p)).alias("share")) for n, (c, p) in points.items()]))
    wanted = counted.groupBy(*target).agg(F.sum("n").alias("all")).select(*target, "all", at.alias("w")).where("of = w.for")
    wanted = wanted.select(*target, F.col("w.name").alias("name"), (F.col("w.share") * (F.col("all") - 1)).alias("at"))
    wanted = wanted.withColumn("k", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    own = (F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("n"))
    state = wanted.join(ranks(counted, target, "range"), target).where(own).select(*cell, "name", "at", "k", F.col("before").alias("below"), F.col("n").alias("inside"))
    state = _kept(spark, state)
    _drop(first)
    while True:
        open_ = state.where("lo < hi")
        sizes = open_.agg(F.max("inside")).first()[0]
        if sizes is None:
            break
        x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
        met = values.join(open_.select(*cell).distinct(), [*target, "range"]).where((x >= lo) & (x <= hi))
        piece = F.floor((x - lo) / (hi - lo) * PIECES).cast("double") if sizes > most else x
        counted = met.groupBy(*cell, piece.alias("piece")).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("greatest"))
        near = open_.join(ranks(counted, cell, "piece"), cell).withColumn("before", F.col("below") + F.col("before")).where(own)
        near = near.select(*target, "range", F.col("least").alias("lo"), F.col("greatest").alias("hi"), "name", "at", "k", F.col("before").alias("below"), F.col("n").alias("inside"))
        old, state = state, _kept(spark, state.where("lo = hi").unionByName(near))
        _drop(old)
    weight = F.when(F.col("at") == F.col("k"), 1.0).otherwise(1.0 - F.abs(F.col("at") - F.col("k")))
    whole = state.groupBy(*by, "name").agg(F.sum(weight * F.col("lo")).alias("value"))
    spread = [F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in points]
    found = _kept(spark, whole.groupBy(*by).agg(*spread) if by else whole.agg(*spread))
    _drop(state)
    return found
