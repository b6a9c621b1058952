import random

import pytest
from pyspark.sql import functions as F

from stationqc.operators import selection
from stationqc.operators.selection import quantiles


def table(spark):
    rng, rows = random.Random(4), []
    make = {
        "uniform": lambda i: rng.random(),
        "ties": lambda i: 7.0 if i else 1.0,  # one value but for one row
        "two": lambda i: float(i % 2),
        "heavy": lambda i: rng.choice((-1, 1)) * 10.0 ** rng.uniform(-300, 300),
        "gaps": lambda i: None if i % 3 else rng.choice((float("nan"), 2.5, -3.0, 1e9)),
        "none": lambda i: None,
        "one": lambda i: 5.0 if i == 9 else None,
    }
    for g, value in make.items():
        rows += [(g, value(i)) for i in range(3000)]
    return spark.createDataFrame(rows, "g string, x double").repartition(5)


@pytest.mark.parametrize("most", [1, 40, 10**6])
def test_quantiles_equal_percentile(spark, most):
    rows = table(spark).persist()
    shares = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p901": 0.901, "p100": 1.0}
    got = {r.g: r for r in quantiles(rows, ["g"], {n: (F.col("x"), p) for n, p in shares.items()}, most).collect()}
    clean = F.when(~F.isnan("x"), F.col("x"))
    want = {r.g: r for r in rows.groupBy("g").agg(*[F.percentile(clean, F.lit(p)).alias(n) for n, p in shares.items()]).collect()}
    assert set(got) == set(want)
    for g in want:
        for n in shares:
            assert got[g][n] == (None if want[g][n] is None else pytest.approx(want[g][n], rel=1e-12)), (g, n)


def test_without_groups_and_without_rows(spark):
    rows = table(spark).where("g = 'uniform'")
    got = quantiles(rows, [], {"a": (F.col("x"), 0.5), "b": (F.col("x") * 2, 0.1)}, 100).first()
    want = rows.agg(F.percentile("x", F.lit(0.5)), F.percentile(F.col("x") * 2, F.lit(0.1))).first()
    assert list(got) == pytest.approx(list(want))
    assert list(quantiles(rows.where("false"), [], {"a": (F.col("x"), 0.5)}).first()) == [None]
    assert quantiles(rows.where("false"), ["g"], {"a": (F.col("x"), 0.5)}).count() == 0


def test_passes_read_stored_values_and_rows_are_made_once(spark, monkeypatch):
    kept, keep = [], selection._kept
    monkeypatch.setattr(selection, "_kept", lambda s, df: kept.append(df.columns) or keep(s, df))
    x = F.col("id").cast("double")
    got = selection.quantiles(spark.range(1000), [], {"low": (x, 0.25), "high": (x, 0.75)}, 100).first()
    assert (got.low, got.high) == (249.75, 749.25)
    assert len(kept[0]) == 1 and kept[0][0].startswith("value_")
