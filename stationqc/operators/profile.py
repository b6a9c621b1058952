"""What is normal for a station: learned by grouped aggregation.

Percentiles are exact unless asked otherwise (``exact=False`` takes sketches of a fixed size).  Those over all rows are counts, pass by
pass (see ``selection``); those of a station are found where its rows meet (see ``spatial_tables``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..constants import FLOOR, VARS
from ..functions.physics import hour_interp, hour_of, quantile
from .features import VECTOR
from .selection import quantiles, stored_quantiles

#: Different values that the last pass of a percentile counts in a range at most.
MOST = 1_000_000


def by_hour(values: dict[str, str], found: DataFrame, empty: Column | None = None) -> DataFrame:
    """(station, hour, …) to one row a station with an array of 24 values for each of ``values`` (new name: column)."""
    maps = found.groupBy("station").agg(*[F.map_from_entries(F.collect_list(F.struct("hour", c))).alias(n) for n, c in values.items()])
    hours = F.sequence(F.lit(0), F.lit(23))
    pick = lambda n: F.transform(hours, lambda h: F.coalesce(F.element_at(n, h), empty) if empty is not None else F.element_at(n, h)).alias(n)
    return maps.select("station", *[pick(n) for n in values])


def climatology(checked: DataFrame) -> DataFrame:
    """(station, hour, T, P, RH): mean clean values by hour of the day."""
    return checked.groupBy("station", hour_of(F.col("minute")).alias("hour")).agg(*[F.avg(v).alias(v) for v in VARS])


def climate_profile(checked: DataFrame) -> DataFrame:
    return by_hour({f"clim_{v}": v for v in VARS}, climatology(checked))


def dsd_reference(featured: DataFrame, exact: bool = True, most: int = MOST) -> DataFrame:
    """One row: the median dsd of each variable over all rows.  ``most``: exact, with so many different values in a range of its last pass at most."""
    if exact:
        return quantiles(featured, [], {f"dsd_ref_{v}": (F.col(f"dsd_{v}"), 0.5) for v in VARS}, most)
    return featured.agg(*[quantile(f"dsd_{v}", 0.5, exact).alias(f"dsd_ref_{v}") for v in VARS])


def feature_scale(vector: DataFrame, exact: bool = True, most: int = MOST) -> DataFrame:
    """(feature, med, iqr) over complete rows; iqr is at least half the 90th percentile of the distance from the median.  ``most`` as in :func:`dsd_reference`.

    ``vector`` is read several times: give it stored.
    """
    full = vector.where("complete").select(*VECTOR)
    if exact:
        three = stored_quantiles(full, [], {f"{c}_{i}": (c, p) for c in VECTOR for i, p in enumerate((0.25, 0.5, 0.75))}, most)
        first = three.select(*[F.array(*[f"{c}_{i}" for i in range(3)]).alias(c) for c in VECTOR])
    else:
        first = full.agg(*[quantile(c, [0.25, 0.5, 0.75], exact).alias(c) for c in VECTOR])
    far = full.crossJoin(F.broadcast(first.select(*[F.get(c, F.lit(1)).alias(f"m_{c}") for c in VECTOR]))).select(*[F.abs(F.col(c) - F.col(f"m_{c}")).alias(f"a_{c}") for c in VECTOR])
    second = stored_quantiles(far, [], {c: (c, 0.9) for c in far.columns}, most) if exact else far.agg(*[quantile(c, 0.9, exact).alias(c) for c in far.columns])
    both = first.crossJoin(F.broadcast(second))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.get(c, F.lit(1)).alias("med"), F.greatest(F.get(c, F.lit(2)) - F.get(c, F.lit(0)), F.col(f"a_{c}") * 0.5 + 1e-3).alias("iqr")) for c in VECTOR]))
    return both.select(rows.alias("r")).select("r.*")


def robust_scale(vector: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    """The columns of VECTOR in units of their spread from their median, clipped to ±40.  ``scale``: feature to (med, iqr)."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(-40.0), F.least(F.lit(40.0), (F.col(c) - scale[c][0]) / scale[c][1])))
    return vector.withColumns({c: one(c) for c in VECTOR})


def read_scale(vector: DataFrame, exact: bool = True) -> dict[str, tuple[float, float]]:
    """:func:`feature_scale` on the driver: 17 rows."""
    return {r.feature: (r.med, r.iqr) for r in feature_scale(vector, exact).collect()}


def spatial_offsets(resid: DataFrame, least: int = 500, exact: bool = True) -> DataFrame:
    """(station, off_T, off_P, off_RH, n_T, …): median residual by hour, 0 for an empty hour or a station with under ``least`` residuals."""
    hours = resid.groupBy("station", hour_of(F.col("minute")).alias("hour")).agg(*[quantile(f"res_{v}", 0.5, exact).alias(f"r_{v}") for v in VARS], *[F.count(f"res_{v}").alias(f"c_{v}") for v in VARS])
    table = by_hour({f"off_{v}": f"r_{v}" for v in VARS}, hours, F.lit(0.0))
    out = table.join(hours.groupBy("station").agg(*[F.sum(f"c_{v}").alias(f"n_{v}") for v in VARS]), "station")
    zeros = F.array_repeat(F.lit(0.0), 24)
    return out.withColumns({f"off_{v}": F.when(F.col(f"n_{v}") >= least, F.col(f"off_{v}")).otherwise(zeros) for v in VARS})


def spatial_sigma(resid: DataFrame, offsets: DataFrame, least: int = 500, exact: bool = True) -> DataFrame:
    """(station, sig_T, …, sigI_T, …): robust spread of the residuals, never under the floor."""
    rows = resid.join(offsets, "station")
    r2 = rows.select("station", *[(F.col(f"res_{v}") - hour_interp(F.col(f"off_{v}"), F.col("minute"))).alias(f"r_{v}") for v in VARS], *[F.col(f"resI_{v}").alias(f"i_{v}") for v in VARS])
    mid = r2.groupBy("station").agg(*[quantile(f"{k}_{v}", 0.5, exact).alias(f"m{k}_{v}") for k in "ri" for v in VARS], *[F.count(f"r_{v}").alias(f"n_{v}") for v in VARS])
    far = r2.join(mid, "station").groupBy("station").agg(
        *[quantile(F.abs(F.col(f"r_{v}") - F.col(f"mr_{v}")), [0.5, 0.99], exact).alias(f"q_{v}") for v in VARS],
        *[quantile(F.abs(F.col(f"i_{v}") - F.col(f"mi_{v}")), 0.5, exact).alias(f"qi_{v}") for v in VARS],
        *[F.first(f"n_{v}").alias(f"n_{v}") for v in VARS],
    )
    sig = lambda v: F.when(F.col(f"n_{v}") >= least, F.greatest(F.lit(FLOOR[v]), 1.4826 * F.get(f"q_{v}", F.lit(0)), F.get(f"q_{v}", F.lit(1)) / 2.576)).otherwise(FLOOR[v])
    sig_i = lambda v: F.when(F.col(f"n_{v}") >= least, F.greatest(F.lit(FLOOR[v] * 0.5), 1.4826 * F.col(f"qi_{v}"))).otherwise(FLOOR[v] * 0.5)
    return far.select("station", *[sig(v).alias(f"sig_{v}") for v in VARS], *[sig_i(v).alias(f"sigI_{v}") for v in VARS])


def _at(x: np.ndarray, share: float) -> float:
    """As ``percentile``; NaN where there is nothing."""
    if not len(x):
        return np.nan
    at = share * (len(x) - 1)
    low, high = int(np.floor(at)), int(np.ceil(at))
    a, b = np.partition(x, [low, high])[[low, high]]
    return a if low == high else (high - at) * a + (at - low) * b


def _tables(minute: np.ndarray, column: Callable[[str], np.ndarray], least: int) -> dict:
    """A row of :func:`spatial_tables`.  ``minute`` of the day; ``column`` gives each column once."""
    hours, at, found = np.arange(1440) // 60, np.arange(1440) % 60 / 60.0, {}
    hour = (minute // 60).astype(np.uint8)
    order = np.argsort(hour, kind="stable").astype(np.int32)
    cuts = np.searchsorted(hour[order], np.arange(1, 24))
    seen = lambda x: x[~np.isnan(x)]
    for v in VARS:
        res = column(f"res_{v}")
        n = int((~np.isnan(res)).sum())
        off, sig, sig_i = np.zeros(24), FLOOR[v], FLOOR[v] * 0.5
        if n >= least:
            off = np.nan_to_num([_at(seen(x), 0.5) for x in np.split(res[order], cuts)])
            res = seen(res - (off[hours] + (off[(hours + 1) % 24] - off[hours]) * at)[minute])
            res = np.abs(res - _at(res, 0.5))
            sig = np.fmax(np.fmax(sig, 1.4826 * _at(res, 0.5)), _at(res, 0.99) / 2.576)
        res = seen(column(f"resI_{v}"))
        if n >= least:
            sig_i = np.fmax(sig_i, 1.4826 * _at(np.abs(res - _at(res, 0.5)), 0.5))
        found |= {f"off_{v}": off.tolist(), f"n_{v}": n, f"sig_{v}": float(sig), f"sigI_{v}": float(sig_i)}
    return found


def spatial_tables(resid: DataFrame, least: int = 500) -> DataFrame:
    """(station, off, n, sig, sigI per variable): :func:`spatial_offsets` and :func:`spatial_sigma` in one exchange of the residuals.

    Rows come by station, batch by batch; a task holds six residuals and the time of day of one station's rows, 50 bytes a row, where ``percentile``
    holds each as an entry of a map, for all the stations that it meets.
    """
    kept = [f"{k}_{v}" for k in ("res", "resI") for v in VARS]
    schema = StructType([StructField("station", resid.schema["station"].dataType)] + [StructField(f"{k}_{v}", kind) for v in VARS for k, kind in (("off", ArrayType(DoubleType())), ("n", LongType()), ("sig", DoubleType()), ("sigI", DoubleType()))])

    def run(batches):
        key, seen, held = None, None, {c: [] for c in ["minute", *kept]}

        def done():
            column = lambda c: np.concatenate([held[c].pop(0) for _ in range(len(held[c]))])
            row = _tables(column("minute"), column, least)
            return pa.RecordBatch.from_arrays([key, *[pa.array([row[f.name]], pa.list_(pa.float64()) if f.name.startswith("off") else None) for f in schema.fields[1:]]], names=schema.names)

        for batch in batches:
            if not len(batch):
                continue
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            codes = column("station").dictionary_encode(null_encoding="encode").indices.to_numpy()
            rows = {c: column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in kept}
            rows["minute"] = (column("minute").to_numpy(zero_copy_only=False) % 1440).astype(np.int16)
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:]):
                if (own := column("station")[a].as_py()) != seen and held["minute"]:
                    yield done()
                key, seen = column("station").slice(a, 1), own
                for c, x in rows.items():
                    held[c].append(x[a:b])
        if held["minute"]:
            yield done()

    return resid.select("station", "minute", *kept).repartition("station").sortWithinPartitions("station").mapInArrow(run, schema)


def spatial_profile(resid: DataFrame, least: int = 500, exact: bool = True) -> DataFrame:
    """(station, off, sig, sigI): all that :func:`..neighbours.spatial_z` needs."""
    if exact:
        return spatial_tables(resid, least).drop(*[f"n_{v}" for v in VARS])
    offsets = spatial_offsets(resid, least, exact)
    return offsets.drop(*[f"n_{v}" for v in VARS]).join(spatial_sigma(resid, offsets, least, exact), "station")
