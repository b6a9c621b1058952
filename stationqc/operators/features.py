"""Features over a station's own history.  All look back only, so batch and stream share them.

One shuffle and one sort, station by minute, serve them all: a task reads its rows in that order, batch by batch, and
carries the last thirty on.  Rows must be dense (see ``sources.densify``): offsets count rows.  Long histories can be cut into parts (see ``cut_history``), so that one
station's rows meet in many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..constants import NOISE, STEP, STUCK, VARS
from ..functions.physics import dewpoint, hour_interp
from .qc import no_false

#: Rows that the furthest feature looks back.
BACK = 30


def by_minute() -> WindowSpec:
    """Station by minute: the one window of all sessions (made on use: it needs a session)."""
    return Window.partitionBy("station").orderBy("minute")


def by_part() -> WindowSpec:
    return Window.partitionBy("station", "part").orderBy("minute")


def cut_history(rows: DataFrame, length: int, back: int = BACK) -> DataFrame:
    """``rows`` plus part (minute by ``length``) and lead: a part's last ``back`` rows come again, with lead, before the next part.

    ``back / length`` more rows, for as many tasks a station as it has parts.
    """
    if length <= back:
        raise ValueError(f"a part needs more than {back} minutes")
    part, lead = F.floor(F.col("minute") / length), F.pmod("minute", F.lit(length)) >= length - back
    own, again = F.struct(part.alias("part"), F.lit(False).alias("lead")), F.struct((part + 1).alias("part"), F.lit(True).alias("lead"))
    return rows.select("*", F.inline(F.when(lead, F.array(own, again)).otherwise(F.array(own))))


def with_climate(checked: DataFrame, profile: DataFrame) -> DataFrame:
    """Adds cl_T, cl_P, cl_RH: the station's climatology at the time of day.  ``profile`` has clim_T, clim_P, clim_RH."""
    return checked.join(profile.select("station", *[f"clim_{v}" for v in VARS]), "station", "left").withColumns({f"cl_{v}": hour_interp(F.col(f"clim_{v}"), F.col("minute")) for v in VARS}).drop(*[f"clim_{v}" for v in VARS])


#: What a pass over a history adds, beside run_T, run_P and run_RH.
MOVES = [f"{k}_{v}" for v in VARS for k in ("d1", "d5", "innov", "dsd")] + ["td_innov", "td_d1"]


def _lag(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([np.full(min(k, len(x)), np.nan), x[:-k]])


def _median_before(x: np.ndarray) -> np.ndarray:
    """Median of the ``BACK`` rows before, if 15 at least are there."""
    ordered = np.sort(sliding_window_view(np.concatenate([np.full(BACK, np.nan), x[:-1]]), BACK), axis=1)  # NaN comes last
    n, at = (~np.isnan(ordered)).sum(axis=1), np.arange(len(x))
    return np.where(n >= 15, (ordered[at, np.maximum(n - 1, 0) // 2] + ordered[at, np.minimum(n // 2, BACK - 1)]) / 2.0, np.nan)


def _spread(x: np.ndarray) -> np.ndarray:
    """Deviation over 10 rows, if 6 at least are there."""
    seen = sliding_window_view(np.concatenate([np.full(9, np.nan), x]), 10)
    there = ~np.isnan(seen)
    n = there.sum(axis=1)
    mean = np.where(there, seen, 0.0).sum(axis=1) / np.maximum(n, 1)
    far = np.where(there, seen - mean[:, None], 0.0)
    return np.where(n >= 6, np.sqrt((far * far).sum(axis=1) / np.maximum(n - 1, 1)), np.nan)


def _moves(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """MOVES of consecutive rows of one station, and whether each variable changed."""
    out = {}
    for v in VARS:
        x, c = rows[v], rows[f"cl_{v}"]
        d1 = x - _lag(x, 1)
        out |= {f"d1_{v}": d1, f"d5_{v}": x - _lag(x, 5) - (c - _lag(c, 5)), f"innov_{v}": x - _median_before(x) - (c - _lag(c, 15)), f"dsd_{v}": _spread(d1) / NOISE[v], f"changed_{v}": ~(x == _lag(x, 1))}
    td = rows["td"]
    return out | {"td_innov": td - _median_before(td), "td_d1": td - _lag(td, 1)}


def _pass(keys: list[str]):
    """Batches of rows, ordered by ``keys`` and minute, with MOVES and the last change of each variable so far: ``BACK`` rows are carried on, no history is held."""
    needed = [*VARS, *[f"cl_{v}" for v in VARS], "td"]

    def run(batches):
        key, tail, broke = None, {}, {}
        for batch in batches:
            if not len(batch):
                continue
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            rows = {c: column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in needed}
            minute = column("minute").to_numpy(zero_copy_only=False).astype(np.float64)
            lead = column("lead").to_numpy(zero_copy_only=False) if "part" in keys else np.zeros(len(batch), bool)
            codes = [column(k).dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys]
            cuts = [0, *(np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1).tolist(), len(batch)]
            found: dict[str, list] = {c: [] for c in [*MOVES, *[f"run_{v}" for v in VARS]]}
            for a, b in zip(cuts, cuts[1:]):
                if (own := [column(k)[a].as_py() for k in keys]) != key:
                    key, tail, broke = own, {c: np.empty(0) for c in needed}, dict.fromkeys(VARS, np.nan)
                whole = {c: np.concatenate([tail[c], x[a:b]]) for c, x in rows.items()}
                old, moved = len(tail["td"]), _moves(whole)
                for v in VARS:
                    last = np.fmax.accumulate(np.concatenate([[broke[v]], np.where(moved[f"changed_{v}"][old:] & ~lead[a:b], minute[a:b], np.nan)]))[1:]
                    broke[v] = last[-1]
                    found[f"run_{v}"].append(last if "part" in keys else minute[a:b] - last)
                for c in MOVES:
                    found[c].append(moved[c][old:])
                tail = {c: x[-BACK:] for c, x in whole.items()}
            made = [pa.array(np.concatenate(found[c]), pa.float64(), from_pandas=True) for c in MOVES]
            made += [pa.array(np.concatenate(found[f"run_{v}"]), pa.float64(), from_pandas=True).cast(pa.int64()) for v in VARS]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *found])

    return run


def moves(climate: DataFrame, keys: list[str]) -> DataFrame:
    """Adds per variable d1, d5, innov, dsd (deviation of d1 over 10 rows, 6 at least, in units of noise) and run; td_innov, td_d1.

    ``climate`` has its rows in one partition a key, by ``keys`` and minute.  run is the count of rows equal to the one before, so
    far; with parts (keys station and part) it is the minute of the part's last change, leads not counted.
    """
    fields = [*climate.schema.fields, *[StructField(c, DoubleType()) for c in MOVES], *[StructField(f"run_{v}", LongType()) for v in VARS]]
    return climate.mapInArrow(_pass(keys), StructType(fields))


def _changes_before(cut: DataFrame) -> DataFrame:
    """station, part and before_T, before_P, before_RH: the last change in any earlier part.  One row a part, so its window is short."""
    same = cut.select("station", "part", "minute", "lead", *[no_false(F.col(v) == F.lag(v, 1).over(by_part())).alias(f"same_{v}") for v in VARS])
    last = same.where("NOT lead").groupBy("station", "part").agg(*[F.max(F.when(~F.col(f"same_{v}"), F.col("minute"))).alias(f"last_{v}") for v in VARS])
    earlier = Window.partitionBy("station").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return last.select("station", "part", *[F.max(f"last_{v}").over(earlier).alias(f"before_{v}") for v in VARS])


def flags(featured: DataFrame) -> DataFrame:
    """Adds step and stuck per variable and for any, ph and dsd_max."""
    out = featured.withColumns({f"step_{v}": no_false(F.abs(f"d1_{v}") > STEP[v]) for v in VARS} | {f"stuck_{v}": F.col(f"run_{v}") >= STUCK[v] for v in VARS})
    out = out.withColumn("stuck_RH", F.col("stuck_RH") & no_false(F.col("RH") < 98))
    any_of = lambda k: F.col(f"{k}_T") | F.col(f"{k}_P") | F.col(f"{k}_RH")
    spread = [F.col(f"dsd_{v}") for v in VARS]
    return out.withColumns(
        {
            "step_any": any_of("step"),
            "stuck_any": any_of("stuck"),
            "ph": F.coalesce(F.abs("td_innov"), F.lit(0.0)) / 6.0,
            "dsd_max": F.when(spread[0].isNotNull() & spread[1].isNotNull() & spread[2].isNotNull(), F.greatest(*spread)).otherwise(0.0),
        }
    )


def with_dewpoint(climate: DataFrame) -> DataFrame:
    return climate.withColumn("td", dewpoint(F.col("T"), F.col("RH")))


def features(checked: DataFrame, profile: DataFrame, part: int | None = None) -> DataFrame:
    """All features.  ``part`` cuts histories to so many minutes (more than ``BACK``), with the same result.

    Uncut, a station is one task, one shuffle does, and a task holds a batch of rows at a time.  Cut, the values are shuffled once more, alone, for the
    changes before each part: worth it where stations are fewer than cores or have many years.
    """
    climate = with_climate(checked, profile)
    keys = ["station"] if part is None else ["station", "part"]
    climate = climate if part is None else cut_history(climate, part)
    # nothing but this row's dew point may come between the order and the pass
    moved = moves(with_dewpoint(climate.repartition(*keys).sortWithinPartitions(*keys, "minute")), keys)
    if part is None:
        return flags(moved)
    met = moved.where("NOT lead").join(_changes_before(climate), keys, "left")
    return flags(met.withColumns({f"run_{v}": F.col("minute") - F.coalesce(f"run_{v}", f"before_{v}") for v in VARS}).drop("part", "lead", *[f"before_{v}" for v in VARS]))


VECTOR = [f"{k}_{v}" for v in VARS for k in ("d1", "d5", "innov", "dsd", "lrun")] + ["td_innov", "td_d1"]


def feature_vector(featured: DataFrame) -> DataFrame:
    """station, minute, the 17 columns of VECTOR, and complete: all of them are there."""
    out = featured.withColumns({f"lrun_{v}": F.log1p(F.col(f"run_{v}").cast("double")) for v in VARS})
    full = F.lit(True)
    for c in VECTOR:
        full = full & F.col(c).isNotNull()
    return out.select("station", "minute", *VECTOR, full.alias("complete"))


def recently(flag: Column, rows: int = 30, over: WindowSpec | None = None) -> Column:
    """True if ``flag`` was in the last ``rows`` rows, this one included.  ``over``: see ``by_part``; parts need ``rows - 1`` rows of lead."""
    return F.max(flag.cast("int")).over((over or by_minute()).rowsBetween(1 - rows, 0)) > 0


FUSION = ["f_if", "f_ae", "f_bad", "f_stuck", "f_step", "f_ph", "f_dsd"] + [f"f_{z}_{v}" for z in ("zl", "zi") for v in VARS] + ["f_has_nb", "f_nb_ts"]


def fusion_features(evidence: DataFrame, isolate: bool = False) -> DataFrame:
    """Adds the 15 columns of FUSION; those about neighbours are 0 without them, or with ``isolate``."""
    near = F.col("has_nb") & F.lit(not isolate)
    number = lambda b: b.cast("double")
    spatial = lambda c, top: F.when(near, F.least(F.coalesce(F.abs(c), F.lit(0.0)), F.lit(top))).otherwise(0.0)
    new = {
        "f_if": F.least("ts_if", F.lit(8.0)), "f_ae": F.least("ts_ae", F.lit(8.0)),
        "f_bad": number(F.col("comm") | F.col("rng_T") | F.col("rng_P") | F.col("rng_RH")),
        "f_stuck": number(F.col("stuck_any")), "f_step": number(F.col("step_any")),
        "f_ph": F.least("ph", F.lit(6.0)), "f_dsd": F.least("dsd_max", F.lit(30.0)),
    }
    new |= {f"f_{z.lower()}_{v}": spatial(f"{z}_{v}", 40.0) for z in ("zL", "zI") for v in VARS}
    return evidence.withColumns(new | {"f_has_nb": number(near), "f_nb_ts": spatial("nb_ts", 8.0)})
