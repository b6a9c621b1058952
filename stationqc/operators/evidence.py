"""History and neighbours in one exchange of raw rows.

A row goes as it was read, cut into days, to its station's cell and to the few others where somebody listens.  What a
station's day needs beside its rows (climatology, last changes before, who listens, flagged minutes) goes once a day.
Features, anomalies and what neighbours say are worked out there: nothing derived is shuffled, and a station's days are
many tasks.  Rows must be dense (see ``sources.densify``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from ..constants import VARS
from .features import MOVES, _moves, cut_history
from .neighbours import SPATIAL, SUPPORT, _support, addressed
from .qc import no_false

DAY = 1440
#: Rows whose neighbours are worked out at once.
MET = 1 << 15
HISTORY = [*MOVES, *[f"run_{v}" for v in VARS]]


def day_ends(checked: DataFrame) -> DataFrame:
    """(station, part, first, last, end_T, end_P, end_RH): the minutes and the last values of each station's day."""
    return checked.groupBy("station", F.floor(F.col("minute") / DAY).alias("part")).agg(F.min("minute").alias("first"), F.max("minute").alias("last"), *[F.max_by(v, "minute").alias(f"end_{v}") for v in VARS])


def day_starts(checked: DataFrame, ends: DataFrame) -> DataFrame:
    """(station, part, before_T, before_P, before_RH): the last change of each variable before the day.  ``ends``: see :func:`day_ends` (stored: it is read again, and small).

    A day's last change is the minute after the last one that differs from its end, or its first if the day before ended otherwise.
    """
    same = lambda a, b: no_false(F.col(a) == F.col(b))
    rows = checked.select("station", F.floor(F.col("minute") / DAY).alias("part"), "minute", *VARS).join(ends, ["station", "part"])
    days = rows.groupBy(*ends.columns).agg(*[F.max(F.when(~same(v, f"end_{v}"), F.col("minute"))).alias(f"other_{v}") for v in VARS])
    ordered = Window.partitionBy("station").orderBy("part")
    days = days.withColumns({f"old_{v}": F.lag(f"end_{v}").over(ordered) for v in VARS})
    days = days.withColumns({f"last_{v}": F.when(F.col(f"end_{v}").isNull(), F.col("last")).when(F.col(f"other_{v}").isNotNull(), F.col(f"other_{v}") + 1).when(~same(f"old_{v}", f"end_{v}"), F.col("first")) for v in VARS})
    return days.select("station", "part", *[F.max(f"last_{v}").over(ordered.rowsBetween(Window.unboundedPreceding, -1)).alias(f"before_{v}") for v in VARS])


def _flagged(minutes: DataFrame, rows: int) -> DataFrame:
    """(station, part, flagged): the flagged minutes of a day, and those of the ``rows - 1`` minutes before it."""
    parts = [F.floor((F.col("minute") + k) / DAY) for k in (0, rows - 1)]
    dealt = minutes.select("station", "minute", F.explode(F.array_distinct(F.array(*parts))).alias("part"))
    return dealt.groupBy("station", "part").agg(F.collect_list("minute").alias("flagged"))


def _dewpoint(t: np.ndarray, rh: np.ndarray) -> np.ndarray:
    """As :func:`..functions.physics.dewpoint`."""
    g = np.log(np.maximum(np.maximum(rh, 0.5) / 100.0 * (6.112 * np.exp(17.67 * t / (t + 243.5))), 1e-6) / 6.112)
    return 243.5 * g / (17.67 - g)


def _met(kept: list[str], out: list[str], ts: Callable, back: int):
    """A cell's day: its stations' days (``heads``) and their rows, to the rows of its own stations with ``out``."""

    def run(heads: pa.Table, rows: pa.Table) -> pa.Table:
        column = lambda t, c, kind=pa.float64(): t.column(c).cast(kind).to_numpy()
        known = heads.column("station").combine_chunks()
        at = pc.fill_null(pc.index_in(rows.column("station"), value_set=known), -1).to_numpy()
        minute = column(rows, "minute", pa.int64())
        order = np.lexsort((minute, at))
        order = order[at[order] >= 0]
        rows, at, minute = rows.take(pa.array(order)), at[order], minute[order]
        valid, hour = column(rows, "valid", pa.int64()), minute % DAY // 60
        x = {}
        for i, v in enumerate(VARS):
            x[v] = np.where(valid >> i & 1, column(rows, f"{v}_raw"), np.nan)
            table = np.array([[np.nan] * 24 if c is None else c for c in heads.column(f"clim_{v}").to_pylist()], float).reshape(-1, 24)
            a, b = table[at, hour], table[at, (hour + 1) % 24]
            x[f"cl_{v}"] = a + (b - a) * (minute % 60 / 60.0)
        x["td"] = _dewpoint(x["T"], x["RH"])
        part = heads.column("part")[0].as_py() if len(heads) else 0
        lead = minute < part * DAY
        before = {v: column(heads, f"before_{v}") for v in VARS}
        found = {c: np.empty(len(at)) for c in HISTORY}
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)] if len(at) else []
        for a, b in zip(cuts, cuts[1:]):
            moved = _moves({c: y[a:b] for c, y in x.items()})
            for c in MOVES:
                found[c][a:b] = moved[c]
            for v in VARS:
                changed = np.where(moved[f"changed_{v}"] & ~lead[a:b], minute[a:b], np.nan)
                found[f"run_{v}"][a:b] = minute[a:b] - np.fmax.accumulate(np.concatenate([[before[v][at[a]]], changed]))[1:]
        day = np.flatnonzero(~lead)
        day = day[np.lexsort((at[day], minute[day]))]
        at, minute = at[day], minute[day]
        found = {c: y[day] for c, y in found.items()}
        log = lambda y: np.log(np.maximum(y[day], 0.5))
        said = {"A_T": (x["T"] - x["cl_T"])[day], "A_P": (x["P"] - x["cl_P"])[day], "A_RH": 100.0 * (log(x["RH"]) - log(x["cl_RH"]))} | {f"innov_{v}": found[f"innov_{v}"] for v in VARS}
        said["ts"] = ts(found)
        excluded = np.zeros(len(at), bool)
        if "flagged" in heads.column_names:
            for i, minutes in enumerate(heads.column("flagged").to_pylist()):
                if minutes:
                    own, flagged = np.flatnonzero(at == i), np.sort(minutes)
                    excluded[own] = np.searchsorted(flagged, minute[own], "right") > np.searchsorted(flagged, minute[own] - back, "right")
        facts = {f"__{c}": column(heads, c, pa.int64())[at] for c in ("told", "bit", "listed")}
        facts["__told"] = np.where(excluded, 0, facts["__told"])
        made = {c: np.empty(len(at)) for c in SUPPORT}
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(minute)) + 1, [len(at)]]) if len(at) else np.zeros(1, int)
        step = np.searchsorted(cuts, np.arange(0, len(at), MET))  # whole minutes
        for first, last in zip(step, [*step[1:], len(cuts) - 1]):
            a, b = cuts[first], cuts[last]
            if a < b:
                for c, y in _support(cuts[first : last + 1] - a, {k: y[a:b] for k, y in (facts | said).items()}).items():
                    made[c][a:b] = y
        own = heads.column("own").to_numpy(zero_copy_only=False).astype(bool)[at] if len(at) else np.zeros(0, bool)
        back_in_order = np.flatnonzero(own)
        back_in_order = back_in_order[np.lexsort((minute[back_in_order], at[back_in_order]))]
        all_ = found | made | said | {"excluded": excluded}
        whole = lambda c: c.startswith("run_") or c == "nn"
        arrays = [pa.array(all_[c][back_in_order], from_pandas=True) if not whole(c) else pa.array(all_[c][back_in_order], pa.float64(), from_pandas=True).cast(pa.int64()) for c in out]
        return pa.table([*rows.select(kept).take(pa.array(day[back_in_order])).columns, *arrays], names=[*kept, *out])

    return run


def near_rows(checked: DataFrame, profile: DataFrame, edges: DataFrame, starts: DataFrame, kept: list[str], out: list[str], ts: Callable, flagged: DataFrame | None = None, back: int = 30) -> DataFrame:
    """``kept`` of the rows of ``checked`` plus ``out``, of HISTORY, SUPPORT and excluded.

    ``profile``: clim_T, clim_P, clim_RH a station; ``starts``: see :func:`day_starts`; ``ts`` makes the unusualness out of numpy
    columns of HISTORY.  A station doesn't speak while one of its last ``back`` rows is among ``flagged`` (station, minute).
    """
    valid = sum((F.when(F.col(v).isNotNull(), 1 << i).otherwise(0) for i, v in enumerate(VARS)), F.lit(0)).alias("valid")
    raw = ["station", "minute", *[f"{v}_raw" for v in VARS]]
    rest = [c for c in kept if c not in raw]
    sent = addressed(cut_history(checked.select(*raw, *rest, valid), DAY), edges)
    own = F.col("__to.own") & ~F.col("lead")
    rows = sent.select(F.col("__to.cell").alias("cell"), "part", *raw, "valid", *[F.when(own, F.col(c)).alias(c) for c in rest])
    days = starts.join(profile.select("station", *[f"clim_{v}" for v in VARS]), "station", "left")
    days = days if flagged is None else days.join(_flagged(flagged, back), ["station", "part"], "left")
    heads = addressed(days, edges).select("__to.*", *[F.col(c).alias(c) for c in days.columns])  # columns of their own, should both sides come of one table
    types = {f.name: f.dataType for f in checked.schema}
    kind = lambda c: BooleanType() if c == "excluded" else LongType() if c == "nn" or c.startswith("run_") else DoubleType()
    schema = StructType([StructField(c, types[c]) for c in kept] + [StructField(c, kind(c)) for c in out])
    return heads.groupBy("cell", "part").cogroup(rows.groupBy("cell", "part")).applyInArrow(_met(kept, out, ts, back), schema)
