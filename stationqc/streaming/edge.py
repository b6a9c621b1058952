"""The adaptive check that a device runs on itself: it learns from clean readings only, so it is a fold over each station's rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import NOISE, RANGE, STEP, STUCK, VARS
from ..sources.packets import FLAGS

ALPHA, WARM, Z_LIMIT, DEW_LIMIT, LONGEST = 0.03, 30, 8.0, 6.0, 255
#: Readings learned from, the mean dew point, and a row each of means, variances, last values and runs of T, P, RH.
FRESH = (0.0, 0.0, *([0.0] * 12))
_LOW, _HIGH = (tuple(float(RANGE[v][k]) for v in VARS) for k in (0, 1))
_STEP, _STUCK, _NOISE = (tuple(float(of[v]) for v in VARS) for of in (STEP, STUCK, NOISE))


def _dew(t: float, rh: float) -> float:
    g = math.log(max(max(rh, 0.5) / 100.0 * 6.112 * math.exp(17.67 * t / (t + 243.5)), 1e-6) / 6.112)
    return 243.5 * g / (17.67 - g)


def step(state: tuple, reading: tuple) -> tuple[tuple, int]:
    """The state after ``reading`` (T, P, RH; None for none), and its flags.

    A check looks at the sensors that are there.  Means and variances are exponential, of rows without any flag; a missing
    sensor keeps the last values of all three.  Plain floats: arrays of three cost many times their arithmetic.
    """
    seen, dew = state[:2]
    mean, var, last, run = list(state[2:5]), list(state[5:8]), list(state[8:11]), list(state[11:14])
    names = set()
    for k, x in enumerate(reading):
        if x is None or not math.isfinite(x) or x <= -90:
            names.add("missing")
            continue
        run[k] = min(LONGEST, run[k] + 1) if seen > 0 and x == last[k] and not (k == 2 and x >= 98) else 0.0
        if x < _LOW[k] or x > _HIGH[k]:
            names.add("range")
        if seen > 0 and abs(x - last[k]) > _STEP[k]:
            names.add("step")
        if run[k] + 1 >= _STUCK[k]:
            names.add("stuck")
        if seen >= WARM and abs(x - mean[k]) / math.sqrt(var[k] + _NOISE[k] * _NOISE[k]) > Z_LIMIT:
            names.add("z_score")
    if not names & {"missing", "range"}:
        now = _dew(reading[0], reading[2])
        if seen >= WARM and abs(now - dew) > DEW_LIMIT:
            names.add("dew_point")
        if not names:
            mean, var, dew = (mean, var, dew) if seen else (list(reading), [0.0] * 3, now)
            off = [x - m for x, m in zip(reading, mean)]
            mean, var, dew = [m + ALPHA * d for m, d in zip(mean, off)], [(1 - ALPHA) * (v + ALPHA * (d * d)) for v, d in zip(var, off)], dew + ALPHA * (now - dew)
            seen = min(65535.0, seen + 1)
    if "missing" not in names:
        last = list(reading)
    return (seen, dew, *mean, *var, *last, *run), sum(FLAGS[k] for k in names)


def _fold(state: tuple, rows: pd.DataFrame) -> tuple[tuple, list[int]]:
    out = []
    for reading in zip(*[rows[c].astype(float).tolist() for c in ("T_raw", "P_raw", "RH_raw")]):  # a null is NaN, which no sensor sends
        state, flags = step(state, reading)
        out.append(flags)
    return state, out


def edge_qc(obs: DataFrame) -> DataFrame:
    """station, minute and flags of a batch: a fold over each station's rows in order.  A station's history is bounded by what one device sends."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("minute")
        return pd.DataFrame({"station": rows["station"], "minute": rows["minute"], "flags": _fold(FRESH, rows)[1]})

    kind = obs.schema["station"].dataType.simpleString()
    return obs.select("station", "minute", "T_raw", "P_raw", "RH_raw").groupBy("station").applyInPandas(run, f"station {kind}, minute long, flags int")


def edge_qc_stream(obs: DataFrame) -> DataFrame:
    """The same on a stream: the state of a station outlives the batch.  Rows must come in order, batch by batch."""
    kind = obs.schema["station"].dataType.simpleString()
    names = [f"s{i}" for i in range(len(FRESH))]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True).sort_values("minute")
        new, flags = _fold(tuple(state.get) if state.exists else FRESH, rows)
        state.update(tuple(float(x) for x in new))
        yield pd.DataFrame({"station": rows["station"], "minute": rows["minute"], "flags": flags})

    return obs.select("station", "minute", "T_raw", "P_raw", "RH_raw").groupBy("station").applyInPandasWithState(
        run, f"station {kind}, minute long, flags int", ", ".join(f"{n} double" for n in names), "append", GroupStateTimeout.NoTimeout
    )
