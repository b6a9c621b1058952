"""Labelled faults put into clean observations: one interval join with a plan table, then a rule a kind.

``plan``: station, kind, var ('T', 'P', 'RH' or 'all'), start, end, sign, mag, form.  A minute is in one fault at most.
Random kinds draw from a hash of station, minute and ``seed``, so a lost partition is drawn again alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import VARS, WARMUP

#: Sizes of the jumps of a power glitch.
GLITCH = {"T": (6.0, 20.0), "P": (6.0, 22.0), "RH": (22.0, 45.0)}
# Kinds of random faults with their shares and durations (shortest, longest and one), shares of the variables,
# and sizes (from, to) of gross and of subtle faults.
SHARES = {"spike": 0.14, "level_shift": 0.18, "stuck": 0.16, "drift": 0.14, "noise_burst": 0.12, "comm_error": 0.14, "power_glitch": 0.12}
LENGTHS = {"spike": (1, 5), "level_shift": (60, 300), "stuck": (30, 240), "drift": (180, 600), "noise_burst": (20, 90), "comm_error": (5, 60), "power_glitch": (10, 40)}
VAR_SHARES = {"T": 0.45, "P": 0.30, "RH": 0.25}
GROSS = {"jump": GLITCH, "drift": {"T": (3.0, 8.0), "P": (3.0, 8.0), "RH": (10.0, 25.0)}, "noise": {"T": (1.5, 4.0), "P": (1.5, 3.0), "RH": (6.0, 14.0)}}
SUBTLE = {"jump": {"T": (1.5, 4.0), "P": (1.5, 4.0), "RH": (7.0, 15.0)}, "drift": {"T": (1.5, 3.5), "P": (1.5, 3.5), "RH": (6.0, 12.0)}, "noise": {"T": (0.6, 1.2), "P": (0.5, 1.0), "RH": (2.5, 5.0)}}
#: Which sizes a kind takes; the others have none.
SIZED = {"spike": "jump", "level_shift": "jump", "drift": "drift", "noise_burst": "noise"}
#: Quiet minutes between two faults of a station, and after the last.
APART, TAIL = 90, 20
#: What a logger writes for no reading.
SENTINEL = {"T": -99.9, "P": 0.0, "RH": -99.9}


def uniform(seed: int, *keys: str) -> Column:
    """In (0, 1): 48 bits of an MD5, so that any engine can draw the same."""
    return (F.conv(F.substring(F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def normal(seed: int, *keys: str) -> Column:
    return F.sqrt(-2 * F.ln(uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(seed + 1, *keys))


def random_plan(obs: DataFrame, seed: int = 5, slot: int = 690, chance: float = 1.0, warmup: int = WARMUP) -> DataFrame:
    """A plan of random faults for ``obs`` (station, minute): in every ``slot`` minutes of a station after the warm-up one fault, with ``chance``.

    All draws are hashes of station, slot and ``seed``. A fault is shortened where its slot, or what is left of the history,
    has less room; slots with less than two hours have none. So faults of a station are 90 minutes apart.
    """
    u = lambda k: uniform(1000 * seed + k, "station", "slot")

    def drawn(draw: Column, shares: dict[str, float]) -> Column:
        names, upto = list(shares), 0.0
        out = None
        for name in names[:-1]:
            upto = round(upto + shares[name], 6)
            out = F.when(draw < upto, name) if out is None else out.when(draw < upto, name)
        return out.otherwise(names[-1])

    # 42 rows, as a table: nested cases would be repeated in every column that follows from them
    sizes = obs.sparkSession.createDataFrame(
        [(k, v, t, a, b, *(sized[SIZED[k]][v] if k in SIZED else (None, None))) for k, (a, b) in LENGTHS.items() for v in VARS for t, sized in ((False, GROSS), (True, SUBTLE))],
        "kind string, var string, subtle boolean, least long, most long, low double, high double",
    )
    spans = obs.groupBy("station").agg((F.max("minute") + 1 - TAIL).alias("last")).where(F.col("last") > warmup)
    slots = spans.select("station", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - 1 - warmup) / slot))).alias("slot"))
    slots = slots.withColumn("room", F.least(F.lit(slot), F.col("last") - warmup - F.col("slot") * slot) - APART).where((F.col("room") >= 30) & (u(0) < chance))
    p = slots.select("station", "slot", "room", drawn(u(1), SHARES).alias("kind"), drawn(u(2), VAR_SHARES).alias("var"), (u(3) < 0.5).alias("subtle")).join(F.broadcast(sizes), ["kind", "var", "subtle"])
    p = p.withColumn("length", F.least(F.col("room"), F.col("least") + F.floor(u(4) * (F.col("most") - F.col("least")))))
    start = warmup + F.col("slot") * slot + F.floor(u(5) * (F.col("room") - F.col("length") + 1))
    every = F.col("kind").isin("comm_error", "power_glitch") | ((F.col("kind") == "stuck") & F.col("subtle"))
    return p.select(
        "station", "kind", F.when(every, "all").otherwise(F.col("var")).alias("var"), start.alias("start"), (start + F.col("length")).alias("end"),
        F.when(u(6) < 0.5, -1).otherwise(1).alias("sign"), (F.col("low") + u(7) * (F.col("high") - F.col("low"))).alias("mag"), F.when(u(8) < 0.5, "dropout").otherwise("sentinel").alias("form"),
    )


def inject(obs: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """``obs`` with the faults of ``plan`` in T_raw, P_raw and RH_raw, and anom: the kind, or ''."""
    p = plan.select(F.col("station").alias("s"), *[F.col(c).alias(f"p_{c}") for c in ("kind", "var", "start", "end", "sign", "mag", "form")])
    frozen = obs.select(F.col("station").alias("fs"), F.col("minute").alias("fm"), *[F.col(f"{v}_raw").alias(f"frozen_{v}") for v in VARS])
    p = p.join(frozen, (F.col("s") == F.col("fs")) & (F.col("p_start") - 1 == F.col("fm")), "left").drop("fs", "fm")
    # by station and day, so that a station's minutes aren't held against all its faults
    p = p.withColumn("p_day", F.explode(F.when(F.col("p_end") > F.col("p_start"), F.sequence(F.floor(F.col("p_start") / 1440), F.floor((F.col("p_end") - 1) / 1440)))))
    rows = obs.drop("anom").join(p, (F.col("station") == F.col("s")) & (F.floor(F.col("minute") / 1440) == F.col("p_day")) & (F.col("minute") >= F.col("p_start")) & (F.col("minute") < F.col("p_end")), "left")
    i, kind, size = F.col("minute") - F.col("p_start"), F.col("p_kind"), F.col("p_sign") * F.col("p_mag")
    new = {}
    for k, v in enumerate(VARS):
        x = F.col(f"{v}_raw")
        mine = F.col("p_var").isin(v, "all")
        shaken = (uniform(seed + 10, "station", "minute") < 0.35) | (i == 0)
        jump = F.when(uniform(seed + 20 + k, "station", "minute") < 0.5, -1).otherwise(1) * (GLITCH[v][0] + uniform(seed + 30 + k, "station", "minute") * (GLITCH[v][1] - GLITCH[v][0])) * 0.8
        new[f"{v}_raw"] = (
            F.when(mine & (kind == "spike"), x + size)
            .when(mine & (kind == "level_shift"), x + size * F.least(F.lit(1.0), (i + 1) / 2.0))
            .when(mine & (kind == "drift"), x + size * (i + 1) / F.greatest(F.lit(1), F.col("p_end") - F.col("p_start")))
            .when(mine & (kind == "stuck"), F.coalesce(F.col(f"frozen_{v}"), x))
            .when(mine & (kind == "noise_burst"), x + F.col("p_mag") * normal(seed + 40 + 2 * k, "station", "minute"))
            .when(kind == "comm_error", F.when(F.col("p_form") == "sentinel", F.lit(SENTINEL[v])))
            .when((kind == "power_glitch") & shaken, x + jump)
            .otherwise(x)
        )
    kept = [c for c in obs.columns if c not in new and c != "anom"]
    return rows.select(*kept, *[c.alias(n) for n, c in new.items()], F.coalesce(kind, F.lit("")).alias("anom"))


def degrade(obs: DataFrame, plan: DataFrame) -> DataFrame:
    """Slow unlabelled ramps: ``plan`` has station, var and rate a day; humidity changes in proportion and stays within 1 to 100."""
    rates = plan.groupBy(F.col("station").alias("s")).agg(*[F.sum(F.when(F.col("var") == v, F.col("rate"))).alias(f"rate_{v}") for v in VARS])
    rows = obs.join(rates, F.col("station") == F.col("s"), "left").drop("s")
    day = F.col("minute") / 1440.0
    new = {f"{v}_raw": F.when(F.col(f"rate_{v}").isNotNull(), F.col(f"{v}_raw") + F.col(f"rate_{v}") * day).otherwise(F.col(f"{v}_raw")) for v in ("T", "P")}
    wet = F.when(F.col("RH_raw").isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(1.0), F.col("RH_raw") * (1 + F.col("rate_RH") / 100.0 * day))))
    new["RH_raw"] = F.when(F.col("rate_RH").isNotNull(), wet).otherwise(F.col("RH_raw"))
    return rows.withColumns(new).drop(*[f"rate_{v}" for v in VARS])
