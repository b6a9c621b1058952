"""The same answers in DuckDB SQL: common table expressions that build on each other, written apart from the Spark code."""

from __future__ import annotations

from ..constants import FLOOR, NOISE, RANGE, STEP, STUCK, VARS
from .fixtures import PANEL, STATIONS


def each(text: str, sep: str = ", ", names=VARS) -> str:
    return sep.join(text.replace("@", v) for v in names)


def r6(cols: str) -> str:
    """Doubles, rounded, without a negative zero.  The nudge keeps decimal halves, which last bits would tip, off the edge."""
    return ", ".join(f"round({c} + 1.3e-8, 6) + 0.0 AS {c}" for c in cols.split())


def _range(v: str) -> str:
    return f"coalesce({v}_raw < {RANGE[v][0]} OR {v}_raw > {RANGE[v][1]}, false)"


def interp(tab: str, station: str = "f.station", minute: str = "f.minute") -> str:
    return f"""(SELECT a.x + (b.x - a.x) * (({minute} % 60) / 60.0) FROM {tab} a, {tab} b WHERE a.station = {station} AND b.station = {station}
  AND a.hour = CAST(floor(({minute} % 1440) / 60) AS INT) AND b.hour = (CAST(floor(({minute} % 1440) / 60) AS INT) + 1) % 24)"""


W = "(PARTITION BY station ORDER BY minute)"
MED = "(PARTITION BY station ORDER BY minute ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"

#: name: (what it builds on, SQL)
CTES: dict[str, tuple[list[str], str]] = {
    "panel": ([], PANEL),
    "stations": ([], STATIONS),
    "sent": (["panel"], "sent AS (SELECT *, coalesce(T_raw, 0) <= -90 OR coalesce(P_raw, 5) <= 1 OR coalesce(RH_raw, 0) <= -90 AS sentinel FROM panel)"),
    "comm": (["sent"], "commed AS (SELECT *, T_raw IS NULL OR P_raw IS NULL OR RH_raw IS NULL OR sentinel AS comm FROM sent)"),
    "chk": (["comm"], "chk AS (SELECT *, " + ", ".join(f"{_range(v)} AND NOT comm AS rng_{v}, CASE WHEN NOT sentinel AND NOT {_range(v)} THEN {v}_raw END AS {v}" for v in VARS) + " FROM commed)"),
    "clim": (["chk"], "clim AS (SELECT station, CAST(floor((minute % 1440) / 60) AS INT) AS hour, " + each("avg(@) AS @") + " FROM chk GROUP BY ALL)"),
    "hours": ([], "hours AS (SELECT CAST(unnest(range(0, 24)) AS INT) AS hour)"),
    "cl": (
        ["clim"],
        "cl AS (SELECT c.*, " + each("a.@ + (b.@ - a.@) * ((c.minute % 60) / 60.0) AS cl_@") + """ FROM chk c
  LEFT JOIN clim a ON a.station = c.station AND a.hour = CAST(floor((c.minute % 1440) / 60) AS INT)
  LEFT JOIN clim b ON b.station = c.station AND b.hour = (CAST(floor((c.minute % 1440) / 60) AS INT) + 1) % 24)""",
    ),
    "dew": (["cl"], "dew0 AS (SELECT *, CASE WHEN T IS NOT NULL AND RH IS NOT NULL THEN ln(greatest(greatest(RH, 0.5) / 100.0 * 6.112 * exp(17.67 * T / (T + 243.5)), 1e-6) / 6.112) END AS g FROM cl),\ndew AS (SELECT *, 243.5 * g / (17.67 - g) AS td FROM dew0)"),
    "moved": (
        ["dew"],
        "moved AS (SELECT *, " + each(f"@ - lag(@) OVER {W} AS d1_@, @ - lag(@, 5) OVER {W} - (cl_@ - lag(cl_@, 5) OVER {W}) AS d5_@, @ - CASE WHEN count(@) OVER {MED} >= 15 THEN quantile_cont(@, 0.5) OVER {MED} END - (cl_@ - lag(cl_@, 15) OVER {W}) AS innov_@, coalesce(@ = lag(@) OVER {W}, false) AS same_@")
        + f", td - CASE WHEN count(td) OVER {MED} >= 15 THEN quantile_cont(td, 0.5) OVER {MED} END AS td_innov, td - lag(td) OVER {W} AS td_d1 FROM dew)",
    ),
    "spread": (
        ["moved"],
        "spread AS (SELECT *, " + ", ".join(f"CASE WHEN count(d1_{v}) OVER d >= 6 THEN stddev_samp(d1_{v}) OVER d / {NOISE[v]} END AS dsd_{v}, minute - max(CASE WHEN NOT same_{v} THEN minute END) OVER {W} AS run_{v}" for v in VARS)
        + " FROM moved WINDOW d AS (PARTITION BY station ORDER BY minute ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))",
    ),
    "feat": (
        ["spread"],
        "flag AS (SELECT *, " + ", ".join(f"coalesce(abs(d1_{v}) > {STEP[v]}, false) AS step_{v}, run_{v} >= {STUCK[v]}" + (" AND coalesce(RH < 98, false)" if v == "RH" else "") + f" AS stuck_{v}" for v in VARS)
        + " FROM spread),\nfeat AS (SELECT *, step_T OR step_P OR step_RH AS step_any, stuck_T OR stuck_P OR stuck_RH AS stuck_any, coalesce(abs(td_innov), 0.0) / 6.0 AS ph, CASE WHEN dsd_T IS NOT NULL AND dsd_P IS NOT NULL AND dsd_RH IS NOT NULL THEN greatest(dsd_T, dsd_P, dsd_RH) ELSE 0.0 END AS dsd_max, least(8.0, coalesce(abs(innov_T) / 0.6, 0.0)) AS ts FROM flag)",
    ),
    "anomaly": (["feat"], "anomaly AS (SELECT *, T - cl_T AS A_T, P - cl_P AS A_P, CASE WHEN RH IS NOT NULL AND cl_RH IS NOT NULL THEN 100.0 * (ln(greatest(RH, 0.5)) - ln(greatest(cl_RH, 0.5))) END AS A_RH FROM feat)"),
    "edges": (
        ["stations"],
        """km AS (SELECT a.station, b.station AS nb, 2 * 6371.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS km
  FROM stations a JOIN stations b ON a.station <> b.station),
near AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY km, nb) AS rank FROM km WHERE km <= 100),
edges AS (SELECT station, nb, km, rank, count(*) OVER (PARTITION BY station) AS listed FROM near WHERE rank <= 6)""",
    ),
}


def support(name: str, source: str, hide: str | None) -> str:
    """Neighbour medians, spreads and support of ``source`` as ``name``; ``hide``: rows that don't speak."""
    val = (lambda c: f"CASE WHEN NOT {hide} THEN {c} END") if hide else (lambda c: c)
    cols = [f"A_{v}" for v in VARS] + [f"innov_{v}" for v in VARS]
    return f"""{name}_v AS (SELECT e.station, n.minute, e.listed, {", ".join(f"{val('n.' + c)} AS {c}" for c in [*cols, "ts"])} FROM edges e JOIN {source} n ON n.station = e.nb),
{name}_m AS (SELECT station, minute, min(listed) AS listed, count(A_T) AS nn, quantile_cont(ts, 0.5) AS nb_ts, {", ".join(f"quantile_cont({c}, 0.5) AS m_{c}, count({c}) AS n_{c}" for c in cols)} FROM {name}_v GROUP BY station, minute),
{name}_s AS (SELECT v.station, v.minute, {each("1.4826 * quantile_cont(abs(v.A_@ - m.m_A_@), 0.5) AS s_@")} FROM {name}_v v JOIN {name}_m m ON v.station = m.station AND v.minute = m.minute GROUP BY v.station, v.minute),
{name}_x AS (SELECT a.*, {each("CASE WHEN m.n_A_@ >= 2 THEN m.m_A_@ END AS med_@, CASE WHEN m.n_innov_@ >= 2 THEN m.m_innov_@ END AS medI_@, CASE WHEN m.listed >= 3 THEN coalesce(s.s_@, 0.0) ELSE 0.0 END AS spread_@")},
  coalesce(m.nn, 0) AS nn, coalesce(m.nb_ts, 0.0) AS nb_ts, coalesce(m.nn, 0) >= 2 AS has_nb FROM {source} a LEFT JOIN {name}_m m ON a.station = m.station AND a.minute = m.minute LEFT JOIN {name}_s s ON a.station = s.station AND a.minute = s.minute),
{name} AS (SELECT *, {each("A_@ - med_@ AS res_@, innov_@ - medI_@ AS resI_@")} FROM {name}_x)"""


def zscores(name: str, source: str) -> str:
    return f"""{name}_o AS (SELECT r.*, {each("a.off_@ + (b.off_@ - a.off_@) * ((r.minute % 60) / 60.0) AS offt_@, g.sig_@, g.sigI_@")} FROM {source} r JOIN sigma g ON g.station = r.station
  JOIN offs a ON a.station = r.station AND a.hour = CAST(floor((r.minute % 1440) / 60) AS INT) JOIN offs b ON b.station = r.station AND b.hour = (CAST(floor((r.minute % 1440) / 60) AS INT) + 1) % 24),
{name} AS (SELECT *, {each("(res_@ - offt_@) / sqrt(sig_@ * sig_@ + spread_@ * spread_@) AS zL_@, resI_@ / sigI_@ AS zI_@")} FROM {name}_o)"""


CTES |= {
    "res": (["anomaly", "edges"], support("res", "anomaly", None)),
    "offs": (
        ["res", "hours"],
        "nres AS (SELECT station, " + each("count(res_@) AS n_@") + " FROM res GROUP BY station),\nmedh AS (SELECT station, CAST(floor((minute % 1440) / 60) AS INT) AS hour, " + each("quantile_cont(res_@, 0.5) AS m_@") + " FROM res GROUP BY ALL),\n"
        + "offs AS (SELECT n.station, h.hour, n.n_T, n.n_P, n.n_RH, " + each("CASE WHEN n.n_@ >= 500 THEN coalesce(m.m_@, 0.0) ELSE 0.0 END AS off_@") + " FROM nres n CROSS JOIN hours h LEFT JOIN medh m ON m.station = n.station AND m.hour = h.hour)",
    ),
    "sigma": (
        ["offs"],
        "r2 AS (SELECT r.station, " + each("r.res_@ - (a.off_@ + (b.off_@ - a.off_@) * ((r.minute % 60) / 60.0)) AS r_@, r.resI_@ AS i_@") + """ FROM res r JOIN offs a ON a.station = r.station AND a.hour = CAST(floor((r.minute % 1440) / 60) AS INT)
  JOIN offs b ON b.station = r.station AND b.hour = (CAST(floor((r.minute % 1440) / 60) AS INT) + 1) % 24),\nmid AS (SELECT station, """ + each("quantile_cont(r_@, 0.5) AS mr_@, quantile_cont(i_@, 0.5) AS mi_@, count(r_@) AS n_@") + " FROM r2 GROUP BY station),\n"
        + "sigma AS (SELECT r2.station, " + ", ".join(f"CASE WHEN min(n_{v}) >= 500 THEN greatest({FLOOR[v]}, 1.4826 * quantile_cont(abs(r_{v} - mr_{v}), 0.5), quantile_cont(abs(r_{v} - mr_{v}), 0.99) / 2.576) ELSE {FLOOR[v]} END AS sig_{v}, CASE WHEN min(n_{v}) >= 500 THEN greatest({FLOOR[v]} * 0.5, 1.4826 * quantile_cont(abs(i_{v} - mi_{v}), 0.5)) ELSE {FLOOR[v]} * 0.5 END AS sigI_{v}" for v in VARS)
        + " FROM r2 JOIN mid ON mid.station = r2.station GROUP BY r2.station)",
    ),
    "z": (["sigma"], zscores("z", "res")),
    "hard": (["z"], "hard0 AS (SELECT *, least(1.0, coalesce(abs(zL_T), 0.0) / 8) AS p_model, comm OR rng_T OR rng_P OR rng_RH OR stuck_any AS hard FROM z),\nhard AS (SELECT *, rng_T OR rng_P OR rng_RH OR (step_any AND p_model >= 0.5) AS instant, CASE WHEN hard THEN greatest(p_model, 0.99) ELSE p_model END AS prob FROM hard0)"),
    "excl": (["hard"], "excl AS (SELECT *, max(CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY minute ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) > 0 AS excluded FROM hard)"),
    "second": (["excl"], support("second", "(SELECT " + "* EXCLUDE (" + each("med_@, medI_@, spread_@, res_@, resI_@, offt_@, sig_@, sigI_@, zL_@, zI_@") + ", nn, nb_ts, has_nb) FROM excl)", "n.excluded") + ",\n" + zscores("second_z", "second")),
    "exp": (
        ["hard"],
        "exp0 AS (SELECT *, cl_T + med_T + offt_T AS exp_T, cl_P + med_P + offt_P AS exp_P, CASE WHEN cl_RH IS NOT NULL AND med_RH IS NOT NULL AND offt_RH IS NOT NULL THEN least(100.0, cl_RH * exp((med_RH + offt_RH) / 100.0)) END AS exp_RH, max(CASE WHEN has_nb THEN 1 ELSE 0 END) OVER (PARTITION BY station) > 0 AS ever FROM hard),\n"
        "expected AS (SELECT *, exp_T - 3 * sig_T AS exp_lo_T, exp_T + 3 * sig_T AS exp_hi_T, exp_P - 3 * sig_P AS exp_lo_P, exp_P + 3 * sig_P AS exp_hi_P, exp_RH * exp(-3 * sig_RH / 100.0) AS exp_lo_RH, CASE WHEN exp_RH IS NOT NULL THEN least(100.0, exp_RH * exp(3 * sig_RH / 100.0)) END AS exp_hi_RH, "
        "CASE WHEN ever THEN zL_T * sig_T END AS dev_T, CASE WHEN ever THEN zL_P * sig_P END AS dev_P, CASE WHEN ever THEN RH * (1 - exp(-coalesce(zL_RH * sig_RH, 0.0) / 100.0)) END AS dev_RH FROM exp0)",
    ),
}


def runs(name: str, source: str, act: str, instant: str = "false", need: int = 4, win: int = 6, close: int = 10) -> str:
    """Alert sessions of ``source`` as ``name``: station, onset, detect, end, ongoing."""
    return f"""{name}_b AS (SELECT station, minute, {act} OR {instant} AS act, {instant} AS now, sum(CASE WHEN {act} OR {instant} THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY minute ROWS BETWEEN {win - 1} PRECEDING AND CURRENT ROW) AS sm FROM {source}),
{name}_a AS (SELECT *, CASE WHEN now THEN greatest(sm, {need}) ELSE sm END AS n, coalesce(minute - lag(minute) OVER {W} > {close}, true) AS fresh FROM {name}_b WHERE act),
{name}_s AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER {W} AS session FROM {name}_a),
{name}_d AS (SELECT *, min(CASE WHEN n >= {need} THEN minute END) OVER (PARTITION BY station, session) AS detect FROM {name}_s),
{name} AS (SELECT station, min(CASE WHEN minute >= detect - {win - 1} THEN minute END) AS onset, min(detect) AS detect, max(minute) + 1 AS "end", (SELECT max(minute) FROM {source}) - max(minute) < {close} AS ongoing FROM {name}_d WHERE detect IS NOT NULL GROUP BY station, session)"""


CTES |= {
    "limits": (["feat"], "limits AS (SELECT *, comm OR rng_T OR rng_P OR rng_RH OR stuck_any OR step_any AS bad FROM feat),\n" + runs("plainruns", "limits", "bad", need=1, win=1)),
    "alerts": (["hard"], runs("alerts", "hard", "prob >= 0.7", "instant")),
    "masked": (["alerts"], 'mins AS (SELECT DISTINCT station, unnest(range(onset, "end")) AS minute FROM alerts),\nmasked AS (SELECT h.*, m.minute IS NOT NULL AS in_fault FROM hard h LEFT JOIN mins m ON h.station = m.station AND h.minute = m.minute)'),
    "weather": (["masked"], runs("wruns", "masked", "(ts >= 1 AND NOT in_fault)", need=3, win=5, close=15) + ',\nweather AS (SELECT w.station, w.detect AS start, coalesce(min(m.minute), w."end") AS "end" FROM wruns w LEFT JOIN masked m ON m.station = w.station AND m.in_fault AND m.minute >= w.detect AND m.minute < w."end" GROUP BY w.station, w.detect, w."end")'),
}


def build(last: str, select: str) -> str:
    """The SQL of ``select`` with the expressions it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in CTES[name][0]:
            add(x)
        if name not in order:
            order.append(name)

    for name in last.split():
        add(name)
    return "WITH " + ",\n".join(CTES[n][1] for n in order) + "\n" + select
