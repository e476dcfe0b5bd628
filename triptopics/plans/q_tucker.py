"""Queries of build step 9: non-negative Tucker baseline on the OD × day × hour tensor."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.indexing import guarded_broadcast
from ..operators import flow
from ..operators import tucker as tk
from ..operators.docs import station_vocab
from ..operators.topics.model import vocab_arrays
from ..session import table
from ..sources.fixtures import TRIPS_SQL, trips
from .catalog import query, with_views

# Ranks and most iterations of the reference's OD-demand decomposition (origin, destination, day, hour).
RANKS = (10, 10, 7, 4)
N_ITER = 1000
TOL = 1e-5
COLS = ["i0", "i1", "i2", "i3"]


def _stations(spark, t):
    stations, _ = vocab_arrays(station_vocab(t))
    return stations, spark.createDataFrame(pd.DataFrame({"station": stations.astype(np.int32), "sid": np.arange(stations.size, dtype=np.int32)}))


def _indexed(coo, st, n, origin, dest):
    return (coo.join(guarded_broadcast(st.withColumnRenamed("station", "origin").withColumnRenamed("sid", origin), n), "origin")
            .join(guarded_broadcast(st.withColumnRenamed("station", "dest").withColumnRenamed("sid", dest), n), "dest"))


def _tensor(spark, sf):
    """COO (o, d, day, bin) with 0-based indices and the keys to map them back."""
    t = trips(spark, sf)
    stations, st = _stations(spark, t)
    coo = flow.od_day_tensor(t, 1).checkpoint()
    first, last = coo.agg(F.min("sday"), F.max("sday")).first()
    n_days = (last - first).days + 1 if first is not None else 1
    idx = (_indexed(coo, st, stations.size, "i0", "i1").withColumn("i2", F.datediff("sday", F.lit(first)) if first is not None else F.lit(0))
           .withColumnRenamed("bin", "i3"))
    return idx, (stations.size, stations.size, n_days, flow.SERVICE_HOURS), stations


_FITS: dict[tuple, tuple] = {}


def _fit(spark, sf):
    """(tensor, model, stations) of the OD tensor; the model-sized fit is made once for a session and its event files."""
    key = (spark.sparkContext.applicationId, RANKS, N_ITER, TOL, *sorted(table(spark, sf, "events").inputFiles()))
    if key not in _FITS:
        coo, shape, stations = _tensor(spark, sf)
        _FITS[key] = coo.select(*COLS, "value"), tk.non_negative_tucker(coo, COLS, shape, RANKS, N_ITER, TOL), stations
    return _FITS[key]


@query("tucker_factors", None, ("O-18", "O-20", "P-13", "J-04"))
def q_tucker_factors(spark, sf):
    _, model, stations = _fit(spark, sf)
    keys = [stations, stations, np.arange(model.factors[2].shape[0]), np.arange(model.factors[3].shape[0])]
    parts = [tk.factor_topics(model, m, keys[m]) for m in range(4)]
    return spark.createDataFrame(pd.concat(parts, ignore_index=True),
                                 "mode int, component int, value long, weight double").withColumn("converged", F.lit(model.converged))


@query("tucker_error", None, ("O-19", "P-15"))
def q_tucker_error(spark, sf):
    _, model, _ = _fit(spark, sf)
    return spark.createDataFrame([(i, round(e, 6), model.converged) for i, e in model.history],
                                 "iteration int, rel_error double, converged boolean")


@query("trip_outliers", None, ("C-08", "A-09"))
def q_trip_outliers(spark, sf):
    coo, model, _ = _fit(spark, sf)
    res = tk.residuals(coo, COLS, model)
    return tk.outliers(res).withColumn("x_hat", F.round("x_hat", 4)).withColumn("converged", F.lit(model.converged))


# Ranks and most iterations of the reference's passenger decomposition (user, origin, destination, 7-hour bin).
USER_RANKS = (20, 10, 10, 3)
USER_ITER = 3000
USER_TOL = 1e-3


@query("passenger_tucker", None, ("O-18", "O-19", "O-20", "A-07"))
def q_passenger_tucker(spark, sf):
    """User × O × D × T tensor; the user factor stays a distributed table."""
    t = trips(spark, sf)
    stations, st = _stations(spark, t)
    coo = _indexed(flow.user_od_tensor(t, 7), st, stations.size, "i1", "i2").withColumnRenamed("bin", "i3")
    users, model = tk.non_negative_tucker_users(coo, ["i1", "i2", "i3"], (0, stations.size, stations.size, 3), USER_RANKS, USER_ITER, USER_TOL)
    total = F.aggregate("u", F.lit(0.0), lambda a, x: a + x)
    return users.select("user_id", F.transform("u", lambda x: x / total).alias("weights"),
                        F.lit(round(model.history[-1][1], 4)).alias("rel_error"), F.lit(len(model.history)).alias("iterations"),
                        F.lit(model.converged).alias("converged"))


# ---- one iteration from a stated start: the same updates as sums in SQL -------------------------

SMALL_RANKS = (2, 2, 2, 2)
CORE_START = {r: 1.0 + r[0] + 2 * r[1] * r[2] + r[3] * (1 - r[0]) for r in product(range(2), repeat=4)}


def _start_factor(size: int) -> np.ndarray:
    i, r = np.indices((size, 2))
    return 0.1 + ((i * 7 + r * 3) % 11) / 10.0


def _one_iteration_sql() -> str:
    """Modes 0 to 3 one after the other, then the core, from ``_start_factor`` and ``CORE_START``."""
    others = lambda n: [m for m in range(4) if m != n]
    views = [
        "days AS (SELECT MIN(sday) AS d0, MAX(sday) AS d1 FROM coo)",
        "st AS (SELECT station, row_number() OVER (ORDER BY station) - 1 AS i FROM (SELECT origin AS station FROM trips UNION SELECT dest FROM trips) WHERE station IS NOT NULL)",
        """x AS MATERIALIZED (SELECT so.i AS i0, sd.i AS i1, date_diff('day', d0, sday) AS i2, bin AS i3, CAST(n AS DOUBLE) AS v
             FROM coo JOIN st so ON so.station = origin JOIN st sd ON sd.station = dest, days)""",
        "sizes AS (SELECT (SELECT COUNT(*) FROM st) AS s, (SELECT date_diff('day', d0, d1) + 1 FROM days) AS d)",
        "g AS (SELECT * FROM (VALUES " + ", ".join(f"({r[0]}, {r[1]}, {r[2]}, {r[3]}, CAST({v} AS DOUBLE))" for r, v in CORE_START.items()) + ") t(r0, r1, r2, r3, c))",
        "rr AS (SELECT UNNEST([0, 1]) AS r)",
    ]
    for m, size in enumerate(["s", "s", "d", str(flow.SERVICE_HOURS)]):
        views.append(f"f{m} AS (SELECT i, r, 0.1 + ((i * 7 + r * 3) % 11) / 10.0::DOUBLE AS a FROM (SELECT UNNEST(range({size})) AS i FROM sizes), rr)")
    now = {m: f"f{m}" for m in range(4)}

    def gram(m):
        return f"(SELECT p.r AS r, q.r AS s, SUM(p.a * q.a) AS h FROM {now[m]} p JOIN {now[m]} q USING (i) GROUP BY 1, 2)"

    for n in range(4):
        joins = " ".join(f"JOIN {now[m]} a{m} ON a{m}.i = x.i{m} AND a{m}.r = g.r{m}" for m in others(n))
        value = " * ".join(["x.v", "g.c", *(f"a{m}.a" for m in others(n))])
        views.append(f"num{n} AS MATERIALIZED (SELECT x.i{n} AS i, g.r{n} AS r, SUM({value}) AS num FROM x CROSS JOIN g {joins} GROUP BY 1, 2)")
        hs = " ".join(f"JOIN {gram(m)} h{m} ON h{m}.r = g.r{m} AND h{m}.s = k.r{m}" for m in others(n))
        weight = " * ".join(["g.c", "k.c", *(f"h{m}.h" for m in others(n))])
        views.append(f"den{n} AS MATERIALIZED (SELECT k.r{n} AS r, g.r{n} AS s, SUM({weight}) AS w FROM g CROSS JOIN g k {hs} GROUP BY 1, 2)")
        views.append(f"""u{n} AS MATERIALIZED (SELECT f.i, f.r, f.a * COALESCE(num, 0) / GREATEST(d.d, 1e-12) AS a FROM {now[n]} f
            JOIN (SELECT p.i, w.r, SUM(p.a * w.w) AS d FROM {now[n]} p JOIN den{n} w ON w.s = p.r GROUP BY 1, 2) d ON d.i = f.i AND d.r = f.r
            LEFT JOIN num{n} ON num{n}.i = f.i AND num{n}.r = f.r)""")
        now[n] = f"u{n}"
    joins = " ".join(f"JOIN {now[m]} a{m} ON a{m}.i = x.i{m}" for m in range(4))
    views.append(f"""cnum AS (SELECT a0.r AS r0, a1.r AS r1, a2.r AS r2, a3.r AS r3, SUM(x.v * a0.a * a1.a * a2.a * a3.a) AS num FROM x {joins} GROUP BY 1, 2, 3, 4)""")
    hs = " ".join(f"JOIN {gram(m)} h{m} ON h{m}.r = k.r{m} AND h{m}.s = g.r{m}" for m in range(4))
    views.append(f"""cden AS (SELECT k.r0, k.r1, k.r2, k.r3, SUM(g.c * h0.h * h1.h * h2.h * h3.h) AS den FROM g CROSS JOIN g k {hs} GROUP BY 1, 2, 3, 4)""")
    factors = " UNION ALL ".join(f"SELECT {m} AS mode, CAST(i AS BIGINT) AS item, CAST(r AS INT) AS component, ROUND(a, 6) AS value FROM u{m}" for m in range(4))
    return ",\n".join(views) + f"""
{factors}
UNION ALL SELECT 4, CAST(((r0 * 2 + r1) * 2 + r2) * 2 + r3 AS BIGINT), 0, ROUND(g.c * num / GREATEST(den, 1e-12), 6)
FROM g JOIN cnum USING (r0, r1, r2, r3) JOIN cden USING (r0, r1, r2, r3)"""


COO_SQL = f"""
SELECT CAST(ts - INTERVAL 5 HOUR AS DATE) AS sday, CAST(((HOUR(ts) - 5) % 24 + 24) % 24 AS INT) AS bin, origin, dest, COUNT(*) AS n
FROM trips WHERE ((HOUR(ts) - 5) % 24 + 24) % 24 < {flow.SERVICE_HOURS} GROUP BY 1, 2, 3, 4"""


@query("tucker_one_iteration", with_views("", trips=TRIPS_SQL, coo=COO_SQL).rstrip() + ",\n" + _one_iteration_sql(), ("O-18", "O-20"))
def q_tucker_one_iteration(spark, sf):
    """Factors (modes 0 to 3) and core (mode 4, cells in row order) after one iteration from a stated start."""
    coo, shape, _ = _tensor(spark, sf)
    start = np.array([CORE_START[r] for r in product(range(2), repeat=4)]).reshape(SMALL_RANKS), [_start_factor(s) for s in shape]
    model = tk.non_negative_tucker(coo, COLS, shape, SMALL_RANKS, 1, start=start, small=(2, 3))
    rows = [(m, int(i), int(r), round(float(a[i, r]), 6)) for m, a in enumerate(model.factors) for i, r in np.ndindex(*a.shape)]
    rows += [(4, k, 0, round(float(c), 6)) for k, c in enumerate(model.core.ravel())]
    return spark.createDataFrame(rows, "mode int, item long, component int, value double")
