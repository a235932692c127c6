"""Survival-time set-up and non-parametric estimates.

Everything is built on a *time table*: one row per (stratum, distinct time)
with entries, exits and events, made by a union + ``groupBy`` (map-side
partial aggregation).  Risk sets with delayed entry are exclusive prefix sums
over time: n_risk(t) = #(start < t) - #(stop < t), i.e. start < t <= stop.
The prefix sums run through the blocked ordered scan with time-quantile
blocks, so a stratum is never one task, however many distinct times it has.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scan import BLOCK, blocks_from_quantiles, blocks_like, materialize, ordered_scan

Z975 = 1.959963984540054  # normal 97.5 % point


@dataclass(frozen=True)
class SurvSpec:
    start: str = "t_start"
    stop: str = "t_stop"
    event: str = "outcome"
    weight: str | None = None


def surv_set(df: DataFrame, spec: SurvSpec) -> tuple[DataFrame, DataFrame]:
    """Declare survival data.  Failure = event nonzero and not missing.
    Rows with missing times or exit <= entry are set aside with a reason."""
    st, sp, ev = F.col(spec.start), F.col(spec.stop), F.col(spec.event)
    reason = (F.when(sp.isNull(), "missing exit").when(st.isNull(), "missing entry")
              .when(sp <= st, "exit <= entry").otherwise("ok"))
    d = df.withColumn("_reason", reason)
    report = d.groupBy(F.col("_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    valid = d.filter(F.col("_reason") == "ok").drop("_reason") \
        .withColumn("_d", F.when(ev.isNotNull() & (ev != 0), 1).otherwise(0))
    return valid, report


def _blocks(df: DataFrame, col: str) -> DataFrame:
    return blocks_from_quantiles(df, col)


def time_table(df: DataFrame, spec: SurvSpec, by: Sequence[str] = ()) -> DataFrame:
    """(by..., time, n_entry, n_exit, n_event, n_risk, cum_net) over all distinct times."""
    by = list(by)
    valid, _ = surv_set(df, spec)
    w = F.col(spec.weight).cast("double") if spec.weight else F.lit(1).cast("long")
    ent = valid.select(*by, F.col(spec.start).cast("double").alias("time"), w.alias("n_entry"),
                       (w * 0).alias("n_exit"), (w * 0).alias("n_event"))
    ext = valid.select(*by, F.col(spec.stop).cast("double").alias("time"), (w * 0).alias("n_entry"),
                       w.alias("n_exit"), (w * F.col("_d")).alias("n_event"))
    tt = ent.unionByName(ext).groupBy(*by, "time").agg(
        F.sum("n_entry").alias("n_entry"), F.sum("n_exit").alias("n_exit"), F.sum("n_event").alias("n_event"))
    # The time table is an aggregate (at most one row per distinct time and
    # stratum).  It is checkpointed once, so the quantile cuts and every
    # prefix-sum pass below read it instead of recomputing the input lineage.
    tt = materialize(tt)
    tt = _blocks(tt, "time")
    tt = ordered_scan(tt, by, ["time"], cumsum={"_ce": "n_entry", "_cx": "n_exit"})
    return tt.withColumns({
        "n_risk": F.col("_ce") - F.col("n_entry") - (F.col("_cx") - F.col("n_exit")),
        "cum_net": F.col("_ce") - F.col("_cx"),
        "cum_event": F.lit(0),
    }).drop("_ce", "_cx", "cum_event")


def km_table(df: DataFrame, spec: SurvSpec, by: Sequence[str] = ()) -> DataFrame:
    """S3 on the full time table: survival, Greenwood sum, cumulative events."""
    by = list(by)
    tt = time_table(df, spec, by)
    d, n = F.col("n_event").cast("double"), F.col("n_risk").cast("double")
    has = F.col("n_event") > 0
    tt = tt.withColumns({
        "_lg": F.when(has & (d < n), F.log1p(-d / n)).otherwise(F.lit(0.0)),
        "_z": F.when(has & (d >= n), 1).otherwise(0),
        "_gw": F.when(has & (d < n), d / (n * (n - d))).otherwise(F.lit(0.0)),
    })
    if "_blk" not in tt.columns:
        tt = _blocks(tt, "time")
    tt = ordered_scan(tt, by, ["time"], cumsum={"_slg": "_lg", "_sz": "_z", "_sgw": "_gw", "cum_event": "n_event"})
    surv = F.when(F.col("_sz") > 0, F.lit(0.0)).otherwise(F.exp("_slg"))
    se_log = F.sqrt("_sgw")
    return tt.withColumns({
        "surv": surv,
        "std_err": surv * se_log,
        "lower": F.when(F.col("_sz") > 0, F.lit(None)).otherwise(F.exp(F.col("_slg") - F.lit(Z975) * se_log)),
        "upper": F.when(F.col("_sz") > 0, F.lit(None)).otherwise(F.least(F.lit(1.0), F.exp(F.col("_slg") + F.lit(Z975) * se_log))),
        "cumhaz": F.lit(0.0) - F.col("_slg"),
    }).drop("_lg", "_z", "_gw", "_slg", "_sz", "_sgw")


KM_COLUMNS = ["time", "n_risk", "n_event", "n_censor", "surv", "std_err", "lower", "upper"]


def kaplan_meier(df: DataFrame, spec: SurvSpec, by: Sequence[str] = ()) -> DataFrame:
    """S3: Kaplan-Meier rows at every time with an exit (event or censoring)."""
    k = km_table(df, spec, by)
    k = k.filter(F.col("n_exit") > 0).withColumn("n_censor", F.col("n_exit") - F.col("n_event"))
    return k.select(*by, *KM_COLUMNS, "cumhaz", "_blk")


def km_at(df: DataFrame, spec: SurvSpec, times: Sequence[float], by: Sequence[str] = (),
          reverse: bool = False) -> DataFrame:
    """Survival (or risk 1-S) with CI and number at risk at asked times.

    As-of lookup without a range join: grid rows are unioned into the time
    table and the last curve row at or before each grid time is carried down
    by the ordered scan.  S = 1 and n_risk = 0 before the first time."""
    by = list(by)
    k = km_table(df, spec, by)
    groups = k.select(*by).distinct()
    grid = groups.withColumn("time", F.explode(F.array(*[F.lit(float(t)) for t in times])))
    cols = ["surv", "lower", "upper", "n_risk", "cum_net", "cum_event"]
    curve = k.select(*by, "time", F.lit(0).alias("_kind"),
                     F.struct(F.col("time").alias("t"), *[F.col(c) for c in cols]).alias("_row"))
    g = grid.select(*by, "time", F.lit(1).alias("_kind"), F.lit(None).cast(curve.schema["_row"].dataType).alias("_row"))
    # same time cuts as the curve: no second quantile pass over the input
    u = blocks_like(curve.unionByName(g), "time", k)
    u = ordered_scan(u, by, ["time", "_kind"], fill_down={"_c": "_row"})
    u = u.filter(F.col("_kind") == 1)
    c = F.col("_c")
    at_same = c.getField("t") == F.col("time")
    s = F.coalesce(c.getField("surv"), F.lit(1.0))
    out = u.select(*by, "time",
                   F.coalesce(F.when(at_same, c.getField("n_risk")).otherwise(c.getField("cum_net")), F.lit(0))
                   .cast("long").alias("n_risk"),
                   F.coalesce(c.getField("cum_event"), F.lit(0)).cast("long").alias("cum_event"),
                   s.alias("surv"),
                   F.when(c.isNull(), F.lit(1.0)).otherwise(c.getField("lower")).alias("lower"),
                   F.when(c.isNull(), F.lit(1.0)).otherwise(c.getField("upper")).alias("upper"))
    if reverse:
        out = out.select(*by, "time", "n_risk", "cum_event", (1 - F.col("surv")).alias("risk"),
                         (1 - F.col("upper")).alias("lower"), (1 - F.col("lower")).alias("upper"))
    return out


def km_summary(df: DataFrame, spec: SurvSpec, by: Sequence[str] = ()) -> DataFrame:
    """Records, events, max n at risk, n at risk at the first event, restricted
    mean up to the largest time over all groups (S = 1 from 0 to the first event),
    median = first event time with S <= 0.5, and its 95 % limits from the CI band
    (first times where the lower / upper limit reaches 0.5, so lcl <= median <= ucl).  se(rmean)^2 = sum over
    event times of A_i^2 d_i / (n_i (n_i - d_i)), A_i = area under S from t_i to the
    upper limit, expanded into group sums so no per-row join is needed."""
    by = list(by)
    k = km_table(df, spec, by)
    ev = k.filter(F.col("n_event") > 0)
    ev = ordered_scan(ev, by, ["time"], lag={"_pt": "time", "_ps": "surv"})
    piece = F.coalesce(F.col("_ps"), F.lit(1.0)) * (F.col("time") - F.coalesce(F.col("_pt"), F.lit(0.0)))
    ev = ordered_scan(ev.withColumn("_piece", piece), by, ["time"], cumsum={"_carea": "_piece"})
    # variance weight of each event time (Greenwood form); A_i = rmean - area up to t_i
    d, n = F.col("n_event").cast("double"), F.col("n_risk").cast("double")
    wv = F.when(n > d, d / (n * (n - d))).otherwise(F.lit(0.0))
    area = ev.groupBy(*by).agg(F.sum("_piece").alias("_area"), F.max("time").alias("_tl"),
                               F.sum(wv).alias("_sw"), F.sum(wv * F.col("_carea")).alias("_swc"),
                               F.sum(wv * F.col("_carea") * F.col("_carea")).alias("_swcc"),
                               F.max_by("surv", "time").alias("_s_last"),
                               F.min_by("n_risk", "time").alias("n_start"),
                               F.min(F.when(F.col("surv") <= 0.5, F.col("time"))).alias("median"),
                               F.min(F.when(F.coalesce(F.col("lower"), F.lit(0.0)) <= 0.5, F.col("time"))).alias("median_lcl"),
                               F.min(F.when(F.col("upper") <= 0.5, F.col("time"))).alias("median_ucl"))
    counts = k.groupBy(*by).agg(F.sum("n_exit").alias("records"), F.sum("n_event").alias("events"),
                                F.max("n_risk").alias("n_max"))
    tau = k.agg(F.max("time").alias("_tau")).withColumn("_one", F.lit(1))  # one row
    if by:
        j = counts.join(area, on=by, how="left")
    else:
        j = counts.withColumn("_k", F.lit(1)).join(area.withColumn("_k", F.lit(1)), on="_k", how="left").drop("_k")
    j = j.withColumn("_one", F.lit(1)).join(tau, on="_one").drop("_one")
    rmean = F.coalesce(F.col("_area"), F.lit(0.0)) + F.coalesce(F.col("_s_last"), F.lit(1.0)) * (
        F.col("_tau") - F.coalesce(F.col("_tl"), F.lit(0.0)))
    j = j.withColumn("rmean", rmean)
    var = (F.col("rmean") * F.col("rmean") * F.coalesce(F.col("_sw"), F.lit(0.0))
           - 2 * F.col("rmean") * F.coalesce(F.col("_swc"), F.lit(0.0)) + F.coalesce(F.col("_swcc"), F.lit(0.0)))
    return j.select(*by, "records", "events", "n_max", "n_start", "rmean",
                    F.sqrt(F.greatest(var, F.lit(0.0))).alias("se_rmean"), "median", "median_lcl", "median_ucl")


def km_transform(km: DataFrame, fun: str) -> DataFrame:
    """S6: 'event' 1-S, 'cumhaz' -ln S, 'cloglog' ln(-ln S) against ln t."""
    s = F.col("surv")
    if fun == "event":
        return km.withColumn("value", 1 - s)
    if fun == "cumhaz":
        return km.withColumn("value", F.when(s > 0, F.lit(0.0) - F.log(s)))
    if fun == "cloglog":
        return km.withColumns({"log_time": F.when(F.col("time") > 0, F.log("time")),
                               "value": F.when((s > 0) & (s < 1), F.log(-F.log(s)))})
    raise ValueError(fun)


def trajectories(df: DataFrame, id_col: str, order: Sequence[str], t: str, y: str) -> DataFrame:
    """Per-subject ordered (time, measure) rows, long form (no per-subject arrays)."""
    from .periods import SubjectSpec, scan
    d = df.filter(F.col(y).isNotNull())
    d = scan(d, SubjectSpec(id=id_col, order=tuple(order)), row_number="seq")
    return d.select(id_col, "seq", F.col(t).alias("t"), F.col(y).alias("y"))


SPLINE_KNOTS = (7.5, 15.0, 22.5)
SPLINE_SPAN = 30.0  # fixed time span of the reference's grids (0..30); basis built on t / span


def spline_basis(t, knots=SPLINE_KNOTS, span: float = SPLINE_SPAN):
    """Truncated-power cubic basis on u = t / span (same fitted curve as on t,
    moments of order n instead of n * t^6)."""
    u = t / F.lit(span)
    cols = [F.lit(1.0), u, u * u, u * u * u]
    cols += [F.pow(F.greatest(u - F.lit(k / span), F.lit(0.0)), 3) for k in knots]
    return cols


def spline_moments(df: DataFrame, t: str, y: str, knots: Sequence[float] = SPLINE_KNOTS) -> DataFrame:
    """S9, distributed part: X'X and X'y of the spline basis in one aggregate (long form)."""
    d = df.filter(F.col(t).isNotNull() & F.col(y).isNotNull())
    basis = spline_basis(F.col(t).cast("double"), knots)
    k = len(basis)
    aggs = [F.sum(basis[i] * basis[j]).alias(f"xx_{i}_{j}") for i in range(k) for j in range(i, k)]
    aggs += [F.sum(basis[i] * F.col(y)).alias(f"xy_{i}") for i in range(k)]
    names = [f"xx_{i}_{j}" for i in range(k) for j in range(i, k)] + [f"xy_{i}" for i in range(k)]
    return d.agg(*aggs).unpivot([], names, "moment", "value")


def trend(df: DataFrame, t: str, y: str, knots: Sequence[float] = SPLINE_KNOTS, by: Sequence[str] = ()) -> DataFrame:
    """S9 (re-aimed): cubic regression spline of y on t with fixed knots.
    X'X and X'y come from one Spark aggregate; the k x k solve is on the driver;
    fitted values are a column expression over the distinct whole times."""
    import numpy as np
    d = df.filter(F.col(t).isNotNull() & F.col(y).isNotNull())
    tc = F.col(t).cast("double")
    basis = spline_basis(tc, knots)
    k = len(basis)
    aggs = [F.sum(basis[i] * basis[j]).alias(f"xx_{i}_{j}") for i in range(k) for j in range(i, k)]
    aggs += [F.sum(basis[i] * F.col(y)).alias(f"xy_{i}") for i in range(k)]
    row = d.agg(*aggs).collect()[0]
    xx = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = row[f"xx_{i}_{j}"] or 0.0
    xy = np.array([row[f"xy_{i}"] or 0.0 for i in range(k)])
    beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
    grid = d.select(F.floor(tc).cast("double").alias("t")).distinct()
    fit = sum((F.lit(float(b)) * e for b, e in zip(beta, spline_basis(F.col("t"), knots))), F.lit(0.0))
    return grid.select("t", fit.alias("fit"))
