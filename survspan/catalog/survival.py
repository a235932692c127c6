"""Registered queries: survival set-up and Kaplan-Meier family (S*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort, periods, survival
from ..sources.person_period import person_periods
from .registry import r6, register, sql_r6
from .sql import with_ctes

S = periods.PP
SPEC = survival.SurvSpec("t_start", "t_stop", "outcome")
GRID = [5.0, 10.0, 15.0, 20.0, 25.0, 30.0]
RISK_GRID = [0.0, 5.0, 10.0, 15.0, 20.0, 25.0, 30.0]


def _locf(spark, sf):
    return cohort.locf(person_periods(spark, sf), S)


def _tt_sql(src: str, g: str, start: str = "t_start", stop: str = "t_stop", event: str = "outcome") -> list[str]:
    """Time table + KM cumulative sums as DuckDB CTEs (plain windows)."""
    valid = f"{stop} IS NOT NULL AND {start} IS NOT NULL AND {stop} > {start}"
    w = "WINDOW w AS (PARTITION BY g ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return [
        f"""tt0 AS (SELECT g, time, sum(n_entry) AS n_entry, sum(n_exit) AS n_exit, sum(n_event) AS n_event FROM (
            SELECT {g} AS g, CAST({start} AS DOUBLE) AS time, 1 AS n_entry, 0 AS n_exit, 0 AS n_event FROM {src} WHERE {valid}
            UNION ALL
            SELECT {g} AS g, CAST({stop} AS DOUBLE) AS time, 0, 1,
                   CASE WHEN {event} IS NOT NULL AND {event} <> 0 THEN 1 ELSE 0 END FROM {src} WHERE {valid})
            GROUP BY g, time)""",
        f"""tt AS (SELECT *, sum(n_entry) OVER w - n_entry - (sum(n_exit) OVER w - n_exit) AS n_risk,
            sum(n_entry) OVER w - sum(n_exit) OVER w AS cum_net FROM tt0 {w})""",
        f"""km0 AS (SELECT *,
            sum(CASE WHEN n_event > 0 AND n_event < n_risk THEN ln(1 - n_event / n_risk) ELSE 0 END) OVER w AS slg,
            sum(CASE WHEN n_event > 0 AND n_event >= n_risk THEN 1 ELSE 0 END) OVER w AS sz,
            sum(CASE WHEN n_event > 0 AND n_event < n_risk THEN n_event / (n_risk * (n_risk - n_event)) ELSE 0 END) OVER w AS sgw,
            sum(n_event) OVER w AS cum_event FROM tt {w})""",
        f"""km AS (SELECT *, CASE WHEN sz > 0 THEN 0.0 ELSE exp(slg) END AS surv,
            CASE WHEN sz > 0 THEN 0.0 ELSE exp(slg) END * sqrt(sgw) AS std_err,
            CASE WHEN sz > 0 THEN NULL ELSE exp(slg - {survival.Z975} * sqrt(sgw)) END AS lower,
            CASE WHEN sz > 0 THEN NULL ELSE least(1.0, exp(slg + {survival.Z975} * sqrt(sgw))) END AS upper,
            0.0 - slg AS cumhaz FROM km0)""",
    ]


_KM_SEL = ("time, CAST(n_risk AS BIGINT) AS n_risk, CAST(n_event AS BIGINT) AS n_event, "
           "CAST(n_exit - n_event AS BIGINT) AS n_censor, " + ", ".join(
               sql_r6(c, c) for c in ("surv", "std_err", "lower", "upper")))


def _km_cols(df, by):
    return df.select(*by, "time", F.col("n_risk").cast("long"), F.col("n_event").cast("long"),
                     F.col("n_censor").cast("long"), *[r6(c) for c in ("surv", "std_err", "lower", "upper")])


@register("surv_set", with_ctes(
    "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN t_stop IS NULL THEN 'missing exit' WHEN t_start IS NULL "
    "THEN 'missing entry' WHEN t_stop <= t_start THEN 'exit <= entry' ELSE 'ok' END AS reason FROM o4) GROUP BY reason",
    "o4"))
def q_surv_set(spark, sf):
    """Rows set aside by reason (outcome periods, calendar clock)."""
    d = cohort.outcome_periods(person_periods(spark, sf), S)
    _, report = survival.surv_set(d, SPEC)
    return report


@register("risk_sets", with_ctes(
    "SELECT g AS sbp_group, time, CAST(n_entry AS BIGINT) AS n_entry, CAST(n_exit AS BIGINT) AS n_exit, "
    "CAST(n_event AS BIGINT) AS n_event, CAST(n_risk AS BIGINT) AS n_risk FROM tt", "locf",
    extra=_tt_sql("locf", "sbp_group")[:2]))
def q_risk_sets(spark, sf):
    """Delayed-entry risk sets at every distinct time, by group (start < t <= stop)."""
    t = survival.time_table(_locf(spark, sf), SPEC, ["sbp_group"])
    return t.select("sbp_group", "time", *[F.col(c).cast("long") for c in ("n_entry", "n_exit", "n_event", "n_risk")])


@register("km", with_ctes(f"SELECT {_KM_SEL} FROM km WHERE n_exit > 0", "locf",
                          extra=_tt_sql("locf", "1")))
def q_km(spark, sf):
    """S3: overall Kaplan-Meier with Greenwood se and log-scale 95 % CI."""
    return _km_cols(survival.kaplan_meier(_locf(spark, sf), SPEC), [])


@register("km_by", with_ctes(f"SELECT g AS sbp_group, {_KM_SEL} FROM km WHERE n_exit > 0", "locf",
                             extra=_tt_sql("locf", "sbp_group")))
def q_km_by(spark, sf):
    """S3 by blood-pressure group."""
    return _km_cols(survival.kaplan_meier(_locf(spark, sf), SPEC, ["sbp_group"]), ["sbp_group"])


def _at_sql(grid, risk: bool = False, by: bool = True) -> str:
    vals = ", ".join(f"({t})" for t in grid)
    gsel = "grid.g AS sbp_group, " if by else ""
    s = "COALESCE(km.surv, 1.0)"
    lo = "CASE WHEN km.time IS NULL THEN 1.0 ELSE km.lower END"
    hi = "CASE WHEN km.time IS NULL THEN 1.0 ELSE km.upper END"
    if risk:
        vals_sel = f"{sql_r6('1 - ' + s, 'risk')}, {sql_r6('1 - ' + hi, 'lower')}, {sql_r6('1 - ' + lo, 'upper')}"
    else:
        vals_sel = f"{sql_r6(s, 'surv')}, {sql_r6(lo, 'lower')}, {sql_r6(hi, 'upper')}"
    return (f"SELECT {gsel}grid.time AS time, CAST(COALESCE(CASE WHEN km.time = grid.time THEN km.n_risk ELSE km.cum_net END, 0) "
            f"AS BIGINT) AS n_risk, CAST(COALESCE(km.cum_event, 0) AS BIGINT) AS cum_event, {vals_sel} "
            f"FROM (SELECT g, CAST(t AS DOUBLE) AS time FROM (SELECT DISTINCT g FROM tt0) CROSS JOIN (VALUES {vals}) v(t)) grid "
            "ASOF LEFT JOIN km ON grid.g = km.g AND grid.time >= km.time")


@register("km_at", with_ctes(_at_sql(GRID), "locf", extra=_tt_sql("locf", "sbp_group")))
def q_km_at(spark, sf):
    """Survival with CI and number at risk at 5, 10, ..., 30 by group (as-of lookup)."""
    k = survival.km_at(_locf(spark, sf), SPEC, GRID, ["sbp_group"])
    return k.select("sbp_group", "time", "n_risk", "cum_event", r6("surv"), r6("lower"), r6("upper"))


@register("km_risk_at", with_ctes(_at_sql(GRID, risk=True, by=False), "locf",
                                  extra=_tt_sql("locf", "1", "b_start", "b_stop")))
def q_km_risk_at(spark, sf):
    """S4 reverse: cumulative risk 1-S at 5..30 on the time-from-baseline clock, overall."""
    spec = survival.SurvSpec("b_start", "b_stop", "outcome")
    k = survival.km_at(_locf(spark, sf), spec, GRID, [], reverse=True)
    return k.select("time", "n_risk", "cum_event", r6("risk"), r6("lower"), r6("upper"))


@register("risk_table", with_ctes(
    "SELECT grid.g AS sbp_group, grid.time AS time, CAST(COALESCE(CASE WHEN km.time = grid.time THEN km.n_risk "
    "ELSE km.cum_net END, 0) AS BIGINT) AS n_risk, CAST(COALESCE(km.cum_event, 0) AS BIGINT) AS cum_event "
    "FROM (SELECT g, CAST(t AS DOUBLE) AS time FROM (SELECT DISTINCT g FROM tt0) CROSS JOIN (VALUES "
    + ", ".join(f"({t})" for t in RISK_GRID) + ") v(t)) grid ASOF LEFT JOIN km ON grid.g = km.g AND grid.time >= km.time",
    "locf", extra=_tt_sql("locf", "sbp_group")))
def q_risk_table(spark, sf):
    """Number at risk and events so far at 0, 5, ..., 30 by group."""
    k = survival.km_at(_locf(spark, sf), SPEC, RISK_GRID, ["sbp_group"])
    return k.select("sbp_group", "time", "n_risk", "cum_event")


_KMS_EV = ("kev AS (SELECT *, sum(piece) OVER (PARTITION BY g ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
           "AS carea, CASE WHEN n_risk > n_event THEN n_event / (n_risk * (n_risk - n_event)) ELSE 0.0 END AS wv FROM ("
           "SELECT *, COALESCE(lag(surv) OVER (PARTITION BY g ORDER BY time), 1.0) * "
           "(time - COALESCE(lag(time) OVER (PARTITION BY g ORDER BY time), 0.0)) AS piece FROM km WHERE n_event > 0))")
_KMS_B = ("kb AS (SELECT g, sum(piece) AS area, max(time) AS tl, arg_max(surv, time) AS s_last, arg_min(n_risk, time) AS n_start, "
          "min(CASE WHEN surv <= 0.5 THEN time END) AS median, min(CASE WHEN COALESCE(lower, 0.0) <= 0.5 THEN time END) AS median_lcl, "
          "min(CASE WHEN upper <= 0.5 THEN time END) AS median_ucl, sum(wv) AS sw, sum(wv * carea) AS swc, "
          "sum(wv * carea * carea) AS swcc FROM kev GROUP BY g)")
_KMS_R = ("kr AS (SELECT a.g, a.records, a.events, a.n_max, b.n_start, b.median, b.median_lcl, b.median_ucl, b.sw, b.swc, b.swcc, "
          "COALESCE(b.area, 0) + COALESCE(b.s_last, 1.0) * ((SELECT max(time) FROM tt0) - COALESCE(b.tl, 0)) AS rmean "
          "FROM (SELECT g, sum(n_exit) AS records, sum(n_event) AS events, max(n_risk) AS n_max FROM km GROUP BY g) a "
          "LEFT JOIN kb b ON a.g = b.g)")


@register("km_summary", with_ctes(
    "SELECT g AS sbp_group, CAST(records AS BIGINT) AS records, CAST(events AS BIGINT) AS events, "
    "CAST(n_max AS BIGINT) AS n_max, CAST(n_start AS BIGINT) AS n_start, " + sql_r6("rmean", "rmean") + ", "
    + sql_r6("sqrt(greatest(rmean * rmean * COALESCE(sw, 0.0) - 2 * rmean * COALESCE(swc, 0.0) + COALESCE(swcc, 0.0), 0.0))",
             "se_rmean")
    + ", median, median_lcl, median_ucl FROM kr", "locf", extra=_tt_sql("locf", "sbp_group") + [_KMS_EV, _KMS_B, _KMS_R]))
def q_km_summary(spark, sf):
    """Per-group curve summary (records, events, n at risk, restricted mean, median)."""
    k = survival.km_summary(_locf(spark, sf), SPEC, ["sbp_group"])
    return k.select("sbp_group", F.col("records").cast("long"), F.col("events").cast("long"),
                    F.col("n_max").cast("long"), F.col("n_start").cast("long"), r6("rmean"), r6("se_rmean"),
                    "median", "median_lcl", "median_ucl")


@register("km_cumhaz", with_ctes(
    "SELECT g AS sbp_group, time, " + sql_r6("CASE WHEN surv > 0 THEN 0.0 - ln(surv) END", "value")
    + " FROM km WHERE n_exit > 0", "locf", extra=_tt_sql("locf", "sbp_group")))
def q_km_cumhaz(spark, sf):
    """Cumulative hazard -ln S by group."""
    k = survival.km_transform(survival.kaplan_meier(_locf(spark, sf), SPEC, ["sbp_group"]), "cumhaz")
    return k.select("sbp_group", "time", r6("value"))


@register("km_cloglog", with_ctes(
    "SELECT g AS sbp_group, " + sql_r6("CASE WHEN time > 0 THEN ln(time) END", "log_time") + ", "
    + sql_r6("CASE WHEN surv > 0 AND surv < 1 THEN ln(-ln(surv)) END", "value")
    + " FROM km WHERE n_exit > 0", "locf", extra=_tt_sql("locf", "sbp_group")))
def q_km_cloglog(spark, sf):
    """ln(-ln S) against ln t by group."""
    k = survival.km_transform(survival.kaplan_meier(_locf(spark, sf), SPEC, ["sbp_group"]), "cloglog")
    return k.select("sbp_group", r6("log_time"), r6("value"))


@register("km_event", with_ctes(
    "SELECT g AS sbp_group, time, " + sql_r6("1 - surv", "value") + " FROM km WHERE n_exit > 0", "locf",
    extra=_tt_sql("locf", "sbp_group")))
def q_km_event(spark, sf):
    """Cumulative incidence 1-S by group."""
    k = survival.km_transform(survival.kaplan_meier(_locf(spark, sf), SPEC, ["sbp_group"]), "event")
    return k.select("sbp_group", "time", r6("value"))


@register("trajectories", with_ctes(
    "SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY visit) AS INT) AS seq, t_stop AS t, sbp AS y "
    "FROM pp WHERE sbp IS NOT NULL", "pp"))
def q_trajectories(spark, sf):
    """Per-subject ordered (time, measure) rows."""
    return survival.trajectories(person_periods(spark, sf), "id", ["visit"], "t_stop", "sbp")


@register("trend")
def q_trend(spark, sf):
    """Cubic regression spline of the measure against time (fixed knots)."""
    t = survival.trend(person_periods(spark, sf), "t_stop", "sbp")
    return t.select("t", r6("fit"))


@register("pp_orders", with_ctes("SELECT * FROM ppo", "ppo"))
def q_pp_orders(spark, sf):
    """Second source: person-periods of consecutive orders per customer (ties on the
    order date broken by order key)."""
    from ..sources.person_period import orders_person_periods, read_table
    d = orders_person_periods(read_table(spark, sf, "orders"))
    return d.select("id", "visit", "t_start", "t_stop", "b_start", "b_stop", "status", "measure")


@register("km_orders", with_ctes(f"SELECT {_KM_SEL} FROM km WHERE n_exit > 0", "ppo",
                                 extra=_tt_sql("ppo", "1", "b_start", "b_stop", "status")))
def q_km_orders(spark, sf):
    """S3 on the orders source: time from a customer's first order to the next fulfilled order."""
    from ..sources.person_period import orders_person_periods, read_table
    d = orders_person_periods(read_table(spark, sf, "orders"))
    return _km_cols(survival.kaplan_meier(d, survival.SurvSpec("b_start", "b_stop", "status")), [])


_SPLINE_SQL = with_ctes("SELECT moment, round(v / scale, 6) AS value FROM (SELECT 'xx_0_0' AS moment, sum((1.0) * (1.0)) AS v FROM b UNION ALL SELECT 'xx_0_1' AS moment, sum((1.0) * (t)) AS v FROM b UNION ALL SELECT 'xx_0_2' AS moment, sum((1.0) * (t * t)) AS v FROM b UNION ALL SELECT 'xx_0_3' AS moment, sum((1.0) * (t * t * t)) AS v FROM b UNION ALL SELECT 'xx_0_4' AS moment, sum((1.0) * (power(greatest(t - 0.25, 0.0), 3))) AS v FROM b UNION ALL SELECT 'xx_0_5' AS moment, sum((1.0) * (power(greatest(t - 0.5, 0.0), 3))) AS v FROM b UNION ALL SELECT 'xx_0_6' AS moment, sum((1.0) * (power(greatest(t - 0.75, 0.0), 3))) AS v FROM b UNION ALL SELECT 'xx_1_1' AS moment, sum((t) * (t)) AS v FROM b UNION ALL SELECT 'xx_1_2' AS moment, sum((t) * (t * t)) AS v FROM b UNION ALL SELECT 'xx_1_3' AS moment, sum((t) * (t * t * t)) AS v FROM b UNION ALL SELECT 'xx_1_4' AS moment, sum((t) * (power(greatest(t - 0.25, 0.0), 3))) AS v FROM b UNION ALL SELECT 'xx_1_5' AS moment, sum((t) * (power(greatest(t - 0.5, 0.0), 3))) AS v FROM b UNION ALL SELECT 'xx_1_6' AS moment, sum((t) * (power(greatest(t - 0.75, 0.0), 3))) AS v FROM b UNION ALL SELECT 'xx_2_2' AS moment, sum((t * t) * (t * t)) AS v FROM b UNION ALL SELECT 'xx_2_3' AS moment, sum((t * t) * (t * t * t)) AS v FROM b UNION ALL SELECT 'xx_2_4' AS moment, sum((t * t) * (power(greatest(t - 0.25, 0.0), 3))) AS v FROM b UNION ALL SELECT 'xx_2_5' AS moment, sum((t * t) * (power(greatest(t - 0.5, 0.0), 3))) AS v FROM b UNION ALL SELECT 'xx_2_6' AS moment, sum((t * t) * (power(greatest(t - 0.75, 0.0), 3))) AS v FROM b UNION ALL SELECT 'xx_3_3' AS moment, sum((t * t * t) * (t * t * t)) AS v FROM b UNION ALL SELECT 'xx_3_4' AS moment, sum((t * t * t) * (power(greatest(t - 0.25, 0.0), 3))) AS v FROM b UNION ALL SELECT 'xx_3_5' AS moment, sum((t * t * t) * (power(greatest(t - 0.5, 0.0), 3))) AS v FROM b UNION ALL SELECT 'xx_3_6' AS moment, sum((t * t * t) * (power(greatest(t - 0.75, 0.0), 3))) AS v FROM b UNION ALL SELECT 'xx_4_4' AS moment, sum((power(greatest(t - 0.25, 0.0), 3)) * (power(greatest(t - 0.25, 0.0), 3))) AS v FROM b UNION ALL SELECT 'xx_4_5' AS moment, sum((power(greatest(t - 0.25, 0.0), 3)) * (power(greatest(t - 0.5, 0.0), 3))) AS v FROM b UNION ALL SELECT 'xx_4_6' AS moment, sum((power(greatest(t - 0.25, 0.0), 3)) * (power(greatest(t - 0.75, 0.0), 3))) AS v FROM b UNION ALL SELECT 'xx_5_5' AS moment, sum((power(greatest(t - 0.5, 0.0), 3)) * (power(greatest(t - 0.5, 0.0), 3))) AS v FROM b UNION ALL SELECT 'xx_5_6' AS moment, sum((power(greatest(t - 0.5, 0.0), 3)) * (power(greatest(t - 0.75, 0.0), 3))) AS v FROM b UNION ALL SELECT 'xx_6_6' AS moment, sum((power(greatest(t - 0.75, 0.0), 3)) * (power(greatest(t - 0.75, 0.0), 3))) AS v FROM b UNION ALL SELECT 'xy_0' AS moment, sum((1.0) * y) AS v FROM b UNION ALL SELECT 'xy_1' AS moment, sum((t) * y) AS v FROM b UNION ALL SELECT 'xy_2' AS moment, sum((t * t) * y) AS v FROM b UNION ALL SELECT 'xy_3' AS moment, sum((t * t * t) * y) AS v FROM b UNION ALL SELECT 'xy_4' AS moment, sum((power(greatest(t - 0.25, 0.0), 3)) * y) AS v FROM b UNION ALL SELECT 'xy_5' AS moment, sum((power(greatest(t - 0.5, 0.0), 3)) * y) AS v FROM b UNION ALL SELECT 'xy_6' AS moment, sum((power(greatest(t - 0.75, 0.0), 3)) * y) AS v FROM b) JOIN (SELECT 1.0 AS scale) ON TRUE", "pp",
                        extra=["b AS (SELECT CAST(t_stop AS DOUBLE) / 30.0 AS t, sbp AS y FROM pp WHERE t_stop IS NOT NULL AND sbp IS NOT NULL)"])


@register("trend_moments", _SPLINE_SQL)
def q_trend_moments(spark, sf):
    """X'X and X'y of the fixed-knot cubic spline basis (one distributed aggregate;
    the k x k solve of ``trend`` uses exactly these sums)."""
    m = survival.spline_moments(person_periods(spark, sf), "t_stop", "sbp")
    return m.select("moment", F.round("value", 6).alias("value"))
