"""Registered queries: description and aggregation (A*, R1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort, describe, periods
from ..sources.person_period import person_periods
from .registry import r6, register, sql_r6
from .sql import with_ctes

S = periods.PP


def _locf(spark, sf):
    return cohort.locf(person_periods(spark, sf), S)


def _q7(col, p):
    return f"quantile_cont({col}, {p})"


@register("describe_quantiles", with_ctes(
    "SELECT " + ", ".join(sql_r6(_q7("f", p), n) for p, n in
                         [(0.0, "min"), (0.25, "q25"), (0.5, "median"), (0.75, "q75"), (1.0, "max")])
    + " FROM (SELECT id, sum(b_stop - b_start) AS f FROM pp GROUP BY id)", "pp"))
def q_describe_quantiles(spark, sf):
    """A1 on per-subject follow-up (P13): min, quartiles, max; exact, type-7 rule."""
    f = periods.followup(person_periods(spark, sf), S, "b_start", "b_stop")
    q = describe.describe_quantiles(f, "followup")
    return q.select(*[r6(c) for c in ("min", "q25", "median", "q75", "max")])


_PCTS = [1, 5, 10, 25, 50, 75, 90, 95, 99]


def _stata_sql(p: int) -> str:
    return (f"(max(CASE WHEN rn = CASE WHEN n * {p} % 100 = 0 THEN n * {p} // 100 ELSE (n * {p} + 99) // 100 END THEN x END)"
            f" + max(CASE WHEN rn = CASE WHEN n * {p} % 100 = 0 THEN least(n * {p} // 100 + 1, n) ELSE (n * {p} + 99) // 100 END"
            " THEN x END)) / 2")


_DETAIL_SQL = with_ctes(
    "SELECT count(*) AS n, " + sql_r6("avg(x)", "mean") + ", " + sql_r6("stddev_samp(x)", "sd") + ", "
    + sql_r6("var_samp(x)", "variance") + ", "
    + sql_r6("avg(power(x - mu, 3)) / power(avg(power(x - mu, 2)), 1.5)", "skewness") + ", "
    + sql_r6("avg(power(x - mu, 4)) / power(avg(power(x - mu, 2)), 2)", "kurtosis") + ", "
    + ", ".join(sql_r6(_stata_sql(p), f"p{p}") for p in _PCTS) + ", "
    + ", ".join(sql_r6(f"max(CASE WHEN rn = {k} THEN x END)", f"smallest_{k}") for k in (1, 2, 3, 4)) + ", "
    + ", ".join(sql_r6(f"max(CASE WHEN rn = n - {k - 1} THEN x END)", f"largest_{k}") for k in (1, 2, 3, 4))
    + " FROM (SELECT x, row_number() OVER (ORDER BY x) AS rn, count(*) OVER () AS n, avg(x) OVER () AS mu "
      "FROM (SELECT t_stop AS x FROM locf))", "locf")


@register("summarize_detail", _DETAIL_SQL)
def q_summarize_detail(spark, sf):
    """A6 on exit times of the LOCF set (Stata 'summarize, detail')."""
    d = describe.summarize_detail(_locf(spark, sf), "t_stop")
    cols = ["mean", "sd", "variance", "skewness", "kurtosis", *[f"p{p}" for p in _PCTS],
            *[f"smallest_{k}" for k in (1, 2, 3, 4)], *[f"largest_{k}" for k in (1, 2, 3, 4)]]
    return d.select("n", *[r6(c) for c in cols])


@register("crosstab_pct", with_ctes(
    "SELECT outcome, sbp_group, n, " + sql_r6("100.0 * n / sum(n) OVER (PARTITION BY sbp_group)", "col_pct")
    + " FROM (SELECT outcome, sbp_group, count(*) AS n FROM locf GROUP BY outcome, sbp_group)", "locf"))
def q_crosstab_pct(spark, sf):
    """A5: outcome by blood-pressure group with column percents."""
    c = describe.crosstab(_locf(spark, sf), "outcome", "sbp_group")
    return c.select("outcome", "sbp_group", "n", r6("col_pct"))


@register("person_years", with_ctes(
    "SELECT sbp_group, " + sql_r6("sum(t_stop - t_start)", "person_time")
    + ", CAST(sum(outcome) AS BIGINT) AS events, count(*) AS records, "
    + sql_r6("sum(outcome) / sum(t_stop - t_start)", "rate") + " FROM locf GROUP BY sbp_group", "locf"))
def q_person_years(spark, sf):
    """A2: person-time, events, records, rate per group."""
    p = describe.person_years(_locf(spark, sf), "t_start", "t_stop", "outcome", ["sbp_group"])
    return p.select("sbp_group", r6("person_time"), "events", "records", r6("rate"))


@register("event_share", with_ctes(
    "SELECT count(*) AS subjects, CAST(sum(outcome) AS BIGINT) AS events, " + sql_r6("avg(outcome)", "share")
    + " FROM (SELECT *, max(visit) OVER (PARTITION BY id) AS lv FROM locf) WHERE visit = lv", "locf"))
def q_event_share(spark, sf):
    """A3: share of subjects ending follow-up with the event (P11 + mean)."""
    last = periods.last_row(_locf(spark, sf), S)
    e = describe.event_share(last, "outcome")
    return e.select("subjects", "events", r6("share"))


@register("missing_report", with_ctes(
    "SELECT count_if(outcome IS NULL) AS rows_missing, count(DISTINCT CASE WHEN outcome IS NULL THEN id END) "
    "AS subjects_missing, count(DISTINCT id) AS subjects, count(*) AS rows, "
    "(SELECT count_if(outcome IS NULL) FROM (SELECT *, max(visit) OVER (PARTITION BY id) AS lv FROM o4) WHERE visit = lv) "
    "AS last_row_missing FROM o4", "o4"))
def q_missing_report(spark, sf):
    """Missing outcome rows, subjects, subjects missing at their last row."""
    d = cohort.outcome_periods(person_periods(spark, sf), S)
    last = periods.last_row(d, S)
    return describe.missing_report(d, "outcome", last)


@register("band", with_ctes(
    "SELECT name, " + sql_r6("quantile_cont(value, 0.05)", "lo") + ", " + sql_r6("quantile_cont(value, 0.95)", "hi")
    + " FROM (UNPIVOT (SELECT measure, sbp, CAST(dbp AS DOUBLE) AS dbp FROM pp) ON measure, sbp, dbp "
      "INTO NAME name VALUE value) WHERE value IS NOT NULL GROUP BY name", "pp"))
def q_band(spark, sf):
    """5 %/95 % quantiles of several columns in one blocked pass."""
    pp = person_periods(spark, sf).select("measure", "sbp", F.col("dbp").cast("double").alias("dbp"))
    b = describe.band(pp, ["measure", "sbp", "dbp"])
    return b.select("name", r6("lo"), r6("hi"))


@register("unpivot_long", with_ctes(
    "SELECT id, metric, " + sql_r6("value", "value") + " FROM (UNPIVOT (SELECT id, min(t_start) AS entry, "
    "max(t_stop) AS exit, sum(b_stop - b_start) AS followup FROM pp GROUP BY id) ON entry, exit, followup "
    "INTO NAME metric VALUE value)", "pp"))
def q_unpivot_long(spark, sf):
    """Per-subject summary, wide -> long."""
    w = person_periods(spark, sf).groupBy("id").agg(
        F.min("t_start").alias("entry"), F.max("t_stop").alias("exit"),
        F.sum(F.col("b_stop") - F.col("b_start")).alias("followup"))
    return describe.unpivot(w, ["id"], ["entry", "exit", "followup"], "metric", "value") \
        .select("id", "metric", r6("value"))



@register("crosstab_wide", with_ctes(
    "SELECT outcome, " + ", ".join(f"CAST(count_if(sbp_group = {k}) AS BIGINT) AS sbp_group_{k}" for k in (1, 2, 3, 4))
    + " FROM locf GROUP BY outcome", "locf"))
def q_crosstab_wide(spark, sf):
    """A5 in wide form: outcome by blood-pressure group, one count column per group."""
    return describe.crosstab_wide(_locf(spark, sf), "outcome", "sbp_group", [1, 2, 3, 4])
