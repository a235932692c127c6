"""Registered queries: AFT (M*), Cox (X*) and inference (I*) on the LOCF set."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import aft, clean, cohort, cox, infer, periods, survival
from ..plans.likelihood import CONS, evaluate
from ..plans.risksets import risk_sets, risk_stats
from ..plans.scan import materialize
from ..sources.person_period import person_periods
from .registry import r6, register, sql_r6
from .sql import with_ctes

S = periods.PP
SPEC = survival.SurvSpec("t_start", "t_stop", "outcome")
GROUPS = ["sbp_group2", "sbp_group3", "sbp_group4"]
ADJUST = GROUPS + ["race_recode2", "race_recode3", "lbw", "income_recode2", "income_recode3", "income_recode4"]
RACES = ["race_recode2", "race_recode3"]  # identified at every size of the data
# Fixed values of the reference: group-1 Weibull parameters of the crude final model,
# used to evaluate the likelihood at a known point, and the time-varying cut 16.
WEIBULL_MU, WEIBULL_SIGMA = 3.262489, 0.5965208
TVC_CUT = 16.0

_FITS: dict = {}


def design_frame(spark, sf):
    d = cohort.survival_design(cohort.locf(person_periods(spark, sf), S))
    d = clean.dummies(d, "race_recode", [2, 3], prefix="race_recode")
    d = clean.dummies(d, "income_recode", [2, 3, 4], prefix="income_recode")
    return d


def fit_frame(spark, sf):
    """The columns of design_frame that fits and their replicates read, prepared once for all of them."""
    return _memo(spark, sf, "fit_frame", lambda: materialize(design_frame(spark, sf).select(
        "id", "visit", "t_start", "t_stop", "outcome", "sbp_group", *ADJUST)))


def _memo(spark, sf, key, fn):
    k = (spark.sparkContext.applicationId, sf, key)
    if k not in _FITS:
        _FITS[k] = fn()
    return _FITS[k]


def fit_named(spark, sf, key: str):
    """All fitted models of the reference's analysis, by name (memoised per application)."""
    def make():
        d = fit_frame(spark, sf)
        if key == "weibull_crude":
            return aft.aft(d, SPEC, GROUPS, "weibull", name=key)
        if key == "weibull_adjusted":
            return aft.aft(d, SPEC, ADJUST, "weibull", name=key)
        if key == "lognormal_crude":
            return aft.aft(d, SPEC, GROUPS, "lognormal", name=key)
        if key == "gg_null":
            return aft.aft_ggamma(d, SPEC, [], name=key)
        if key == "gg_crude":
            return aft.aft_ggamma(d, SPEC, GROUPS, name=key)
        if key == "gg_adjusted":
            return aft.aft_ggamma(d, SPEC, ADJUST, name=key)
        if key == "gg_saturated":
            return aft.aft_ggamma(d, SPEC, GROUPS, lnsigma=GROUPS, kappa=GROUPS, name=key)
        if key == "weibull_race":
            return aft.aft(d, SPEC, RACES, "weibull", name=key)
        if key == "gg_race":
            return aft.aft_ggamma(d, SPEC, RACES, name=key, prepared=True)
        if key == "gg_race_saturated":
            return aft.aft_ggamma(d, SPEC, RACES, lnsigma=RACES, kappa=RACES, name=key, prepared=True)
        if key == "cox_race":
            return cox.cox(d, SPEC, RACES, name=key)
        if key == "ammag_crude":
            return aft.aft(d, SPEC, GROUPS, "ammag", name=key)
        if key == "gamma_crude":
            return aft.aft(d, SPEC, GROUPS, "gamma", name=key)
        if key == "ammag_adjusted":
            return aft.aft(d, SPEC, ADJUST, "ammag", name=key)
        if key == "gamma_adjusted":
            return aft.aft(d, SPEC, ADJUST, "gamma", name=key)
        if key == "cox_crude":
            return cox.cox(d, SPEC, GROUPS, name=key)
        if key == "cox_efron":
            return cox.cox(d, SPEC, GROUPS, ties="efron", name=key)
        if key == "cox_adjusted":
            return cox.cox(d, SPEC, ADJUST, name=key)
        if key == "cox_trend":
            return cox.cox(d, SPEC, ["sbp_group"], name=key)
        if key == "cox_tvc":
            return cox.cox_tvc(d, SPEC, GROUPS, GROUPS, texp_cut, name=key)
        if key == "gg_by_group":
            return aft.aft_by(d, SPEC, "sbp_group", "ggamma")
        raise KeyError(key)
    return _memo(spark, sf, key, make)


def texp_cut(t):
    """Time function of the time-varying coefficients: (t - 16) * [t <= 16]."""
    return (t - F.lit(TVC_CUT)) * (t <= F.lit(TVC_CUT)).cast("double")


def _coef_table(spark, sf, keys, exponentiate=False):
    fits = infer.fits_table(spark, [fit_named(spark, sf, k) for k in keys])
    c = infer.coef_long(fits, exponentiate)
    return c.select("model", "equation", "term", *[r6(x) for x in ("coef", "se", "z", "p", "lo", "hi")])


# ------------------------------------------------------------------ AFT
_WLL = (f"SELECT {sql_r6('sum(ll)', 'loglik')}, {sql_r6('sum(ll) + sum(CASE WHEN outcome = 1 THEN ln(t_stop) ELSE 0 END)', 'loglik_logtime')}, "
        "count(*) AS n, CAST(sum(outcome) AS BIGINT) AS events FROM ("
        f"SELECT t_stop, outcome, (CASE WHEN outcome = 1 THEN -ln({WEIBULL_SIGMA}) - ln(t_stop) + w ELSE 0 END) - exp(w) "
        "+ CASE WHEN t_start > 0 THEN exp(w0) ELSE 0 END AS ll FROM ("
        f"SELECT *, (ln(t_stop) - {WEIBULL_MU}) / {WEIBULL_SIGMA} AS w, "
        f"CASE WHEN t_start > 0 THEN (ln(t_start) - {WEIBULL_MU}) / {WEIBULL_SIGMA} END AS w0 FROM locf "
        "WHERE t_stop > t_start))")


@register("weibull_loglik", with_ctes(_WLL, "locf"))
def q_weibull_loglik(spark, sf):
    """M9: the distributed row log-likelihood (delayed entry) of a Weibull at fixed parameters."""
    d = cohort.locf(person_periods(spark, sf), S)
    design = aft.model_frame(d, SPEC, [])
    eqs = [("mu", [CONS]), ("lnsigma", [CONS])]
    ll, _, _ = evaluate(design, aft.family_model("weibull"), eqs, np.array([WEIBULL_MU, np.log(WEIBULL_SIGMA)]))
    st = design.agg(F.count(F.lit(1)).alias("n"), F.sum("d").cast("long").alias("events"),
                    F.sum(F.col("d") * F.log("t")).alias("slt"))
    return st.select(F.round(F.lit(float(ll)), 6).alias("loglik"),
                     F.round(F.lit(float(ll)) + F.col("slt"), 6).alias("loglik_logtime"), "n", "events")


@register("aft_weibull")
def q_aft_weibull(spark, sf):
    """M1: crude Weibull AFT (time coefficients)."""
    return _coef_table(spark, sf, ["weibull_crude"])


@register("aft_weibull_adjusted")
def q_aft_weibull_adjusted(spark, sf):
    """M1: adjusted Weibull AFT (groups + race, lbw, income classes)."""
    return _coef_table(spark, sf, ["weibull_adjusted"])


@register("aft_weibull_ratios")
def q_aft_weibull_ratios(spark, sf):
    """M8: Weibull hazard ratios exp(-b/sigma) and time ratios exp(b) from one fit."""
    fits = infer.fits_table(spark, [fit_named(spark, sf, "weibull_crude")])
    return infer.hazard_ratio_weibull(fits).select("model", "term", r6("hazard_ratio"), r6("time_ratio"))


@register("aft_lognormal")
def q_aft_lognormal(spark, sf):
    """Lognormal AFT (the GG at kappa = 0)."""
    return _coef_table(spark, sf, ["lognormal_crude"])


@register("aft_ggamma")
def q_aft_ggamma(spark, sf):
    """M2: conventional generalized gamma, intercept-only and crude."""
    return _coef_table(spark, sf, ["gg_null", "gg_crude"])


@register("aft_ggamma_adjusted")
def q_aft_ggamma_adjusted(spark, sf):
    """M2: conventional generalized gamma, adjusted."""
    return _coef_table(spark, sf, ["gg_adjusted"])


@register("aft_saturated")
def q_aft_saturated(spark, sf):
    """M3: saturated GG: ln sigma and kappa also linear in the group dummies."""
    return _coef_table(spark, sf, ["gg_saturated"])


@register("aft_ammag")
def q_aft_ammag(spark, sf):
    """M4: constrained GG with kappa = 1/sigma."""
    return _coef_table(spark, sf, ["ammag_crude"])


@register("aft_gamma")
def q_aft_gamma(spark, sf):
    """M5: constrained GG with kappa = sigma (standard gamma)."""
    return _coef_table(spark, sf, ["gamma_crude"])


@register("aft_constrained_adjusted")
def q_aft_constrained_adjusted(spark, sf):
    """M6: adjusted ammag (kappa = 1/sigma) and standard gamma (kappa = sigma), covariates in beta."""
    return _coef_table(spark, sf, ["ammag_adjusted", "gamma_adjusted"])


@register("aft_by")
def q_aft_by(spark, sf):
    """M7: one GG per blood-pressure group, each with its own convergence flag."""
    p = aft.by_params(fit_named(spark, sf, "gg_by_group"), "sbp_group")
    return p.select("sbp_group", r6("mu"), r6("sigma"), r6("kappa"), "converged",
                    F.when(F.col("converged"), aft.gg_taxonomy("sigma", "kappa")).alias("shape"))


@register("exp_by_person", with_ctes(
    f"SELECT id, {sql_r6('CASE WHEN d > 0 THEN ln(t / d) END', 'mu')}, {sql_r6('CASE WHEN d > 0 THEN 1 / sqrt(d) END', 'se')}, "
    f"{sql_r6('CASE WHEN d > 0 THEN -d * ln(t / d) - d END', 'loglik')}, n, CAST(d AS BIGINT) AS events, d > 0 AS converged FROM lv",
    "locf", extra=[
        "lv AS (SELECT id, sum(t_stop - greatest(coalesce(t_start, 0.0), 0.0)) AS t, CAST(sum(CASE WHEN outcome <> 0 THEN 1 ELSE 0 END) AS DOUBLE) AS d, "
        "count(*) AS n FROM locf WHERE t_stop > greatest(coalesce(t_start, 0.0), 0.0) GROUP BY id)"]))
def q_exp_by_person(spark, sf):
    """M7 with as many strata as subjects: an exponential fit per subject (closed-form oracle); none where no event."""
    f = aft.aft_by(design_frame(spark, sf), SPEC, "id", "exponential", tol=1e-17)
    return f.select("id", r6(F.element_at("beta", 1), "mu"), r6(F.sqrt(F.element_at("vcov", 1)), "se"), r6("loglik"), "n", "events", "converged")


def _group_param_df(spark, fit):
    gp = aft.group_params(fit, [1, 2, 3, 4], {1: None, 2: "sbp_group2", 3: "sbp_group3", 4: "sbp_group4"})
    return spark.createDataFrame([(int(p["group"]), float(p["mu"]), float(p["sigma"]), float(p["kappa"])) for p in gp],
                                 "sbp_group int, mu double, sigma double, kappa double")


@register("gg_shapes")
def q_gg_shapes(spark, sf):
    """M12 on fits: per-group (mu, sigma, kappa) of the saturated GG and its hazard shape."""
    p = _group_param_df(spark, fit_named(spark, sf, "gg_saturated"))
    return p.select("sbp_group", r6("mu"), r6("sigma"), r6("kappa"), aft.gg_taxonomy("sigma", "kappa").alias("shape"))


_TAX_SQL = with_ctes(
    "SELECT id, visit, " + sql_r6("s", "sigma") + ", " + sql_r6("k", "kappa") + ", CASE "
    "WHEN abs(k - 1) < 1e-9 AND abs(s - 1) < 1e-9 THEN 'exponential' WHEN abs(k - 1) < 1e-9 THEN 'weibull' "
    "WHEN abs(k) < 1e-9 THEN 'lognormal' WHEN abs(k - s) < 1e-9 THEN 'gamma' WHEN abs(k - 1 / s) < 1e-9 THEN 'ammag' "
    "WHEN k < least(s, 1 / s) THEN 'arc' WHEN k > greatest(s, 1 / s) THEN 'bathtub' "
    "WHEN s < 1 THEN 'increasing' ELSE 'decreasing' END AS shape FROM ("
    "SELECT id, visit, 0.2 + sbp / 50 AS s, (dbp - 50) / 25.0 AS k FROM pp WHERE sbp IS NOT NULL AND dbp IS NOT NULL)", "pp")


@register("gg_taxonomy", _TAX_SQL)
def q_gg_taxonomy(spark, sf):
    """Hazard-shape taxonomy as a column expression over (sigma, kappa) pairs
    read from the person-periods (sigma = 0.2 + sbp/50, kappa = (dbp - 50)/25)."""
    pp = person_periods(spark, sf).filter(F.col("sbp").isNotNull() & F.col("dbp").isNotNull())
    d = pp.select("id", "visit", (F.lit(0.2) + F.col("sbp") / 50).alias("s"), ((F.col("dbp") - 50) / 25.0).alias("k"))
    return d.select("id", "visit", r6("s", "sigma"), r6("k", "kappa"), aft.gg_taxonomy("s", "k").alias("shape"))


@register("predict_survival")
def q_predict_survival(spark, sf):
    """Fitted survival at each row's exit time from the crude conventional GG."""
    f = fit_named(spark, sf, "gg_crude")
    d = design_frame(spark, sf)
    return aft.predict(f, d, "t_stop", "survival").select("id", "visit", "sbp_group", "t_stop", r6("survival"))


@register("predict_hazard")
def q_predict_hazard(spark, sf):
    """Fitted hazard at each row's exit time from the crude conventional GG."""
    f = fit_named(spark, sf, "gg_crude")
    d = design_frame(spark, sf)
    return aft.predict(f, d, "t_stop", "hazard").select("id", "visit", "sbp_group", "t_stop", r6("hazard"))


@register("km_vs_fit")
def q_km_vs_fit(spark, sf):
    """Kaplan-Meier by group next to the fitted GG survival at the same times."""
    f = fit_named(spark, sf, "gg_crude")
    d = design_frame(spark, sf)
    km = survival.kaplan_meier(d, SPEC, ["sbp_group"]).filter(F.col("n_event") > 0)
    km = clean.dummies(km, "sbp_group", [2, 3, 4], prefix="sbp_group")
    out = aft.predict(f, km, "time", "survival", out="fitted")
    return out.select("sbp_group", "time", r6("surv", "km"), r6("fitted"))


# ------------------------------------------------------------------ Cox
def _score_sql(terms):
    xs = ", ".join(f"CAST({t} AS DOUBLE) AS x{i}" for i, t in enumerate(terms))
    ent = ", ".join(f"x{i} AS s{i}" for i in range(len(terms)))
    ext = ", ".join(f"-x{i}" for i in range(len(terms)))
    evx = ", ".join(f"0.0 AS dx{i}" for i in range(len(terms)))
    evx2 = ", ".join(f"d * x{i}" for i in range(len(terms)))
    sums = ", ".join(f"sum(s{i}) AS s{i}, sum(dx{i}) AS dx{i}" for i in range(len(terms)))
    prefix = ", ".join(f"sum(s{i}) OVER w - s{i} AS r{i}" for i in range(len(terms)))
    rows = " UNION ALL ".join(
        f"SELECT '{t}' AS term, {sql_r6(f'sum(dx{i} - d * r{i} / r)', 'score')}, "
        f"{sql_r6(f'sum(d * (r{i} / r - (r{i} / r) * (r{i} / r)))', 'information')} FROM rt WHERE d > 0"
        for i, t in enumerate(terms))
    return with_ctes(rows, "sd", extra=[
        f"base AS (SELECT t_start, t_stop, CASE WHEN outcome = 1 THEN 1.0 ELSE 0.0 END AS d, {xs} FROM sd2 WHERE t_stop > t_start)",
        f"tt AS (SELECT time, sum(e) AS e, sum(d) AS d, {sums} FROM ("
        f"SELECT t_start AS time, 1.0 AS e, 0.0 AS d, {ent}, {evx} FROM base UNION ALL "
        f"SELECT t_stop, -1.0, d, {ext}, {evx2} FROM base) GROUP BY time)",
        f"rt AS (SELECT *, sum(e) OVER w - e AS r, {prefix} FROM tt "
        "WINDOW w AS (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
    ])


def _sd2_cte():
    return ("sd2 AS (SELECT *, CAST(CASE WHEN race_recode = 2 THEN 1 ELSE 0 END AS INT) AS race_recode2 FROM sd)")


_SCORE_TERMS = GROUPS + ["lbw"]
_SCORE_SQL = _score_sql(_SCORE_TERMS).replace("WITH ", "WITH ", 1)


def _inject_sd2(sql: str) -> str:
    # sd2 extends the design CTE chain; place it right after 'sd'
    return sql.replace(",\nbase AS", ",\n" + _sd2_cte() + ",\nbase AS", 1)


@register("cox_score0", _inject_sd2(_SCORE_SQL))
def q_cox_score0(spark, sf):
    """X1 building block: Breslow score vector and information diagonal at beta = 0
    (risk-set prefix sums, delayed entry)."""
    d = design_frame(spark, sf)
    sets = risk_sets(cox.cox_design(d, SPEC, _SCORE_TERMS), _SCORE_TERMS)
    _ll, u, info = risk_stats(sets, np.zeros(len(_SCORE_TERMS)))
    rows = [(t, float(u[0, i]), float(info[0, i, i])) for i, t in enumerate(_SCORE_TERMS)]
    return spark.createDataFrame(rows, "term string, score double, information double") \
        .select("term", r6("score"), r6("information"))


@register("cox_fit")
def q_cox_fit(spark, sf):
    """Crude Cox, coefficients and hazard ratios."""
    return _coef_table(spark, sf, ["cox_crude"], exponentiate=True)


@register("cox_efron")
def q_cox_efron(spark, sf):
    """X1 with Efron ties (R's default); equals Breslow when no event times tie."""
    return _coef_table(spark, sf, ["cox_efron"], exponentiate=True)


@register("cox_adjusted")
def q_cox_adjusted(spark, sf):
    """Adjusted Cox."""
    return _coef_table(spark, sf, ["cox_adjusted"], exponentiate=True)


@register("cox_trend")
def q_cox_trend(spark, sf):
    """Trend test with the group code as a number."""
    return _coef_table(spark, sf, ["cox_trend"])


@register("cox_tvc")
def q_cox_tvc(spark, sf):
    """Group effects varying with time through (t - 16) * [t <= 16]."""
    return _coef_table(spark, sf, ["cox_tvc"])


_EP_SQL = with_ctes(
    "SELECT ep.id, ep.visit, e_start, e_stop, CAST(CASE WHEN e_stop = l.t_stop THEN l.outcome ELSE 0 END AS INT) AS e_event "
    "FROM ep JOIN locf l ON ep.id = l.id AND ep.visit = l.visit WHERE e_stop IS NOT NULL", "locf", extra=[
        "cuts AS (SELECT DISTINCT t_stop AS c FROM locf WHERE outcome = 1)",
        "inr AS (SELECT l.id, l.visit, c FROM locf l JOIN cuts ON c > l.t_start AND c < l.t_stop)",
        "bnd AS (SELECT id, visit, t_start AS b FROM locf UNION ALL SELECT id, visit, t_stop FROM locf "
        "UNION ALL SELECT id, visit, c FROM inr)",
        "ep AS (SELECT id, visit, b AS e_start, lead(b) OVER (PARTITION BY id, visit ORDER BY b) AS e_stop FROM bnd)"])


@register("episodes", _EP_SQL)
def q_episodes(spark, sf):
    """Intervals split at every distinct event time strictly inside them."""
    d = materialize(cohort.locf(person_periods(spark, sf), S).select("id", "visit", "t_start", "t_stop", "outcome"))
    cut_df = d.filter(F.col("outcome") == 1).select(F.col("t_stop").alias("c")).distinct()
    ev = cut_df.limit(cox.MAX_CUTS + 1).collect()
    if len(ev) <= cox.MAX_CUTS:
        return cox.split_episodes(d, SPEC, [r["c"] for r in ev], keep=["id", "visit"])
    return cox.split_episodes_join(d, SPEC, cut_df, keep=["id", "visit"], prepared=True)


@register("schoenfeld")
def q_schoenfeld(spark, sf):
    """Schoenfeld residuals of the crude Cox at each event."""
    f = fit_named(spark, sf, "cox_crude")
    s = cox.schoenfeld(f, design_frame(spark, sf), SPEC, ["id", "visit"])
    return s.select("id", "visit", "time", *[r6(f"r_{t}") for t in GROUPS])


@register("cox_snell")
def q_cox_snell(spark, sf):
    """Cox-Snell residuals and the Kaplan-Meier cumulative hazard of them (slope-1 check)."""
    f = fit_named(spark, sf, "cox_crude")
    r = cox.cox_snell(f, design_frame(spark, sf), SPEC, ["id", "visit"])
    r = r.withColumn("zero", F.lit(0.0))
    km = survival.kaplan_meier(r, survival.SurvSpec("zero", "cs_resid", "event"))
    return survival.km_transform(km, "cumhaz").select(r6("time", "resid"), r6("value", "cumhaz"))


@register("base_hazard")
def q_base_hazard(spark, sf):
    """Breslow baseline cumulative hazard of the crude Cox at event times."""
    f = fit_named(spark, sf, "cox_crude")
    b = cox.base_hazard(f).filter(F.col("D") > 0)
    return b.select("time", r6("H0"))


_NEWTON_ROUNDS = 8


def _cox_newton_sql(x, y):
    """Newton's method for two covariates, one chain of CTEs per round; risk sets as joins of rows and event times."""
    ctes = [f"base AS (SELECT t_start, t_stop, CASE WHEN outcome = 1 THEN 1.0 ELSE 0.0 END AS d, CAST({x} AS DOUBLE) AS x, "
            f"CAST({y} AS DOUBLE) AS y FROM sd3 WHERE t_stop > t_start)",
            "cell AS (SELECT e.t_stop AS time, b.x, b.y, CAST(count(*) AS DOUBLE) AS n FROM (SELECT DISTINCT t_stop FROM base WHERE d > 0) e "
            "JOIN base b ON b.t_start < e.t_stop AND b.t_stop >= e.t_stop GROUP BY ALL)",
            "ev AS (SELECT t_stop AS time, sum(d) AS d, sum(d * x) AS dx, sum(d * y) AS dy FROM base WHERE d > 0 GROUP BY 1)",
            "b0 AS (SELECT 0.0 AS p, 0.0 AS q, 0.0 AS v11, 0.0 AS v12, 0.0 AS v22)"]
    for i in range(_NEWTON_ROUNDS):
        ctes += [f"s{i} AS (SELECT time, sum(n * exp(p * x + q * y)) AS s, sum(x * n * exp(p * x + q * y)) AS sx, "
                 f"sum(y * n * exp(p * x + q * y)) AS sy, sum(x * x * n * exp(p * x + q * y)) AS sxx, "
                 f"sum(x * y * n * exp(p * x + q * y)) AS sxy, sum(y * y * n * exp(p * x + q * y)) AS syy FROM cell, b{i} GROUP BY time)",
                 f"g{i} AS (SELECT sum(dx - d * sx / s) AS u1, sum(dy - d * sy / s) AS u2, sum(d * (sxx / s - sx * sx / s / s)) AS a, "
                 f"sum(d * (sxy / s - sx * sy / s / s)) AS b, sum(d * (syy / s - sy * sy / s / s)) AS c FROM s{i} JOIN ev USING (time))",
                 f"b{i + 1} AS (SELECT p + (c * u1 - b * u2) / (a * c - b * b) AS p, q + (a * u2 - b * u1) / (a * c - b * b) AS q, "
                 f"c / (a * c - b * b) AS v11, -b / (a * c - b * b) AS v12, a / (a * c - b * b) AS v22 FROM b{i}, g{i})"]
    return ctes, f"b{_NEWTON_ROUNDS}"


def _with_sd3(body, extra=()):
    sd3 = ("sd3 AS (SELECT *, CAST(CASE WHEN race_recode = 2 THEN 1 ELSE 0 END AS INT) AS race_recode2, "
           "CAST(CASE WHEN race_recode = 3 THEN 1 ELSE 0 END AS INT) AS race_recode3 FROM sd)")
    return with_ctes(body, "sd", extra=[sd3, *extra])


def _cox_race_sql():
    ctes, last = _cox_newton_sql(*RACES)
    z = infer.Z975
    rows = (f"SELECT '{RACES[0]}' AS term, p AS b, sqrt(v11) AS se FROM {last} UNION ALL SELECT '{RACES[1]}', q, sqrt(v22) FROM {last}")
    cols = [sql_r6("b", "coef"), sql_r6("se", "coef_se"), sql_r6("b / se", "z"), sql_r6("exp(b)", "hr"), sql_r6("exp(b) * se", "hr_se"),
            sql_r6(f"exp(b - {z} * se)", "lo"), sql_r6(f"exp(b + {z} * se)", "hi")]
    return _with_sd3(f"SELECT term, {', '.join(cols)} FROM ({rows})", ctes)


@register("cox_race", _cox_race_sql())
def q_cox_race(spark, sf):
    """A whole Cox fit by race: log hazard ratios and hazard ratios with se and limits (oracle: Newton in SQL)."""
    fits = infer.fits_table(spark, [fit_named(spark, sf, "cox_race")])
    plain = infer.coef_long(fits).select("term", r6("coef"), r6("se", "coef_se"), r6("z"))
    ratio = infer.coef_long(fits, exponentiate=True).select("term", r6("coef", "hr"), r6("se", "hr_se"), r6("lo"), r6("hi"))
    return plain.join(ratio, "term")


_TVC_BETA = (0.3, -0.2, 0.05, -0.04)


def _tvc_fixed_sql():
    b1, b2, c1, c2 = _TVC_BETA
    g = f"(time - {TVC_CUT}) * CASE WHEN time <= {TVC_CUT} THEN 1.0 ELSE 0.0 END"
    return _with_sd3(
        f"SELECT {sql_r6('sum(dx * b1 + dy * b2 - d * ln(s))', 'loglik')}, {sql_r6('sum(dx - d * sx / s)', 'score_race2')}, "
        f"{sql_r6('sum(dy - d * sy / s)', 'score_race3')}, {sql_r6('sum(g * (dx - d * sx / s))', 'score_race2_t')}, "
        f"{sql_r6('sum(g * (dy - d * sy / s))', 'score_race3_t')} FROM rs JOIN ev USING (time)", [
            f"base AS (SELECT t_start, t_stop, CASE WHEN outcome = 1 THEN 1.0 ELSE 0.0 END AS d, CAST({RACES[0]} AS DOUBLE) AS x, "
            f"CAST({RACES[1]} AS DOUBLE) AS y FROM sd3 WHERE t_stop > t_start)",
            f"ev AS (SELECT *, {b1} + {c1} * g AS b1, {b2} + {c2} * g AS b2 FROM (SELECT time, d, dx, dy, {g} AS g FROM "
            "(SELECT t_stop AS time, sum(d) AS d, sum(d * x) AS dx, sum(d * y) AS dy FROM base WHERE d > 0 GROUP BY 1)))",
            "rs AS (SELECT ev.time, sum(exp(b1 * x + b2 * y)) AS s, sum(x * exp(b1 * x + b2 * y)) AS sx, "
            "sum(y * exp(b1 * x + b2 * y)) AS sy FROM ev JOIN base b ON b.t_start < ev.time AND b.t_stop >= ev.time GROUP BY ev.time)"])


@register("cox_tvc_fixed", _tvc_fixed_sql())
def q_cox_tvc_fixed(spark, sf):
    """X5 at fixed coefficients: log partial likelihood and score of effects by race that vary with time."""
    sets = risk_sets(cox.cox_design(design_frame(spark, sf), SPEC, RACES), RACES, RACES, texp_cut)
    ll, u, _ = risk_stats(sets, np.array(_TVC_BETA))
    names = ["loglik", "score_race2", "score_race3", "score_race2_t", "score_race3_t"]
    df = spark.createDataFrame([(float(ll[0]), *map(float, u[0]))], ", ".join(f"{n} double" for n in names))
    return df.select(*[r6(n) for n in names])


# ------------------------------------------------------------------ inference
_ALL = ["weibull_crude", "lognormal_crude", "gg_crude", "gg_saturated", "ammag_crude", "gamma_crude"]


def _fits(spark, sf, keys):
    return infer.fits_table(spark, [fit_named(spark, sf, k) for k in keys])


@register("fits_table")
def q_fits_table(spark, sf):
    """Fits table of the crude parametric models (one row per model)."""
    f = _fits(spark, sf, _ALL)
    return f.select("model", "terms", F.transform("beta", lambda x: F.round(x, 6)).alias("beta"),
                    r6("loglik"), r6("loglik_logtime"), "k", "n", "converged")


@register("lincom")
def q_lincom(spark, sf):
    """Group time coefficients _cons + group_k of the Weibull and conventional GG."""
    f = _fits(spark, sf, ["weibull_crude", "gg_crude"])
    parts = [infer.lincom(f, {"mu:_cons": 1.0, f"mu:{g}": 1.0}, f"_cons+{g}") for g in GROUPS]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("model", "contrast", *[r6(c) for c in ("estimate", "se", "z", "p", "lo", "hi")])


@register("nlcom")
def q_nlcom(spark, sf):
    """Per-group sigma = exp(lnsigma_cons + lnsigma_k) of the saturated GG (delta method)."""
    f = _fits(spark, sf, ["gg_saturated"])
    parts = [infer.nlcom_exp(f, {"lnsigma:_cons": 1.0}, "sigma_1")]
    parts += [infer.nlcom_exp(f, {"lnsigma:_cons": 1.0, f"lnsigma:{g}": 1.0}, f"sigma_{g[-1]}") for g in GROUPS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("model", "contrast", *[r6(c) for c in ("estimate", "se", "lo", "hi")])


@register("ic")
def q_ic(spark, sf):
    """AIC and BIC of the parametric models on the density scale and the log-time scale."""
    f = _fits(spark, sf, _ALL)
    out = infer.ic(f, "density").unionByName(infer.ic(f, "logtime"))
    return out.select("model", "scale", "n", "k", r6("loglik"), r6("aic"), r6("bic"))


@register("lrtest")
def q_lrtest(spark, sf):
    """I4: Weibull vs conventional GG, conventional vs saturated GG, Cox vs time-varying Cox."""
    f = _fits(spark, sf, ["weibull_crude", "gg_crude", "gg_saturated", "cox_crude", "cox_tvc"])
    t = infer.lrtest(f, [("weibull_crude", "gg_crude"), ("gg_crude", "gg_saturated"), ("cox_crude", "cox_tvc")])
    return t.select("small", "large", r6("chi2"), "df", r6("p"))


@register("wald")
def q_wald(spark, sf):
    """Joint Wald test of the group effects (mu equation) per model."""
    f = _fits(spark, sf, ["weibull_crude", "gg_crude", "cox_crude"])
    terms = [f"mu:{g}" for g in GROUPS] + [f"xb:{g}" for g in GROUPS]
    return infer.wald(f, terms).select("model", "test", r6("chi2"), "df", r6("p"))


@register("compare_models")
def q_compare_models(spark, sf):
    """Coefficients of several stored fits side by side."""
    f = _fits(spark, sf, ["weibull_crude", "lognormal_crude", "gg_crude"])
    c = infer.compare(f)
    return c.select("equation", "term", *[r6(m) for m in sorted(["weibull_crude", "lognormal_crude", "gg_crude"])])


# evaluation point of the Breslow log-likelihood check (a fixed, declared beta)
_FIXED_BETA = (0.25, -0.5, 0.75, 0.1)


def _cox_fixed_sql(terms, beta):
    xb = " + ".join(f"{b} * CAST({t} AS DOUBLE)" for t, b in zip(terms, beta))
    xs = ", ".join(f"CAST({t} AS DOUBLE) AS x{i}" for i, t in enumerate(terms))
    n = len(terms)
    ent = ", ".join(f"r * x{i} AS s{i}" for i in range(n))
    ext = ", ".join(f"-r * x{i}" for i in range(n))
    evx = ", ".join(f"0.0 AS dx{i}" for i in range(n))
    evx2 = ", ".join(f"d * x{i}" for i in range(n))
    sums = ", ".join(f"sum(s{i}) AS s{i}, sum(dx{i}) AS dx{i}" for i in range(n))
    prefix = ", ".join(f"sum(s{i}) OVER w - s{i} AS r{i}" for i in range(n))
    body = (f"SELECT {sql_r6('sum(dxb - d * ln(r))', 'loglik')}, "
            + ", ".join(sql_r6(f"sum(dx{i} - d * r{i} / r)", f"score_{t}") for i, t in enumerate(terms))
            + " FROM rt WHERE d > 0")
    return _inject_sd2(with_ctes(body, "sd", extra=[
        f"base AS (SELECT t_start, t_stop, CASE WHEN outcome = 1 THEN 1.0 ELSE 0.0 END AS d, {xs}, exp({xb}) AS r, {xb} AS xb FROM sd2 WHERE t_stop > t_start)",
        f"tt AS (SELECT time, sum(e) AS e, sum(d) AS d, sum(dxb) AS dxb, {sums} FROM ("
        f"SELECT t_start AS time, r AS e, 0.0 AS d, 0.0 AS dxb, {ent}, {evx} FROM base UNION ALL "
        f"SELECT t_stop, -r, d, d * xb, {ext}, {evx2} FROM base) GROUP BY time)",
        f"rt AS (SELECT *, sum(e) OVER w - e AS r, {prefix} FROM tt "
        "WINDOW w AS (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
    ]))


@register("cox_loglik_fixed", _cox_fixed_sql(_SCORE_TERMS, _FIXED_BETA))
def q_cox_loglik_fixed(spark, sf):
    """X1 building block at a fixed beta: Breslow log partial likelihood and score
    (risk-set moment prefix sums with delayed entry, one distributed pass)."""
    d = design_frame(spark, sf)
    sets = risk_sets(cox.cox_design(d, SPEC, _SCORE_TERMS), _SCORE_TERMS)
    ll, u, _ = risk_stats(sets, np.array(_FIXED_BETA))
    row = [float(ll[0])] + [float(x) for x in u[0]]
    names = ["loglik"] + [f"score_{t}" for t in _SCORE_TERMS]
    df = spark.createDataFrame([tuple(row)], ", ".join(f"{n} double" for n in names))
    return df.select(*[r6(n) for n in names])


def _fixed_rt_ctes(terms, beta, with_keys=False):
    xb = " + ".join(f"{b} * CAST({t} AS DOUBLE)" for t, b in zip(terms, beta))
    xs = ", ".join(f"CAST({t} AS DOUBLE) AS x{i}" for i, t in enumerate(terms))
    n = len(terms)
    ent = ", ".join(f"r * x{i} AS s{i}" for i in range(n))
    ext = ", ".join(f"-r * x{i}" for i in range(n))
    evx = ", ".join(f"0.0 AS dx{i}" for i in range(n))
    evx2 = ", ".join(f"d * x{i}" for i in range(n))
    sums = ", ".join(f"sum(s{i}) AS s{i}, sum(dx{i}) AS dx{i}" for i in range(n))
    prefix = ", ".join(f"sum(s{i}) OVER w - s{i} AS r{i}" for i in range(n))
    keys = "id, visit, " if with_keys else ""
    return [
        f"base AS (SELECT {keys}t_start, t_stop, CASE WHEN outcome = 1 THEN 1.0 ELSE 0.0 END AS d, {xs}, exp({xb}) AS r FROM sd2 WHERE t_stop > t_start)",
        f"tt AS (SELECT time, sum(e) AS e, sum(d) AS d, {sums} FROM ("
        f"SELECT t_start AS time, r AS e, 0.0 AS d, {ent}, {evx} FROM base UNION ALL "
        f"SELECT t_stop, -r, d, {ext}, {evx2} FROM base) GROUP BY time)",
        f"rt AS (SELECT *, sum(e) OVER w - e AS r, {prefix} FROM tt "
        "WINDOW w AS (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
    ]


_H0_SQL = _inject_sd2(with_ctes(
    "SELECT time, " + sql_r6("h0", "H0") + " FROM (SELECT time, d, sum(CASE WHEN d > 0 THEN d / r ELSE 0 END) "
    "OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h0 FROM rt) WHERE d > 0",
    "sd", extra=_fixed_rt_ctes(_SCORE_TERMS, _FIXED_BETA)))


@register("base_hazard_fixed", _H0_SQL)
def q_base_hazard_fixed(spark, sf):
    """X9 at a fixed beta: Breslow baseline cumulative hazard at every event time."""
    f = cox.fixed_fit(design_frame(spark, sf), SPEC, _SCORE_TERMS, _FIXED_BETA)
    b = cox.base_hazard(f).filter(F.col("D") > 0)
    return b.select("time", r6("H0"))


_SCH_SQL = _inject_sd2(with_ctes(
    "SELECT b.id, b.visit, b.t_stop AS time, "
    + ", ".join(sql_r6(f"b.x{i} - rt.r{i} / rt.r", f"r_{t}") for i, t in enumerate(_SCORE_TERMS))
    + " FROM base b JOIN rt ON b.t_stop = rt.time WHERE b.d > 0", "sd",
    extra=_fixed_rt_ctes(_SCORE_TERMS, _FIXED_BETA, with_keys=True)))


@register("schoenfeld_fixed", _SCH_SQL)
def q_schoenfeld_fixed(spark, sf):
    """X7 at a fixed beta: Schoenfeld residuals x - S1/S0 at every event row."""
    f = cox.fixed_fit(design_frame(spark, sf), SPEC, _SCORE_TERMS, _FIXED_BETA)
    s = cox.schoenfeld(f, design_frame(spark, sf), SPEC, ["id", "visit"])
    return s.select("id", "visit", "time", *[r6(f"r_{t}") for t in _SCORE_TERMS])


_CS_SQL = _inject_sd2(with_ctes(
    "SELECT b.id, b.visit, CAST(b.d AS INT) AS event, "
    + sql_r6("b.r * (COALESCE(h1.h0, 0.0) - COALESCE(h0s.h0, 0.0))", "cs_resid")
    + " FROM base b ASOF LEFT JOIN h h1 ON b.t_stop >= h1.time ASOF LEFT JOIN h h0s ON b.t_start >= h0s.time",
    "sd", extra=_fixed_rt_ctes(_SCORE_TERMS, _FIXED_BETA, with_keys=True) + [
        "h AS (SELECT time, sum(CASE WHEN d > 0 THEN d / r ELSE 0 END) OVER (ORDER BY time ROWS BETWEEN UNBOUNDED "
        "PRECEDING AND CURRENT ROW) AS h0 FROM rt)"]))


@register("cox_snell_fixed", _CS_SQL)
def q_cox_snell_fixed(spark, sf):
    """X8 at a fixed beta: Cox-Snell residual e^{xb} (H0(stop) - H0(start)) per row,
    H0 looked up as-of by the carried scan (no range join)."""
    f = cox.fixed_fit(design_frame(spark, sf), SPEC, _SCORE_TERMS, _FIXED_BETA)
    r = cox.cox_snell(f, design_frame(spark, sf), SPEC, ["id", "visit"])
    return r.select("id", "visit", F.col("event").cast("int"), r6("cs_resid"))
