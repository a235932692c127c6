"""Registered queries: likelihoods of one's own (M9), functions of coefficients (I2, M8) and special cases.

The closed-form model is a lognormal by race over the event rows: per race, mu is the mean of
ln t with variance s^2 / n and ln sigma is ln s with variance 1 / (2 n), s the population deviation.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import jets
from ..operators import aft, infer, maximize as ml
from ..plans.likelihood import CONS
from .models import RACES, SPEC, _memo, design_frame, fit_named
from .registry import r6, register, sql_r6
from .sql import with_ctes

Z = infer.Z975
_LOG_SQRT_2PI = float(np.log(2 * np.pi) / 2)

_LEVELS = ("lv AS (SELECT CASE WHEN race = 1 THEN 1 WHEN race = 2 THEN 2 ELSE 3 END AS lev, avg(ln(t_stop)) AS m, "
           "stddev_pop(ln(t_stop)) AS s, CAST(count(*) AS DOUBLE) AS n FROM locf WHERE outcome = 1 GROUP BY 1)")
_COEF = ("cf AS (SELECT 'mu' AS equation, '_cons' AS term, m AS coef, s * s / n AS v FROM lv WHERE lev = 1 UNION ALL "
         "SELECT 'lnsigma', '_cons', ln(s), 1 / (2 * n) FROM lv WHERE lev = 1 UNION ALL "
         "SELECT 'mu', 'race_recode' || b.lev, b.m - a.m, a.s * a.s / a.n + b.s * b.s / b.n FROM lv a JOIN lv b ON a.lev = 1 AND b.lev > 1 UNION ALL "
         "SELECT 'lnsigma', 'race_recode' || b.lev, ln(b.s / a.s), 1 / (2 * a.n) + 1 / (2 * b.n) FROM lv a JOIN lv b ON a.lev = 1 AND b.lev > 1)")


def lognormal_loglik(eta, data):
    z = (-eta["mu"] + np.log(data["t_stop"])) * jets.exp(-eta["lnsigma"])
    return z * z * -0.5 - eta["lnsigma"] - np.log(data["t_stop"]) - _LOG_SQRT_2PI


def _lognormal(spark, sf):
    def make():
        d = design_frame(spark, sf).where("outcome = 1")
        terms = RACES + [CONS]
        return ml.maximize(d, lognormal_loglik, [("mu", terms), ("lnsigma", terms)], ["t_stop"], {f"mu:{CONS}": 2.0}, tol=1e-18, name="lognormal")
    return infer.fits_table(spark, [_memo(spark, sf, "ml_lognormal", make)])


@register("ml_lognormal", with_ctes(
    f"SELECT equation, term, {sql_r6('coef', 'coef')}, {sql_r6('sqrt(v)', 'se')}, {sql_r6('coef / sqrt(v)', 'z')}, "
    f"{sql_r6(f'coef - {Z} * sqrt(v)', 'lo')}, {sql_r6(f'coef + {Z} * sqrt(v)', 'hi')} FROM cf", "locf", extra=[_LEVELS, _COEF]))
def q_ml_lognormal(spark, sf):
    """M9: a row likelihood of one's own, exact derivatives, against its closed form."""
    return infer.coef_long(_lognormal(spark, sf)).select("equation", "term", *[r6(c) for c in ("coef", "se", "z", "lo", "hi")])


_NLCOM = ("SELECT contrast, {e}, {s}, {z}, {lo}, {hi} FROM ("
          "SELECT 'mean_1' AS contrast, exp(m + s * s / 2) AS e, exp(m + s * s / 2) * sqrt(s * s / n + s * s * s * s / (2 * n)) AS se FROM lv WHERE lev = 1 UNION ALL "
          "SELECT 'sigma_' || b.lev || '_1', b.s / a.s, b.s / a.s * sqrt(1 / (2 * a.n) + 1 / (2 * b.n)) FROM lv a JOIN lv b ON a.lev = 1 AND b.lev > 1)").format(
    e=sql_r6("e", "estimate"), s=sql_r6("se", "se"), z=sql_r6("e / se", "z"), lo=sql_r6(f"e - {Z} * se", "lo"), hi=sql_r6(f"e + {Z} * se", "hi"))


@register("ml_nlcom", with_ctes(_NLCOM, "locf", extra=[_LEVELS]))
def q_ml_nlcom(spark, sf):
    """Functions of several coefficients (a mean, ratios of two sigmas) by the delta method with exact gradients."""
    functions = {"mean_1": lambda b: jets.exp(b[f"mu:{CONS}"] + jets.exp(b[f"lnsigma:{CONS}"] * 2.0) * 0.5)}
    for i, race in enumerate(RACES):
        functions[f"sigma_{i + 2}_1"] = (lambda t: lambda b: jets.exp(b[f"lnsigma:{CONS}"] + b[f"lnsigma:{t}"]) / jets.exp(b[f"lnsigma:{CONS}"]))(race)
    return ml.nlcom(_lognormal(spark, sf), functions).select("contrast", *[r6(c) for c in ("estimate", "se", "z", "lo", "hi")])


@register("ml_wald", with_ctes(
    f"SELECT {sql_r6('x', 'chi2')}, CAST(2 AS INT) AS df, {sql_r6('exp(-x / 2)', 'p')} FROM (SELECT sum(2 * n * (ln(s) - l) * (ln(s) - l)) AS x "
    "FROM lv, (SELECT sum(n * ln(s)) / sum(n) AS l FROM lv))", "locf", extra=[_LEVELS]))
def q_ml_wald(spark, sf):
    """A joint Wald test of constraints (all sigmas equal) by their Jacobian."""
    equal = {"equal": lambda b: [b[f"lnsigma:{t}"] for t in RACES]}
    return ml.wald_constraints(_lognormal(spark, sf), equal).select(r6("chi2"), "df", r6("p"))


def _user_fit(spark, sf, name, shape):
    def make():
        d = aft.model_frame(design_frame(spark, sf), SPEC, RACES)
        return ml.maximize(d, ml.gengamma_loglik(shape), [("mu", RACES + [CONS]), ("lnsigma", [CONS])], ["t0", "t", "d"],
                           {f"mu:{CONS}": 2.0}, name=name)
    return _memo(spark, sf, f"ml_{name}", make)


@register("ml_ammag")
def q_ml_ammag(spark, sf):
    """M9: the ammag (shape 1 / sigma) as a likelihood of one's own, with delayed entry; score 0 at the optimum."""
    return _user_table(spark, _user_fit(spark, sf, "ammag", ml.ammag))


@register("ml_gamma")
def q_ml_gamma(spark, sf):
    """M9: the standard gamma (shape sigma) as a likelihood of one's own, with delayed entry; score 0 at the optimum."""
    return _user_table(spark, _user_fit(spark, sf, "gamma", ml.standard_gamma))


def _user_table(spark, fit):
    score = float(np.abs(fit.extra["score"]).max())
    fits = infer.fits_table(spark, [fit])
    return infer.coef_long(fits).join(fits.select("model", "converged"), "model").select(
        "equation", "term", *[r6(c) for c in ("coef", "se", "z", "p", "lo", "hi")], "converged", r6(F.lit(score), "score"))


@register("gg_special_cases")
def q_gg_special_cases(spark, sf):
    """Wald test of each special case of the generalised gamma by race."""
    t = ml.special_cases(infer.fits_table(spark, [fit_named(spark, sf, "gg_race")]))
    return t.select("model", "test", r6("chi2"), "df", r6("p"))


@register("weibull_hazard_ratios")
def q_weibull_hazard_ratios(spark, sf):
    """M8: Weibull hazard ratios by race with se, z, p and limits."""
    t = ml.weibull_hazard_ratios(infer.fits_table(spark, [fit_named(spark, sf, "weibull_race")]), RACES)
    return t.select("model", "term", *[r6(c) for c in ("hazard_ratio", "se", "z", "p", "lo", "hi")])
