"""Registered queries: inference (I1-I6) on exponential models by race, whose estimates are closed forms.

With T the time at risk and D the events of a level, the level's coefficient is
ln(T / D) with variance 1 / D, so the oracles need no iteration. Race has three
classes with events at every size of the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aft, infer
from .models import SPEC, _memo, design_frame
from .registry import r6, register, sql_r6
from .sql import with_ctes

TERMS = ["race_recode2", "race_recode3"]
Z = infer.Z975

_LEVELS = ("lv AS (SELECT CASE WHEN race = 1 THEN 1 WHEN race = 2 THEN 2 ELSE 3 END AS lev, "
           "sum(t_stop - greatest(coalesce(t_start, 0.0), 0.0)) AS t, CAST(sum(CASE WHEN outcome <> 0 THEN 1 ELSE 0 END) AS DOUBLE) AS d, "
           "count(*) AS n FROM locf WHERE t_stop > greatest(coalesce(t_start, 0.0), 0.0) GROUP BY 1)")
_MU = "mu AS (SELECT lev, ln(t / d) AS m, 1 / d AS v, d FROM lv)"
_LL = ("ll AS (SELECT 'exp_null' AS model, sum(d) * -ln(sum(t) / sum(d)) - sum(d) AS loglik, 1 AS k, sum(n) AS n FROM lv "
       "UNION ALL SELECT 'exp_race', sum(d * -ln(t / d)) - sum(d), 3, sum(n) FROM lv)")
_COEF = ("cf AS (SELECT '_cons' AS term, m AS coef, v FROM mu WHERE lev = 1 UNION ALL "
         "SELECT 'race_recode' || b.lev, b.m - a.m, a.v + b.v FROM mu a JOIN mu b ON a.lev = 1 AND b.lev > 1)")


def _fits(spark, sf):
    def make():
        d = design_frame(spark, sf)
        return [aft.aft(d, SPEC, terms, "exponential", name=name, tol=1e-17) for name, terms in (("exp_null", []), ("exp_race", TERMS))]
    return infer.fits_table(spark, _memo(spark, sf, "exponential", make))


def _race(spark, sf):
    return _fits(spark, sf).where("model = 'exp_race'")


@register("exp_coef", with_ctes(
    f"SELECT term, {sql_r6('coef', 'coef')}, {sql_r6('sqrt(v)', 'se')}, {sql_r6('coef / sqrt(v)', 'z')}, "
    f"{sql_r6(f'coef - {Z} * sqrt(v)', 'lo')}, {sql_r6(f'coef + {Z} * sqrt(v)', 'hi')}, true AS converged FROM cf",
    "locf", extra=[_LEVELS, _MU, _COEF]))
def q_exp_coef(spark, sf):
    """M1: exponential time coefficients by race, with se, z and limits; converged as the fit says."""
    fits = _race(spark, sf)
    flag = fits.select("model", "converged")
    return infer.coef_long(fits).join(flag, "model").select("term", *[r6(c) for c in ("coef", "se", "z", "lo", "hi")], "converged")


@register("exp_time_ratios", with_ctes(
    f"SELECT term, {sql_r6('exp(coef)', 'coef')}, {sql_r6('exp(coef) * sqrt(v)', 'se')}, "
    f"{sql_r6(f'exp(coef - {Z} * sqrt(v))', 'lo')}, {sql_r6(f'exp(coef + {Z} * sqrt(v))', 'hi')} FROM cf WHERE term <> '_cons'",
    "locf", extra=[_LEVELS, _MU, _COEF]))
def q_exp_time_ratios(spark, sf):
    """Time ratios exp(b) with their delta-method se and limits."""
    return infer.coef_long(_race(spark, sf), exponentiate=True).where("term <> '_cons'").select(
        "term", *[r6(c) for c in ("coef", "se", "lo", "hi")])


_W = {"mu:race_recode3": 1.0, "mu:race_recode2": -1.0}
_DIFF = "df AS (SELECT b.m - a.m AS e, sqrt(a.v + b.v) AS s FROM mu a JOIN mu b ON a.lev = 2 AND b.lev = 3)"


@register("exp_lincom", with_ctes(
    f"SELECT {sql_r6('e', 'estimate')}, {sql_r6('s', 'se')}, {sql_r6('e / s', 'z')}, {sql_r6(f'e - {Z} * s', 'lo')}, "
    f"{sql_r6(f'e + {Z} * s', 'hi')} FROM df", "locf", extra=[_LEVELS, _MU, _DIFF]))
def q_exp_lincom(spark, sf):
    """Race 3 against race 2."""
    return infer.lincom(_race(spark, sf), _W).select(*[r6(c) for c in ("estimate", "se", "z", "lo", "hi")])


@register("exp_nlcom", with_ctes(
    f"SELECT {sql_r6('exp(e)', 'estimate')}, {sql_r6('exp(e) * s', 'se')}, {sql_r6('1 / s', 'z')}, "
    f"{sql_r6(f'exp(e) * (1 - {Z} * s)', 'lo')}, {sql_r6(f'exp(e) * (1 + {Z} * s)', 'hi')} FROM df",
    "locf", extra=[_LEVELS, _MU, _DIFF]))
def q_exp_nlcom(spark, sf):
    """The time ratio of race 3 to race 2 with delta-method limits."""
    return infer.nlcom_exp(_race(spark, sf), _W).select(*[r6(c) for c in ("estimate", "se", "z", "lo", "hi")])


@register("exp_ic", with_ctes(
    f"SELECT model, CAST(n AS BIGINT) AS n, {sql_r6('loglik', 'loglik')}, CAST(k AS INT) AS k, 'density' AS scale, "
    f"{sql_r6('-2 * loglik + 2 * k', 'aic')}, {sql_r6('-2 * loglik + k * ln(n)', 'bic')} FROM ll", "locf", extra=[_LEVELS, _LL]))
def q_exp_ic(spark, sf):
    """AIC and BIC of the model without and with race."""
    return infer.ic(_fits(spark, sf)).select("model", "n", r6("loglik"), "k", "scale", r6("aic"), r6("bic"))


@register("exp_lrtest", with_ctes(
    "SELECT 'exp_null' AS small, 'exp_race' AS large, " + sql_r6("x", "chi2") + ", CAST(2 AS INT) AS df, "
    + sql_r6("exp(-x / 2)", "p") + " FROM (SELECT 2 * (b.loglik - a.loglik) AS x FROM ll a JOIN ll b "
    "ON a.model = 'exp_null' AND b.model = 'exp_race')", "locf", extra=[_LEVELS, _LL]))
def q_exp_lrtest(spark, sf):
    """I4: likelihood-ratio test of race, 2 degrees of freedom (the tail is exp(-x/2))."""
    return infer.lrtest(_fits(spark, sf), [("exp_null", "exp_race")]).select("small", "large", r6("chi2"), "df", r6("p"))


@register("exp_wald", with_ctes(
    "SELECT " + sql_r6("x", "chi2") + ", CAST(2 AS INT) AS df, " + sql_r6("exp(-x / 2)", "p")
    + " FROM (SELECT sum(d * (m - mm) * (m - mm)) AS x FROM mu, (SELECT sum(d * m) / sum(d) AS mm FROM mu))",
    "locf", extra=[_LEVELS, _MU]))
def q_exp_wald(spark, sf):
    """Joint Wald test of race."""
    return infer.wald(_race(spark, sf), ["mu:race_recode2", "mu:race_recode3"]).select(r6("chi2"), "df", r6("p"))


@register("exp_compare", with_ctes(
    "SELECT c.term, " + sql_r6("CASE WHEN c.term = '_cons' THEN (SELECT ln(sum(t) / sum(d)) FROM lv) END", "exp_null") + ", "
    + sql_r6("c.coef", "exp_race") + " FROM cf c", "locf", extra=[_LEVELS, _MU, _COEF]))
def q_exp_compare(spark, sf):
    """Both models side by side."""
    wide = infer.compare(_fits(spark, sf))
    return wide.select("term", r6("exp_null"), r6("exp_race")).where(F.col("term").isNotNull())
