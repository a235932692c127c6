"""Parametric accelerated-failure-time regression with delayed entry.

Row log-likelihood (density scale), entry t0, exit t, event d:
    d * ln f(t) + (1 - d) * ln S(t) - ln S(t0)          (ln S(0) = 0)
``loglik_logtime`` adds sum over events of ln t (the log-time scale that
Stata's streg prints); ``ic``/``lrtest`` refuse to mix the two scales.

Linear predictors: mu (time scale), ln sigma ('anc'), kappa ('anc2').
Families: exponential, weibull, lognormal, ggamma, ammag (kappa = 1/sigma),
gamma (kappa = sigma).  Fitting is the distributed Newton of plans.likelihood.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.gengamma import gg_hazard, gg_log_density, gg_log_surv, gg_survival
from ..plans.condense import CELL, NODES, gather_once
from ..plans.likelihood import CONS, SMALL_DESIGN, FitResult, RowModel, fit_distributed
from ..plans.scan import materialize
from ..plans.strata import inverse, newton_by
from .survival import SurvSpec

# Rows per covariate vector from which a fit gathers them on time nodes: two event flags, cells of 15 in ln t, at half their nodes' number.
PATTERN_ROWS = int(2 * 15 / CELL * NODES * 2)
FAMILIES = ("exponential", "weibull", "lognormal", "ggamma", "ammag", "gamma")


def _shape(kind: str, eta: np.ndarray):
    mu = eta[:, 0]
    n = len(mu)
    if kind == "exponential":
        return mu, np.ones(n), np.ones(n)
    lns = eta[:, 1]
    sigma = np.exp(lns)
    if kind == "weibull":
        return mu, sigma, np.ones(n)
    if kind == "lognormal":
        return mu, sigma, np.zeros(n)
    if kind == "ggamma":
        return mu, sigma, eta[:, 2]
    if kind == "ammag":
        return mu, sigma, np.exp(-lns)
    if kind == "gamma":
        return mu, sigma, sigma
    raise ValueError(kind)


def row_loglik(kind: str):
    def ll(eta: np.ndarray, data: dict) -> np.ndarray:
        t0, t, d = data["t0"], data["t"], data["d"]
        mu, sigma, kappa = _shape(kind, eta)
        if kind in ("exponential", "weibull"):
            with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
                w = (np.log(t) - mu) / sigma
                ew = np.exp(w)
                w0 = np.where(t0 > 0, (np.log(np.where(t0 > 0, t0, 1.0)) - mu) / sigma, -np.inf)
                ls0 = np.where(t0 > 0, -np.exp(w0), 0.0)
                return d * (-np.log(sigma) - np.log(t) + w) - ew - ls0
        ls = gg_log_surv(t, mu, sigma, kappa)
        lf = gg_log_density(t, mu, sigma, kappa)
        ls0 = np.where(t0 > 0, gg_log_surv(t0, mu, sigma, kappa), 0.0)
        return np.where(d > 0, lf, ls) - ls0
    return ll


def _analytic(kind: str):
    from ..functions.gengamma import gg_row_derivs

    def derivs(eta: np.ndarray, data: dict):
        n = eta.shape[0]
        kappa = eta[:, 2] if kind == "ggamma" else np.ones(n)
        return gg_row_derivs(eta[:, 0], eta[:, 1], kappa, data["t0"], data["t"], data["d"], kind == "ggamma")
    return derivs


def family_model(kind: str) -> RowModel:
    m = {"exponential": 1, "weibull": 2, "lognormal": 2, "ggamma": 3, "ammag": 2, "gamma": 2}[kind]
    derivs = _analytic(kind) if kind in ("weibull", "ggamma") else None
    return RowModel(kind, m, ("t0", "t", "d"), row_loglik(kind), derivs=derivs)


def model_frame(df: DataFrame, spec: SurvSpec, columns: Sequence[str], weight: str | None = None,
                keep: Sequence[str] = ()) -> DataFrame:
    """Valid rows (0 <= entry < exit, times known) with t0, t, d and double covariates."""
    t0 = F.greatest(F.coalesce(F.col(spec.start).cast("double"), F.lit(0.0)), F.lit(0.0))
    t = F.col(spec.stop).cast("double")
    ev = F.col(spec.event)
    cols = [t0.alias("t0"), t.alias("t"), F.when(ev.isNotNull() & (ev != 0), 1.0).otherwise(0.0).alias("d")]
    cols += [F.col(c).cast("double").alias(c) for c in dict.fromkeys(columns)]
    if weight:
        cols.append(F.col(weight).cast("double").alias(weight))
    cols += [F.col(c) for c in keep]
    d = df.select(*cols).filter(F.col("t").isNotNull() & (F.col("t") > F.col("t0")))
    for c in dict.fromkeys(columns):
        d = d.filter(F.col(c).isNotNull())
    return d


def _equations(kind, terms, lnsigma, kappa):
    eqs = [("mu", list(terms) + [CONS])]
    if kind != "exponential":
        eqs.append(("lnsigma", list(lnsigma or []) + [CONS]))
    if kind == "ggamma":
        eqs.append(("kappa", list(kappa or []) + [CONS]))
    return eqs


def aft(df: DataFrame, spec: SurvSpec, terms: Sequence[str] = (), dist: str = "weibull",
        lnsigma: Sequence[str] = (), kappa: Sequence[str] = (), weight: str | None = None,
        max_iter: int = 50, start: FitResult | None = None, name: str | None = None, tol: float = 1e-10,
        prepared: bool = False) -> FitResult:
    """Fit an AFT model; returns a FitResult (driver handle of one fits-table row).
    ``tol`` bounds the scaled gradient at which Newton's method stops.

    With ``start`` from a fit of the same data, its design is reused. A large design is gathered on time nodes, so that
    rounds do not grow with the rows; ``prepared`` says that ``df`` is a checkpoint, from which the few passes that are
    left read the design without writing it again."""
    if dist not in FAMILIES:
        raise ValueError(dist)
    if dist != "ggamma" and kappa:
        raise ValueError("kappa terms need dist='ggamma'")
    cols = list(dict.fromkeys(list(terms) + list(lnsigma) + list(kappa)))
    reuse = start is not None and start.extra.get("design") is not None and \
        set(cols) <= set(start.extra.get("design_cols", ())) and start.extra.get("weight") == weight
    design = start.extra["design"] if reuse else (model_frame if prepared else materialize_cols)(df, spec, cols, weight)
    eqs = _equations(dist, terms, lnsigma, kappa)
    wcol = F.col(weight) if weight else F.lit(1.0)

    def totals():
        return design.agg(F.sum(wcol * (F.col("t") - F.col("t0"))).alias("T"), F.sum(wcol * F.col("d")).alias("D"),
                          F.sum(wcol).alias("N"), F.sum(wcol * F.col("d") * F.log("t")).alias("SLT"), F.count(F.lit(1)).alias("rows"),
                          F.approx_count_distinct(F.struct(*cols) if cols else F.lit(1)).alias("patterns")).collect()[0]

    stats = totals()
    model = family_model(dist)
    smooth = model.derivs is not None  # differences of sums over nodes would lose digits
    gathered = start.extra.get("gathered") if reuse and smooth and set(cols) == set(start.extra["design_cols"]) else None
    if gathered is None and smooth and stats["rows"] > max(SMALL_DESIGN, stats["patterns"] * PATTERN_ROWS):
        gathered = gather_once(design, cols, weight)
    if gathered is None and prepared and not reuse:
        design = materialize(design, spread=True)
        stats = totals()  # summed in the order of the rounds
    T, D, N, SLT = (float(stats[k] or 0.0) for k in ("T", "D", "N", "SLT"))
    names = [(eq, t) for eq, ts in eqs for t in ts]
    theta0 = np.zeros(len(names))
    theta0[names.index(("mu", CONS))] = np.log(T / D) if D > 0 and T > 0 else 0.0
    if dist == "ggamma":
        theta0[names.index(("kappa", CONS))] = 1.0
    if start is not None:
        for i, nm in enumerate(names):
            if nm in start.names:
                theta0[i] = start.params[start.names.index(nm)]
    (theta, ll, g, H, vcov, conv, it), used = fit_distributed(design, model, eqs, theta0, weight, max_iter=max_iter, checkpoint=False,
                                                              tol=tol, gathered=gathered)
    return FitResult(name or dist, eqs, theta, vcov, float(ll), int(N), D, conv, it,
                     extra={"dist": dist, "loglik_logtime": float(ll) + SLT, "scale": "density",
                            "design": used, "design_cols": cols, "weight": weight, "gathered": gathered, "prepared": prepared})


def aft_ggamma(df, spec, terms=(), lnsigma=(), kappa=(), weight=None, max_iter=50, name=None, prepared=False) -> FitResult:
    """GG fit started from the Weibull fit of the same mean terms (kappa = 1)."""
    cols = list(dict.fromkeys(list(terms) + list(lnsigma) + list(kappa)))
    w = aft(df, spec, terms, "weibull", lnsigma=lnsigma, weight=weight, max_iter=max_iter, prepared=prepared)
    if set(cols) - set(w.extra["design_cols"]):
        w.extra |= {"design": materialize_cols(df, spec, cols, weight), "design_cols": cols, "gathered": None}
    return aft(df, spec, terms, "ggamma", lnsigma=lnsigma, kappa=kappa, weight=weight, max_iter=max_iter,
               start=w, name=name or "ggamma", prepared=prepared)


def materialize_cols(df, spec, cols, weight):
    return materialize(model_frame(df, spec, cols, weight), spread=True)


def aft_by(df: DataFrame, spec: SurvSpec, by: str, dist: str = "ggamma", terms: Sequence[str] = (), lnsigma: Sequence[str] = (),
           kappa: Sequence[str] = (), max_iter: int = 50, tol: float = 1e-10) -> DataFrame:
    """M7: one model per stratum, however many strata: each has its own coefficients, covariance, log-likelihood and
    convergence flag, and all are fitted in the same passes (plans/strata.py).

    Returns by, terms, beta, vcov, loglik, n, events, converged, iterations. Rows whose stratum is null, or that the model
    cannot use (see model_frame), are left out. A stratum without events has no fit: null coefficients, not converged."""
    if dist not in FAMILIES:
        raise ValueError(dist)
    name, by = by, "_stratum"
    cols = list(dict.fromkeys([*terms, *lnsigma, *kappa]))
    eqs = _equations(dist, terms, lnsigma, kappa)
    design = materialize(model_frame(df.withColumn(by, F.col(name)).where(F.col(by).isNotNull()), spec, cols, keep=[by]))
    per = materialize(design.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("events"),
                                             F.sum(F.col("t") - F.col("t0")).alias("_T")))
    strata = per.count()

    def start(eqs, known=None):
        """Constant of mu ln(T / D), kappa 1, all else 0; or another fit's coefficients where it has them."""
        values = []
        for eq, ts in eqs:
            for t in ts:
                x = F.log(F.col("_T") / F.col("events")) if (eq, t) == ("mu", CONS) else F.lit(1.0 if (eq, t) == ("kappa", CONS) else 0.0)
                if known is not None and eq != "kappa":
                    x = F.element_at("theta", [(e, u) for e, us in known for u in us].index((eq, t)) + 1)
                values.append(x.cast("double"))
        return F.when((F.col("events") > 0) & (F.col("_T") > 0), F.array(*values))

    def fit(kind, eqs, begin):
        return newton_by(design, by, family_model(kind), eqs, begin, strata, max_iter, tol)

    if dist == "ggamma":  # Weibull first
        weibull = _equations("weibull", terms, lnsigma, ())
        first = fit("weibull", weibull, per.select(by, start(weibull).alias("cand")))
        state = fit(dist, eqs, per.join(first.select(by, "theta"), by).select(by, start(eqs, weibull).alias("cand")))
    else:
        state = fit(dist, eqs, per.select(by, start(eqs).alias("cand")))
    names = [f"{eq}:{t}" for eq, ts in eqs for t in ts]
    done = inverse(state, by, len(names))
    return per.join(done, by).select(F.col(by).alias(name), F.array(*map(F.lit, names)).alias("terms"), F.col("theta").alias("beta"), "vcov",
                                     F.col("ll").alias("loglik"), "n", F.col("events").cast("long").alias("events"),
                                     F.col("conv").alias("converged"), F.col("it").alias("iterations"))


def by_params(fits: DataFrame, by: str, dist: str = "ggamma") -> DataFrame:
    """by, mu, sigma, kappa, converged of aft_by fits without covariates; nulls where a stratum did not converge."""
    at = {eq: F.when(F.col("converged"), F.element_at("beta", i + 1))
          for i, (eq, _ts) in enumerate(_equations(dist, (), (), ()))}
    sigma = F.exp(at["lnsigma"]) if "lnsigma" in at else F.when(F.col("converged"), F.lit(1.0))
    kappa = {"ggamma": at.get("kappa"), "ammag": 1 / sigma, "gamma": sigma}.get(
        dist, F.when(F.col("converged"), F.lit(0.0 if dist == "lognormal" else 1.0)))
    return fits.select(by, at["mu"].alias("mu"), sigma.alias("sigma"), kappa.alias("kappa"), "converged")


# ------------------------------------------------------------------ params per group
def group_params(fit: FitResult, groups: Sequence, group_terms: dict) -> list[dict]:
    """(mu, sigma, kappa) per group from a fit whose group effects are dummies.

    ``group_terms`` maps group -> dummy name (None for the base group)."""
    out = []
    dist = fit.extra.get("dist", "ggamma")
    for gval in groups:
        term = group_terms.get(gval)
        def lin(eq):
            if (eq, CONS) not in fit.names:
                return None
            v = fit.coef(eq, CONS)
            if term is not None and (eq, term) in fit.names:
                v += fit.coef(eq, term)
            return v
        mu = lin("mu")
        lns = lin("lnsigma")
        sigma = float(np.exp(lns)) if lns is not None else 1.0
        if dist == "ggamma":
            kappa = lin("kappa")
        elif dist == "ammag":
            kappa = 1.0 / sigma
        elif dist == "gamma":
            kappa = sigma
        elif dist == "lognormal":
            kappa = 0.0
        else:
            kappa = 1.0
        out.append({"group": gval, "mu": mu, "sigma": sigma, "kappa": kappa})
    return out


# ------------------------------------------------------------------ M10, M12 columns
@F.pandas_udf(DoubleType())
def gg_survival_udf(t: pd.Series, mu: pd.Series, sigma: pd.Series, kappa: pd.Series) -> pd.Series:
    return pd.Series(gg_survival(t.to_numpy(float), mu.to_numpy(float), sigma.to_numpy(float), kappa.to_numpy(float)))


@F.pandas_udf(DoubleType())
def gg_hazard_udf(t: pd.Series, mu: pd.Series, sigma: pd.Series, kappa: pd.Series) -> pd.Series:
    return pd.Series(gg_hazard(t.to_numpy(float), mu.to_numpy(float), sigma.to_numpy(float), kappa.to_numpy(float)))


def linear_predictor(fit: FitResult, eq: str) -> Column:
    expr = F.lit(0.0)
    for (e, t), b in zip(fit.names, fit.params):
        if e != eq:
            continue
        expr = expr + (F.lit(float(b)) if t == CONS else F.lit(float(b)) * F.col(t).cast("double"))
    return expr


def predict(fit: FitResult, df: DataFrame, time_col: str, kind: str = "survival", out: str | None = None) -> DataFrame:
    """Fitted survival or hazard per row (Arrow-batched pandas UDF; parameters
    come from the fit, never re-typed constants)."""
    dist = fit.extra.get("dist", "ggamma")
    mu = linear_predictor(fit, "mu")
    if dist == "exponential":
        sigma = F.lit(1.0)
    else:
        sigma = F.exp(linear_predictor(fit, "lnsigma"))
    kappa = {"ggamma": linear_predictor(fit, "kappa") if dist == "ggamma" else None,
             "weibull": F.lit(1.0), "exponential": F.lit(1.0), "lognormal": F.lit(0.0),
             "ammag": F.lit(1.0) / sigma, "gamma": sigma}[dist]
    t = F.col(time_col).cast("double")
    from ..session import ship_code
    ship_code(df.sparkSession)
    fn = gg_survival_udf if kind == "survival" else gg_hazard_udf
    return df.withColumn(out or kind, fn(t, mu, sigma, kappa))


def gg_taxonomy(sigma, kappa, tol: float = 1e-9) -> Column:
    """Hazard shape of a generalized gamma as a column expression.

    h(0) -> 0 when kappa < 1/sigma and -> inf when kappa > 1/sigma; for large t
    h increases when kappa > sigma and decreases when kappa < sigma."""
    s = F.col(sigma) if isinstance(sigma, str) else sigma
    k = F.col(kappa) if isinstance(kappa, str) else kappa
    inv = F.lit(1.0) / s
    near = lambda a, b: F.abs(a - b) < F.lit(tol)
    return (F.when(near(k, F.lit(1.0)) & near(s, F.lit(1.0)), "exponential")
            .when(near(k, F.lit(1.0)), "weibull")
            .when(near(k, F.lit(0.0)), "lognormal")
            .when(near(k, s), "gamma")
            .when(near(k, inv), "ammag")
            .when(k < F.least(s, inv), "arc")
            .when(k > F.greatest(s, inv), "bathtub")
            .when(s < 1, "increasing")
            .otherwise("decreasing"))
