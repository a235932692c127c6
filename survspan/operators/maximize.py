"""Maximum likelihood for a likelihood of one's own (M9), and what follows from its fits.

A row log-likelihood is a function of the linear predictors and of data columns, written for
``functions.jets``: its derivatives are exact. Every Newton iteration is one Spark pass in Arrow batches; only
sums of the size of the parameters reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jets
from ..functions.jets import Jet
from ..plans.likelihood import CONS, FitResult, RowModel, fit_distributed
from ..plans.scan import materialize
from ..session import ship_code
from .infer import Z975, p_chi2, p_normal


def maximize(df: DataFrame, loglik_fn: Callable[[dict[str, Jet], dict[str, np.ndarray]], Jet],
             equations: Sequence[tuple[str, Sequence[str]]], data: Sequence[str], start: Mapping[str, float] | None = None,
             weight: str | None = None, max_iter: int = 50, tol: float = 1e-18, name: str = "ml") -> FitResult:
    """Fit the coefficients of `equations` ((equation, terms); CONS is the constant) by the sum of loglik_fn over rows.

    loglik_fn(eta, data): eta has a Jet per equation, data an array per column of `data`; both by row. start: values by
    "equation:term", 0 where it says nothing. Rows with a null in a column that is used are left out; a fit whose
    likelihood is not finite, or whose information is singular, comes back with converged = False."""
    eqs = [(eq, list(terms)) for eq, terms in equations]
    terms = [t for _eq, ts in eqs for t in ts if t != CONS]
    columns = list(dict.fromkeys([*data, *terms, *([weight] if weight else [])]))
    design = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()

    def derivs(eta: np.ndarray, values: dict):
        out = loglik_fn(dict(zip([eq for eq, _ in eqs], Jet.variables(eta))), values)
        return out.v, out.g, out.h

    model = RowModel(name, len(eqs), tuple(data), lambda eta, values: derivs(eta, values)[0], tuple(eq for eq, _ in eqs), derivs)
    theta0 = np.array([float((start or {}).get(f"{eq}:{t}", 0.0)) for eq, ts in eqs for t in ts])
    design = materialize(design, spread=True)
    n = design.count()
    (theta, ll, g, _h, vcov, conv, it), _ = fit_distributed(design, model, eqs, theta0, weight, max_iter, checkpoint=False, tol=tol)
    if conv and n:  # the last quadratic step: the tolerances above stop a little short of it
        (near, l2, g2, _h, v2, _c, _i), _ = fit_distributed(design, model, eqs, theta, weight, 1, checkpoint=False, tol=0.0)
        if np.isfinite(l2) and np.abs(g2).max() <= np.abs(g).max():
            theta, ll, g, vcov = near, l2, g2, v2
    return FitResult(name, eqs, theta, vcov, float(ll), n, float(n), bool(conv and n), it, extra={"dist": "ml", "score": g})


def gengamma_loglik(shape: Callable[[Jet], Jet]) -> Callable:
    """Row log-likelihood with delayed entry of a generalised gamma whose shape is a function of ln sigma:
    shape = exp(-ln sigma) is the ammag, exp(ln sigma) the standard gamma. Data: t0, t, d."""
    def loglik(eta: dict[str, Jet], data: dict[str, np.ndarray]) -> Jet:
        mu, lnsigma = eta["mu"], eta["lnsigma"]
        kappa = shape(lnsigma)
        a = kappa ** -2

        def scaled(t):
            return a * jets.exp(kappa * (-mu + np.log(t)) * jets.exp(-lnsigma))

        t0, t, d = data["t0"], data["t"], data["d"]
        x = scaled(t)
        # ln f = ln kappa + ln x + (a - 1) ln x - x - ln Gamma(a) - ln sigma - ln t
        density = jets.log(kappa) + a * jets.log(x) - x - jets.lgamma(a) - lnsigma - np.log(t)
        entered = t0 > 0
        entry = jets.log_gamma_sf(a, scaled(np.where(entered, t0, 1.0)))
        return jets.where(d > 0, density, jets.log_gamma_sf(a, x)) - jets.where(entered, entry, 0.0)

    return loglik


def ammag(lnsigma: Jet) -> Jet:
    return jets.exp(-lnsigma)


def standard_gamma(lnsigma: Jet) -> Jet:
    return jets.exp(lnsigma)


# ------------------------------------------------------------------ functions of coefficients
def _evaluated(row, fn) -> tuple[np.ndarray, np.ndarray]:
    """(values, Jacobian) of fn at a fit row's coefficients."""
    beta = np.asarray(row.beta, float)
    out = fn(dict(zip(row.terms, Jet.variables(beta[None]))))
    out = out if isinstance(out, (list, tuple)) else [out]
    return np.array([x.v[0] for x in out]), np.stack([x.g[0] for x in out])


def _usable(row) -> bool:
    return row.beta is not None and row.vcov is not None and bool(row.converged)


def nlcom(fits: DataFrame, functions: Mapping[str, Callable[[dict[str, Jet]], Jet]]) -> DataFrame:
    """Any function of a fit's coefficients, with its delta-method se, z, p and 95 % limits.

    A function gets a Jet per term ("equation:term"). Fits that lack a term it names, that did not converge
    or have no covariance give nulls."""
    ship_code(fits.sparkSession)
    made = list(functions.items())

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                for name, fn in made:
                    value = se = None
                    if _usable(row):
                        try:
                            v, j = _evaluated(row, fn)
                            p = len(row.beta)
                            value, se = float(v[0]), float(np.sqrt(max(0.0, (j @ np.asarray(row.vcov, float).reshape(p, p) @ j.T)[0, 0])))
                        except KeyError:
                            pass
                    out.append((row.model, name, value, se))
            yield pd.DataFrame(out, columns=["model", "contrast", "estimate", "se"]).astype({"estimate": float, "se": float})

    got = fits.select("model", "terms", "beta", "vcov", "converged").mapInPandas(work, "model string, contrast string, estimate double, se double")
    z = F.try_divide("estimate", "se")
    return got.select("model", "contrast", "estimate", "se", z.alias("z"), p_normal(z).alias("p"),
                      (F.col("estimate") - Z975 * F.col("se")).alias("lo"), (F.col("estimate") + Z975 * F.col("se")).alias("hi"))


def wald_constraints(fits: DataFrame, tests: Mapping[str, Callable[[dict[str, Jet]], Jet | Sequence[Jet]]]) -> DataFrame:
    """Joint Wald tests of constraints fn(b) = 0: chi2 = c' (J V J')^-1 c. Nulls as in nlcom, or where J V J' is singular."""
    ship_code(fits.sparkSession)
    made = list(tests.items())

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                for name, fn in made:
                    chi2 = df = None
                    if _usable(row):
                        try:
                            c, j = _evaluated(row, fn)
                            p = len(row.beta)
                            chi2, df = float(c @ np.linalg.solve(j @ np.asarray(row.vcov, float).reshape(p, p) @ j.T, c)), len(c)
                        except (KeyError, np.linalg.LinAlgError):
                            pass
                    out.append((row.model, name, chi2, df))
            yield pd.DataFrame(out, columns=["model", "test", "chi2", "df"]).astype({"chi2": float, "df": "Int32"})

    got = fits.select("model", "terms", "beta", "vcov", "converged").mapInPandas(work, "model string, test string, chi2 double, df int")
    return got.select("model", "test", "chi2", "df", p_chi2(F.col("df").cast("double"), F.col("chi2")).alias("p"))


# The special cases of a generalised gamma as constraints on its kappa and ln sigma.
SPECIAL_CASES = {
    "weibull": lambda b: b[f"kappa:{CONS}"] - 1.0,
    "lognormal": lambda b: b[f"kappa:{CONS}"],
    "gamma": lambda b: b[f"kappa:{CONS}"] - jets.exp(b[f"lnsigma:{CONS}"]),
    "ammag": lambda b: b[f"kappa:{CONS}"] - jets.exp(-b[f"lnsigma:{CONS}"]),
    "exponential": lambda b: [b[f"kappa:{CONS}"] - 1.0, b[f"lnsigma:{CONS}"]],
}


def special_cases(fits: DataFrame) -> DataFrame:
    """Wald test of each special case, one row per fit and case."""
    return wald_constraints(fits, SPECIAL_CASES)


def weibull_hazard_ratios(fits: DataFrame, terms: Sequence[str]) -> DataFrame:
    """M8: hazard ratios exp(-b / sigma) of a Weibull in time coefficients, with delta-method se; z, p and limits are those of
    the log hazard ratio."""
    def log_ratio(term):
        return lambda b: -b[f"mu:{term}"] * jets.exp(-b[f"lnsigma:{CONS}"])

    got = nlcom(fits, {t: log_ratio(t) for t in terms})
    hr = F.exp("estimate")
    return got.select("model", F.col("contrast").alias("term"), hr.alias("hazard_ratio"), (hr * F.col("se")).alias("se"), "z", "p",
                      F.exp("lo").alias("lo"), F.exp("hi").alias("hi"))
