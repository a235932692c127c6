"""Generalized gamma (AFT form: mu, sigma, kappa = Q) and its special cases.

With w = (ln t - mu) / sigma, psi = kappa^-2 and x = psi * exp(kappa * w):
  kappa > 0: S = Q(psi, x);  kappa < 0: S = P(psi, x);  kappa = 0: lognormal.
  ln f = ln|kappa| - ln sigma - ln t + psi ln x - x - ln Gamma(psi)
kappa = 1 is the Weibull, kappa = sigma the standard gamma, kappa = 1/sigma
the 'ammag', sigma = kappa = 1 the exponential.
"""

from __future__ import annotations

import numpy as np

from .special import gammainc_inv_lower, log_gamma, log_gammainc, norm_logpdf, norm_logsf, norm_ppf

KAPPA_LOGNORMAL = 1e-6  # |kappa| below this uses the lognormal limit


def _arr(*xs):
    return np.broadcast_arrays(*[np.asarray(x, float) for x in xs])


def gg_log_surv(t, mu, sigma, kappa):
    t, mu, sigma, kappa = _arr(t, mu, sigma, kappa)
    out = np.zeros(t.shape)
    pos = t > 0
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        w = np.where(pos, (np.log(np.where(pos, t, 1.0)) - mu) / sigma, -np.inf)
        ln = np.abs(kappa) < KAPPA_LOGNORMAL
        if np.any(ln):
            out[ln] = np.where(pos[ln], norm_logsf(np.where(pos[ln], w[ln], 0.0)), 0.0)
        g = ~ln
        if np.any(g):
            k = kappa[g]
            psi = 1.0 / (k * k)
            x = psi * np.exp(np.clip(k * w[g], -700, 700))
            lp, lq = log_gammainc(psi, x)
            out[g] = np.where(k > 0, lq, lp)
            out[g] = np.where(pos[g], out[g], 0.0)
    return out


def gg_log_density(t, mu, sigma, kappa):
    t, mu, sigma, kappa = _arr(t, mu, sigma, kappa)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        lt = np.log(np.where(t > 0, t, np.nan))
        w = (lt - mu) / sigma
        ln = np.abs(kappa) < KAPPA_LOGNORMAL
        out = np.empty(t.shape)
        out[ln] = norm_logpdf(w[ln]) - np.log(sigma[ln]) - lt[ln]
        g = ~ln
        k = kappa[g]
        psi = 1.0 / (k * k)
        kw = np.clip(k * w[g], -700, 700)
        lx = np.log(psi) + kw
        x = np.exp(lx)
        out[g] = np.log(np.abs(k)) - np.log(sigma[g]) - lt[g] + psi * lx - x - log_gamma(psi)
    return out


def gg_survival(t, mu, sigma, kappa):
    return np.exp(gg_log_surv(t, mu, sigma, kappa))


def gg_hazard(t, mu, sigma, kappa):
    """h = f / S in log space; at t = 0 the limit is not formed (NaN), as in the reference."""
    t = np.asarray(t, float)
    with np.errstate(invalid="ignore", over="ignore"):
        h = np.exp(gg_log_density(t, mu, sigma, kappa) - gg_log_surv(t, mu, sigma, kappa))
    return np.where(t > 0, h, np.nan)


def gg_quantile(p, mu, sigma, kappa):
    """Failure-time quantile t with F(t) = p."""
    p, mu, sigma, kappa = _arr(p, mu, sigma, kappa)
    w = np.empty(p.shape)
    ln = np.abs(kappa) < KAPPA_LOGNORMAL
    w[ln] = norm_ppf(p[ln])
    g = ~ln
    k = kappa[g]
    psi = 1.0 / (k * k)
    pp = np.where(k > 0, p[g], 1.0 - p[g])
    x = gammainc_inv_lower(psi, pp)
    w[g] = np.log(x / psi) / k
    return np.exp(mu + sigma * w)


def gg_taxonomy_label(sigma, kappa, tol=1e-9):
    """Hazard shape of GG(sigma, kappa) (numpy twin of the Column version in operators.aft)."""
    s, k = float(sigma), float(kappa)
    if abs(k - 1) < tol and abs(s - 1) < tol:
        return "exponential"
    if abs(k - 1) < tol:
        return "weibull"
    if abs(k) < tol:
        return "lognormal"
    if abs(k - s) < tol:
        return "gamma"
    if abs(k - 1 / s) < tol:
        return "ammag"
    lo, hi = min(s, 1 / s), max(s, 1 / s)
    if k < lo:
        return "arc"
    if k > hi:
        return "bathtub"
    return "increasing" if s < 1 else "decreasing"


def _term_w(t, mu, sigma, kappa, kind):
    """A log-survival or log-density term as a function of w = (ln t - mu)/sigma:
    returns (w, T, T_w, T_ww); the density term excludes -ln sigma."""
    from .special import log_gamma, log_gammainc, norm_logpdf, norm_logsf
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        lt = np.log(t)
        w = (lt - mu) / sigma
        n = len(t)
        T = np.empty(n); Tw = np.empty(n); Tww = np.empty(n)
        ln = np.abs(kappa) < KAPPA_LOGNORMAL
        if np.any(ln):
            wl = w[ln]
            if kind == "surv":
                ls = norm_logsf(wl)
                A = -np.exp(norm_logpdf(wl) - ls)
                T[ln], Tw[ln], Tww[ln] = ls, A, A * (-wl - A)
            else:
                T[ln], Tw[ln], Tww[ln] = norm_logpdf(wl) - lt[ln], -wl, -1.0
        g = ~ln
        if np.any(g):
            k = kappa[g]
            psi = 1.0 / (k * k)
            kw = np.clip(k * w[g], -700, 700)
            lx = np.log(psi) + kw
            x = np.exp(lx)
            lxg = psi * lx - x - log_gamma(psi)
            if kind == "surv":
                lp, lq = log_gammainc(psi, x)
                ls = np.where(k > 0, lq, lp)
                A = -np.abs(k) * np.exp(lxg - ls)
                T[g], Tw[g], Tww[g] = ls, A, A * (k * (psi - x) - A)
            else:
                T[g] = np.log(np.abs(k)) - lt[g] + lxg
                Tw[g] = k * (psi - x)
                Tww[g] = -k * k * x
    return w, T, Tw, Tww


def gg_row_derivs(mu, lns, kappa, t0, t, d, fit_kappa: bool, h: float = 1e-4):
    """Row log-likelihood of the GG (or Weibull when kappa = 1 is fixed) with
    delayed entry, and its first/second derivatives in (mu, ln sigma[, kappa]).

    mu/ln-sigma derivatives are analytic through w; kappa derivatives are
    central differences (the incomplete gamma has no simple kappa-derivative)."""
    sigma = np.exp(lns)
    n = len(t)
    m = 3 if fit_kappa else 2
    f0 = np.zeros(n); g = np.zeros((n, m)); H = np.zeros((n, m, m))
    ev = d > 0
    ent = t0 > 0
    terms = []  # (mask, sign, kind, time)
    terms.append((ev, 1.0, "dens", t))
    terms.append((~ev, 1.0, "surv", t))
    terms.append((ent, -1.0, "surv", np.where(ent, t0, 1.0)))
    for mask, sgn, kind, tt in terms:
        if not np.any(mask):
            continue
        idx = np.where(mask)[0]
        a = (tt[idx], mu[idx], sigma[idx], kappa[idx])
        w, T, Tw, Tww = _term_w(*a, kind)
        f0[idx] += sgn * T
        s_ = sigma[idx]
        gm = -Tw / s_
        gs = -Tw * w
        hmm = Tww / s_ ** 2
        hms = Tww * w / s_ + Tw / s_
        hss = Tww * w * w + Tw * w
        g[idx, 0] += sgn * gm; g[idx, 1] += sgn * gs
        H[idx, 0, 0] += sgn * hmm; H[idx, 0, 1] += sgn * hms; H[idx, 1, 0] += sgn * hms; H[idx, 1, 1] += sgn * hss
        if fit_kappa:
            kp, km = kappa[idx] + h, kappa[idx] - h
            _, Tp, Twp, _ = _term_w(a[0], a[1], a[2], kp, kind)
            _, Tm, Twm, _ = _term_w(a[0], a[1], a[2], km, kind)
            Tk = (Tp - Tm) / (2 * h)
            Tkk = (Tp - 2 * T + Tm) / (h * h)
            Twk = (Twp - Twm) / (2 * h)
            g[idx, 2] += sgn * Tk
            H[idx, 2, 2] += sgn * Tkk
            H[idx, 0, 2] += sgn * (-Twk / s_); H[idx, 2, 0] += sgn * (-Twk / s_)
            H[idx, 1, 2] += sgn * (-Twk * w); H[idx, 2, 1] += sgn * (-Twk * w)
    # explicit -ln sigma of the density
    f0 -= np.where(ev, lns, 0.0)
    g[:, 1] -= ev.astype(float)
    return f0, g, H
