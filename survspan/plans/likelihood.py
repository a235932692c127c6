"""Distributed maximum likelihood for row-additive models (the M9 surface).

A model gives a vectorised row log-likelihood l(eta; data) of m linear
predictors (eta_j = X_j beta_j).  One Newton iteration is ONE Spark job:
``mapInPandas`` evaluates l and its eta-derivatives (central finite
differences in m dimensions; m <= 3, so 1 + 2m + 2m(m-1) evaluations per row),
applies the chain rule to the coefficients inside the task, and emits one
partial (loglik, gradient, Hessian) vector per task; ``groupBy(k).sum`` adds
them.  Only p + p^2 + 1 numbers reach the driver, which takes the Newton step
(p is at most a few dozen).  The design is checkpointed once so iterations do
not recompute the input lineage.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import materialize

CONS = "_cons"
FD_STEP = 1e-4


@dataclass
class RowModel:
    name: str
    n_eta: int
    data_cols: tuple          # e.g. ("t0", "t", "d")
    loglik: Callable          # (eta: (n, m) array, data: dict[str, array]) -> (n,) array
    eq_names: tuple = ("mu", "lnsigma", "kappa")
    derivs: Callable | None = None   # optional analytic (eta, data) -> (l, dl/deta, d2l/deta2)


@dataclass
class FitResult:
    model: str
    equations: list            # [(eq_name, [term, ...]), ...]
    params: np.ndarray
    vcov: np.ndarray
    loglik: float
    n: int
    events: float
    converged: bool
    iterations: int
    extra: dict = field(default_factory=dict)

    @property
    def names(self) -> list[tuple[str, str]]:
        return [(eq, t) for eq, terms in self.equations for t in terms]

    @property
    def k(self) -> int:
        return len(self.params)

    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.vcov), 0, None))

    def coef(self, eq: str, term: str) -> float:
        return float(self.params[self.names.index((eq, term))])

    def index(self, eq: str, term: str) -> int:
        return self.names.index((eq, term))


def _design_arrays(pdf: pd.DataFrame, equations) -> list[np.ndarray]:
    out = []
    n = len(pdf)
    for _eq, terms in equations:
        cols = [np.ones(n) if t == CONS else pdf[t].to_numpy(dtype=float) for t in terms]
        out.append(np.column_stack(cols) if cols else np.zeros((n, 0)))
    return out


def _eta_derivs(model: RowModel, eta: np.ndarray, data: dict, h: float = FD_STEP):
    """l, dl/deta (n, m), d2l/deta2 (n, m, m): the model's own derivatives when
    it has them, else central differences."""
    if model.derivs is not None:
        return model.derivs(eta, data)
    n, m = eta.shape
    f0 = model.loglik(eta, data)
    g = np.zeros((n, m))
    H = np.zeros((n, m, m))
    fp, fm = [], []
    for j in range(m):
        e = eta.copy(); e[:, j] += h; fp.append(model.loglik(e, data))
        e = eta.copy(); e[:, j] -= h; fm.append(model.loglik(e, data))
        g[:, j] = (fp[j] - fm[j]) / (2 * h)
        H[:, j, j] = (fp[j] - 2 * f0 + fm[j]) / (h * h)
    for j in range(m):
        for k in range(j + 1, m):
            e = eta.copy(); e[:, j] += h; e[:, k] += h; fpp = model.loglik(e, data)
            e = eta.copy(); e[:, j] += h; e[:, k] -= h; fpm = model.loglik(e, data)
            e = eta.copy(); e[:, j] -= h; e[:, k] += h; fmp = model.loglik(e, data)
            e = eta.copy(); e[:, j] -= h; e[:, k] -= h; fmm = model.loglik(e, data)
            H[:, j, k] = H[:, k, j] = (fpp - fpm - fmp + fmm) / (4 * h * h)
    return f0, g, H


def batch_stats(model: RowModel, equations, theta: np.ndarray, pdf: pd.DataFrame, weight: str | None):
    """(loglik, grad, hess) of one Arrow batch; pure numpy (also used by in-task fits)."""
    Xs = _design_arrays(pdf, equations)
    sizes = [x.shape[1] for x in Xs]
    offs = np.cumsum([0] + sizes)
    p = offs[-1]
    eta = np.column_stack([Xs[j] @ theta[offs[j]:offs[j + 1]] for j in range(len(Xs))])
    data = {c: pdf[c].to_numpy(dtype=float) for c in model.data_cols}
    w = pdf[weight].to_numpy(dtype=float) if weight else np.ones(len(pdf))
    f0, g, H = _eta_derivs(model, eta, data)
    ll = float(np.sum(w * f0))
    grad = np.zeros(p)
    hess = np.zeros((p, p))
    for j in range(len(Xs)):
        grad[offs[j]:offs[j + 1]] = Xs[j].T @ (w * g[:, j])
        for k in range(len(Xs)):
            hess[offs[j]:offs[j + 1], offs[k]:offs[k + 1]] = Xs[j].T @ (Xs[k] * (w * H[:, j, k])[:, None])
    return ll, grad, hess


def evaluate(design: DataFrame, model: RowModel, equations, theta: np.ndarray, weight: str | None = None):
    """One Spark job: summed (loglik, gradient, Hessian) at theta."""
    p = len(theta)
    th = np.array(theta, dtype=float)

    def part(it):
        ll, g, H = 0.0, np.zeros(p), np.zeros((p, p))
        seen = False
        for pdf in it:
            if len(pdf) == 0:
                continue
            a, b, c = batch_stats(model, equations, th, pdf, weight)
            ll += a; g += b; H += c
            seen = True
        if seen:
            vec = np.concatenate([[ll], g, H.ravel()])
            yield pd.DataFrame({"k": np.arange(len(vec), dtype=np.int32), "v": vec})

    from ..session import ship_code
    ship_code(design.sparkSession)
    parts = design.mapInPandas(part, schema="k int, v double")
    rows = parts.groupBy("k").agg(F.sum("v").alias("v")).collect()
    vec = np.zeros(1 + p + p * p)
    for r in rows:
        vec[r["k"]] = np.nan if r["v"] is None else r["v"]  # Arrow turns NaN into null
    return vec[0], vec[1:1 + p], vec[1 + p:].reshape(p, p)


def _decrement(g: np.ndarray, H: np.ndarray) -> float:
    """Scaled gradient g' (-H)^-1 g (inf when -H is not positive definite)."""
    try:
        L = np.linalg.cholesky(-H)
    except np.linalg.LinAlgError:
        return float("inf")
    v = np.linalg.solve(L, g)
    return float(v @ v)


def _full_step(g: np.ndarray, H: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(-H, g)
    except np.linalg.LinAlgError:
        return np.full(len(g), np.inf)


def _settled(step: np.ndarray, theta: np.ndarray) -> bool:
    """Whether the full Newton step is small. Where the likelihood rises towards infinity (a
    level without events), the gradient vanishes but the step stays near 1."""
    return bool(np.all(np.isfinite(theta)) and np.max(np.abs(step) / (1.0 + np.abs(theta)), initial=0.0) < 1e-2)


def newton(evalf: Callable, theta0: np.ndarray, max_iter: int = 50, tol: float = 1e-10):
    """Driver-side Newton-Raphson with step halving; evalf(theta) -> (ll, g, H)."""
    theta = np.array(theta0, dtype=float)
    ll, g, H = evalf(theta)
    it = 0
    flat = 0
    converged = False
    for it in range(1, max_iter + 1):
        if not np.isfinite(ll):
            break
        A = -H
        lam = 0.0
        for _ in range(30):
            try:
                L = np.linalg.cholesky(A + lam * np.eye(len(theta)))
                break
            except np.linalg.LinAlgError:
                lam = max(1e-6, lam * 10) if lam else 1e-6 * max(1.0, np.abs(np.diag(A)).max())
        else:
            break
        step = np.linalg.solve(L.T, np.linalg.solve(L, g))
        dec = float(g @ step)
        if dec < tol and lam == 0.0:
            converged = _settled(step, theta)
            break
        t = 1.0
        accepted = False
        for _ in range(25):
            cand = theta + t * step
            ll2, g2, H2 = evalf(cand)
            if np.isfinite(ll2) and ll2 >= ll - 1e-12:
                accepted = True
                break
            t /= 2
        if not accepted:
            break
        change = ll2 - ll
        theta, ll, g, H = cand, ll2, g2, H2
        if abs(change) < 1e-12 and np.max(np.abs(t * step), initial=0.0) < 1e-9:
            converged = bool(np.isfinite(_decrement(g, H)))  # not where the information is singular
            break
        # relative log-likelihood tolerance (1e-7, the common default of ML
        # packages): a coefficient running off to infinity (a group without
        # events) stops here and is reported as not converged
        flat = flat + 1 if abs(change) <= 1e-7 * (1.0 + abs(ll)) else 0
        if flat >= 2:
            converged = _decrement(g, H) < 1e-5 and _settled(_full_step(g, H), theta)
            break
    try:
        vcov = np.linalg.inv(-H)
    except np.linalg.LinAlgError:
        vcov = np.full((len(theta), len(theta)), np.nan)
    return theta, ll, g, H, vcov, converged, it


def fit_distributed(design: DataFrame, model: RowModel, equations, theta0, weight: str | None = None,
                    max_iter: int = 50, checkpoint: bool = True, tol: float = 1e-10, gathered: DataFrame | None = None):
    """Newton fit over ``design``; returns ((theta, ll, g, H, vcov, converged, iterations), design_used).

    With the design's ``gathered`` rows (condense.gather_once), Newton's rounds read these, and the rows confirm the
    maximum: what is returned comes from the rows, which go on from there where they do not agree."""
    if checkpoint:
        design = materialize(design, spread=True)

    def over_rows(start, rounds):
        return newton(lambda th: evaluate(design, model, equations, th, weight), start, max_iter=rounds, tol=tol)

    if gathered is not None:
        from .condense import MASS
        near, *_, found, it = newton(lambda th: evaluate(gathered, model, equations, th, MASS), theta0, max_iter=max_iter, tol=tol)
        if found:
            *fit, converged, more = over_rows(near, max_iter - it + 1)
            if converged:
                return (*fit, converged, it - 1 + more), design
    return over_rows(theta0, max_iter), design


def fit_local(pdf: pd.DataFrame, model: RowModel, equations, theta0, weight: str | None = None, max_iter: int = 50):
    """Same Newton on one in-memory batch (used inside applyInPandas / bootstrap tasks)."""
    return newton(lambda th: batch_stats(model, equations, th, pdf, weight), theta0, max_iter=max_iter)


# ---------------------------------------------------------------- bootstrap
_POIS_CDF = None


def _poisson1_cdf():
    global _POIS_CDF
    if _POIS_CDF is None:
        import math
        c, acc = [], 0.0
        for k in range(30):
            acc += math.exp(-1.0) / math.factorial(k)
            c.append(acc)
        _POIS_CDF = np.array(c)
    return _POIS_CDF


def _splitmix64(x: np.ndarray) -> np.ndarray:
    """Of an array that the caller does not need any more."""
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


_POIS_BITS = 12  # the draw is read from the leading bits, unless a step of the distribution lies among what they leave open
_POIS_TABLE = None


def _poisson1_table():
    global _POIS_TABLE
    if _POIS_TABLE is None:
        edges = np.arange((1 << _POIS_BITS) + 1) / (1 << _POIS_BITS)
        low = np.searchsorted(_poisson1_cdf(), edges[:-1], side="right")
        high = np.searchsorted(_poisson1_cdf(), np.nextafter(edges[1:], 0.0), side="right")
        _POIS_TABLE = np.where(low == high, low, np.nan)
    return _POIS_TABLE


def poisson_weights(row_keys: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """(n, R) Poisson(1) bootstrap weights from a hash of (row key, replicate, seed):
    the same row gets the same weight in a replicate whatever the partitioning."""
    rk = np.asarray(row_keys).astype(np.int64).view(np.uint64)[:, None]
    rp = np.array(reps, dtype=np.uint64)[None, :]
    with np.errstate(over="ignore"):
        mixed = _splitmix64(rk ^ _splitmix64(rp * np.uint64(0x632BE59BD9B4E019) + np.uint64(seed & 0xFFFFFFFFFFFFFFFF)))
    out = _poisson1_table()[mixed >> np.uint64(64 - _POIS_BITS)]
    open_ = np.isnan(out)
    u = (mixed[open_] >> np.uint64(11)).astype(np.float64) * (1.0 / 9007199254740992.0)
    out[open_] = np.searchsorted(_poisson1_cdf(), u, side="right")
    return out


REP_CHUNK = 64  # replicates evaluated together in one kernel call
SMALL_DESIGN = 1 << 14  # rows up to which replicates read the rows themselves
ROW_TILE = 256  # condensed rows evaluated together: the kernel's arrays stay in the cache


def batch_stats_reps(model: RowModel, equations, thetas: np.ndarray, pdf: pd.DataFrame, W: np.ndarray):
    """Per-replicate (loglik, grad, hess) of one batch: all replicates of a chunk in
    one vectorised kernel call.  thetas (R, p), W (n, R) weights."""
    Xs = _design_arrays(pdf, equations)
    sizes = [x.shape[1] for x in Xs]
    offs = np.cumsum([0] + sizes)
    n, R = W.shape
    m = len(Xs)
    eta = np.stack([Xs[j] @ thetas[:, offs[j]:offs[j + 1]].T for j in range(m)], axis=-1)  # (n, R, m)
    data = {c: np.repeat(pdf[c].to_numpy(dtype=float), R) for c in model.data_cols}
    f0, g, H = _eta_derivs(model, eta.reshape(n * R, m), data)
    f0 = f0.reshape(n, R)
    g = g.reshape(n, R, m)
    H = H.reshape(n, R, m, m)
    with np.errstate(invalid="ignore"):
        wf = np.where(W != 0, W * f0, 0.0)
        wg = np.where(W[..., None] != 0, W[..., None] * g, 0.0)
        wH = np.where(W[..., None, None] != 0, W[..., None, None] * H, 0.0)
    p = offs[-1]
    ll = wf.sum(axis=0)
    grad = np.zeros((R, p))
    hess = np.zeros((R, p, p))
    for a in range(m):
        grad[:, offs[a]:offs[a + 1]] = np.einsum("ni,nr->ri", Xs[a], wg[:, :, a])
        for b in range(m):
            hess[:, offs[a]:offs[a + 1], offs[b]:offs[b + 1]] = np.einsum("ni,nr,nk->rik", Xs[a], wH[:, :, a, b], Xs[b])
    return ll, grad, hess


def drawn_weights(pdf: pd.DataFrame, masses: np.ndarray | None, reps: np.ndarray, columns: np.ndarray, seed: int, key_col: str) -> np.ndarray:
    """(n, R): a condensed design's masses where a row has them, else the row's draws with its sign."""
    W = poisson_weights(pdf[key_col].to_numpy(), reps, seed)
    if "_sign" in pdf:
        W *= pdf["_sign"].to_numpy(float)[:, None]
    if masses is not None:
        node = pdf["_mass"].notna().to_numpy()
        W[node] = masses[:, columns]
    return W


def evaluate_reps(design: DataFrame, model: RowModel, equations, thetas: dict, seed: int, key_col: str = "_rk",
                  drawn: Sequence[int] | None = None):
    """One Spark job: (loglik, grad, hess) for every entry of ``thetas`` (rep -> theta, or (rep, candidate) -> theta).
    ``drawn``: the replicates that a condensed design has masses of."""
    keys = sorted(thetas)
    reps = np.array([k[0] if isinstance(k, tuple) else k for k in keys], dtype=np.int64)
    th = np.array([thetas[k] for k in keys], dtype=float)
    p = th.shape[1]
    columns = np.searchsorted(np.array(sorted(drawn)), reps) if drawn is not None else reps

    def part(it):
        acc = np.zeros((len(reps), 1 + p + p * p))
        seen = False
        for batch in it:
            tile = ROW_TILE if drawn is not None else max(1, len(batch))
            for r0 in range(0, len(batch), tile):
                pdf = batch.iloc[r0:r0 + tile]
                masses = pdf["_mass"].dropna() if "_mass" in pdf else ()
                masses = np.stack(masses.to_list()) if len(masses) else None
                for c0 in range(0, len(reps), REP_CHUNK):
                    sl = slice(c0, c0 + REP_CHUNK)
                    W = drawn_weights(pdf, masses, reps[sl], columns[sl], seed, key_col)
                    ll, g, H = batch_stats_reps(model, equations, th[sl], pdf, W)
                    acc[sl, 0] += ll
                    acc[sl, 1:1 + p] += g
                    acc[sl, 1 + p:] += H.reshape(H.shape[0], -1)
                seen = True
        if seen:
            rr = np.repeat(np.arange(len(reps)), acc.shape[1])
            kk = np.tile(np.arange(acc.shape[1]), len(reps))
            yield pd.DataFrame({"rep": rr.astype(np.int64), "k": kk.astype(np.int32), "v": acc.ravel()})

    from ..session import ship_code
    ship_code(design.sparkSession)
    rows = design.mapInPandas(part, schema="rep long, k int, v double") \
        .groupBy("rep", "k").agg(F.sum("v").alias("v")).collect()
    out = {k: [0.0, np.zeros(p), np.zeros((p, p))] for k in keys}
    for r in rows:
        rep, k = keys[r["rep"]], int(r["k"])
        v = np.nan if r["v"] is None else float(r["v"])  # Arrow turns NaN into null
        if k == 0:
            out[rep][0] = v
        elif k <= p:
            out[rep][1][k - 1] = v
        else:
            out[rep][2].flat[k - 1 - p] = v
    return out


def _damped_step(g: np.ndarray, H: np.ndarray):
    """Newton direction; when -H is not positive definite, add lambda * I (Levenberg)."""
    A = -H
    lam = 0.0
    scale = max(1.0, float(np.abs(np.diag(A)).max())) if A.size else 1.0
    for _ in range(30):
        try:
            L = np.linalg.cholesky(A + lam * np.eye(len(g)))
            return np.linalg.solve(L.T, np.linalg.solve(L, g)), lam
        except np.linalg.LinAlgError:
            lam = 1e-6 * scale if lam == 0.0 else lam * 10
    return None, lam


def newton_reps(design: DataFrame, model: RowModel, equations, theta0: np.ndarray, reps: list, seed: int,
                max_iter: int = 50, tol: float = 1e-10, key_col: str = "_rk", prepared: bool = False):
    """All replicates' Newton iterations in lockstep: one Spark pass per round over the condensed design (AFT rows). A
    small design is read as it is: there draws are few enough for rounding to decide whether a replicate converges.
    ``prepared``: the design is read from a checkpoint already, and condensing it writes no other."""
    from .condense import condense
    rows, drawn = design if prepared else materialize(design, spread=True), None
    large = rows.count() > SMALL_DESIGN
    if prepared and not large:
        rows = materialize(rows, spread=True)
    if large:
        rows, drawn = condense(rows, [t for _e, ts in equations for t in ts if t != CONS], reps, seed, key_col), reps
    return newton_lockstep(lambda active: evaluate_reps(rows, model, equations, active, seed, key_col, drawn), theta0, reps,
                           max_iter, tol, ahead=drawn is not None)


def start_state(theta0: np.ndarray) -> dict:
    return {"theta": np.array(theta0, float), "cand": np.array(theta0, float), "ll": None, "g": None, "H": None,
            "step": None, "t": 1.0, "it": 0, "flat": 0, "done": False, "conv": False}


def advance(s: dict, ll: float, g: np.ndarray, H: np.ndarray, max_iter: int, tol: float) -> None:
    """One round of Newton's method for one replicate or stratum: takes or halves the step to its candidate,
    given the log-likelihood, gradient and Hessian there, and sets the next candidate or the final flags."""
    if s["ll"] is not None and not (np.isfinite(ll) and ll >= s["ll"] - 1e-12):
        s["t"] /= 2
        if s["t"] < 2 ** -10:
            s["done"] = True
        else:
            s["cand"] = s["theta"] + s["t"] * s["step"]
        return
    change = np.inf if s["ll"] is None else ll - s["ll"]
    s["theta"], s["ll"], s["g"], s["H"] = s["cand"], ll, g, H
    s["flat"] = s["flat"] + 1 if abs(change) <= 1e-7 * (1.0 + abs(ll)) else 0
    if s["flat"] >= 2:  # relative log-likelihood tolerance
        s["done"], s["conv"] = True, _decrement(g, H) < 1e-5 and _settled(_full_step(g, H), s["theta"])
        return
    if not np.isfinite(ll):
        s["done"] = True
        return
    s["it"] += 1
    step, lam = _damped_step(g, H)
    if step is None:
        s["done"] = True  # no usable direction: recorded as failed
    elif float(g @ step) < tol and lam == 0.0:
        s["done"], s["conv"] = True, _settled(step, s["theta"])
    elif s["it"] >= max_iter:
        s["done"] = True
    else:
        s["step"], s["t"], s["cand"] = step, 1.0, s["theta"] + step


def _halvings(s: dict) -> list:
    """The candidates that a replicate whose step is being halved would try one after the other, the present one first."""
    out, t = [s["cand"]], s["t"]
    while t < 1 and t / 2 >= 2 ** -10:
        t /= 2
        out.append(s["theta"] + t * s["step"])
    return out


def newton_lockstep(evalr: Callable, theta0: np.ndarray, reps: list, max_iter: int = 50, tol: float = 1e-10, ahead: bool = False):
    """Newton's method for many replicates of one model; evalr({rep: theta}) -> {rep: (loglik, gradient, Hessian)}
    is called once a round with the replicates still active. ``ahead``: a replicate whose step is being halved has all further
    halvings evaluated in one round, evalr({(rep, candidate): theta}); they are judged in their order, as in rounds of their own."""
    st = {r: start_state(theta0) for r in reps}
    tried = dict.fromkeys(reps, 0)
    while True:
        active = {r: _halvings(s) if ahead else [s["cand"]] for r, s in st.items() if not s["done"] and tried[r] < 2 * max_iter}
        if not active:
            break
        res = evalr({(r, i) if ahead else r: th for r, ths in active.items() for i, th in enumerate(ths)})
        for r, ths in active.items():
            s = st[r]
            for i in range(len(ths)):
                before = s["t"]
                advance(s, *res[(r, i) if ahead else r], max_iter, tol)
                tried[r] += 1
                if s["done"] or s["t"] >= before or tried[r] >= 2 * max_iter:  # taken, ended, or no candidate left
                    break
    out = {}
    for r, s in st.items():
        try:
            vcov = np.linalg.inv(-s["H"]) if s["H"] is not None else None
        except np.linalg.LinAlgError:
            vcov = None
        out[r] = (s["theta"], s["ll"], vcov, s["conv"], s["it"])
    return out
