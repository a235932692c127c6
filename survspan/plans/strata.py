"""One maximum-likelihood fit per stratum, all strata in the same passes (M7).

The state of every stratum's Newton iteration (coefficients, candidate, gradient, Hessian, step and flags) is
a row of a DataFrame. A round joins the design with the candidates of the strata still active, adds up each
stratum's log-likelihood, gradient and Hessian inside the tasks (per batch, then per task, then by a grouped sum, so
that a large stratum is never one task), and moves every stratum one step on. Nothing grows with the number
of strata on the driver; a stratum that fails does not touch the others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_code
from .likelihood import RowModel, _design_arrays, _eta_derivs, advance
from .scan import materialize

BROADCAST_NUMBERS = 1 << 20  # candidates of all strata: 8 MB, the checked bound of what is broadcast
_VECTORS = ("theta", "cand", "g", "step")
STATE = ("theta array<double>, cand array<double>, ll double, g array<double>, h array<double>, step array<double>, "
         "t double, it int, flat int, done boolean, conv boolean")


def _stratum_sums(batches: Iterator[pd.DataFrame], model: RowModel, equations, by: str) -> Iterator[pd.DataFrame]:
    """Per batch and stratum: log-likelihood, gradient and Hessian (row-major), each with the stratum's own coefficients."""
    for pdf in batches:
        if not len(pdf):
            continue
        theta = np.stack(pdf["_cand"].to_list()).astype(float)
        xs = _design_arrays(pdf, equations)
        ends = np.cumsum([0] + [x.shape[1] for x in xs])
        eta = np.column_stack([(x * theta[:, a:b]).sum(1) for x, a, b in zip(xs, ends, ends[1:])])
        ll, g, h = _eta_derivs(model, eta, {c: pdf[c].to_numpy(float) for c in model.data_cols})
        grad = np.concatenate([x * g[:, [j]] for j, x in enumerate(xs)], 1)
        hess = np.concatenate([np.concatenate([x[:, :, None] * y[:, None, :] * h[:, j, k][:, None, None]
                                               for k, y in enumerate(xs)], 2) for j, x in enumerate(xs)], 1)
        rows = np.concatenate([ll[:, None], grad, hess.reshape(len(pdf), -1)], 1)
        code, names = pd.factorize(pdf[by])
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) > 0]))
        out = pd.DataFrame(np.add.reduceat(rows[order], first, axis=0), columns=[f"v{i}" for i in range(rows.shape[1])])
        out.insert(0, by, names[code[order][first]])
        yield out


def _moved(batches: Iterator[pd.DataFrame], p: int, max_iter: int, tol: float, by: str) -> Iterator[pd.DataFrame]:
    names = [by, "theta", "cand", "ll", "g", "h", "step", "t", "it", "flat", "done", "conv"]
    for pdf in batches:
        out = []
        for row in pdf.to_dict("records"):
            if not row["done"]:
                s = {k: None if row[k] is None else np.asarray(row[k], float) for k in _VECTORS}
                s |= {"H": None if row["h"] is None else np.asarray(row["h"], float).reshape(p, p),
                      "ll": None if pd.isna(row["ll"]) else row["ll"], "t": row["t"], "it": row["it"], "flat": row["flat"],
                      "done": False, "conv": False}
                v = np.array([row[f"v{i}"] for i in range(1 + p + p * p)], float)
                advance(s, v[0], v[1:1 + p], v[1 + p:].reshape(p, p), max_iter, tol)
                row = row | {k: None if s[k] is None else s[k].tolist() for k in _VECTORS}
                row |= {"h": None if s["H"] is None else s["H"].ravel().tolist(), **{k: s[k] for k in ("ll", "t", "it", "flat")},
                        "done": bool(s["done"]), "conv": bool(s["conv"])}
            out.append([row[c] for c in names])
        yield pd.DataFrame(out, columns=names)


def newton_by(design: DataFrame, by: str, model: RowModel, equations: Sequence, start: DataFrame, strata: int,
              max_iter: int = 50, tol: float = 1e-10) -> DataFrame:
    """State of every stratum when its iteration has ended. by: a column name that is none of the state's; start: (by, cand); a null cand is a stratum without a
    fit. strata: how many rows start has. design is read once a round."""
    ship_code(design.sparkSession)
    p = sum(len(terms) for _eq, terms in equations)
    kind = design.schema[by].dataType.simpleString()
    state = start.select(by, F.lit(None).cast("array<double>").alias("theta"), "cand", F.lit(None).cast("double").alias("ll"),
                         F.lit(None).cast("array<double>").alias("g"), F.lit(None).cast("array<double>").alias("h"),
                         F.lit(None).cast("array<double>").alias("step"), F.lit(1.0).alias("t"), F.lit(0).alias("it"),
                         F.lit(0).alias("flat"), F.col("cand").isNull().alias("done"), F.lit(False).alias("conv"))
    state = materialize(state)
    sums = ", ".join(f"v{i} double" for i in range(1 + p + p * p))
    # Every round moves or halves a step, so that it ends by itself; the bound is only a guard.
    for _ in range(12 * max_iter):
        active = state.where("not done")
        if active.isEmpty():
            break
        asked = active.select(by, F.col("cand").alias("_cand"))
        if strata * p <= BROADCAST_NUMBERS:
            asked = F.broadcast(asked)
        parts = design.join(asked, by).mapInPandas(lambda it: _stratum_sums(it, model, equations, by), f"`{by}` {kind}, {sums}")
        total = parts.groupBy(by).agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(1 + p + p * p)])
        state = materialize(state.join(total, by, "left").mapInPandas(
            lambda it: _moved(it, p, max_iter, tol, by), f"`{by}` {kind}, {STATE}"))
    return state


def inverse(state: DataFrame, by: str, p: int) -> DataFrame:
    """state with vcov, the inverse of the information; null where that is singular."""
    kind = state.schema[by].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h in pdf["h"]:
                try:
                    out.append(None if h is None else np.linalg.inv(-np.asarray(h, float).reshape(p, p)).ravel().tolist())
                except np.linalg.LinAlgError:
                    out.append(None)
            yield pdf.assign(vcov=out)

    return state.mapInPandas(work, f"`{by}` {kind}, {STATE}, vcov array<double>")
