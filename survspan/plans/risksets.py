"""Risk-set sums over time-sorted records, without a shuffle per pass.

Every interval (start, stop] gives two records, one at each end. The records are
range-partitioned once by (stratum, time descending), sorted inside the partitions and
checkpointed; all passes of a fit read them as they lie. Going down in time, the risk set of an
event time t is what has been seen so far: ends at t or later less starts at t or later.

A pass at given coefficients has two scans, neither of which moves a record. The first sums
each partition's last stratum; the driver turns these sums, one vector per partition, into what every
partition inherits. The second runs the sums through each partition and adds up log-likelihood, score
and information at its event times. Ties may be cut by a partition's end, so that a hot event time is spread too: the
parts of such a group, at most two per partition, are put together on the driver.

Covariates are centred, so that the sums of e^{xb} neither overflow nor cancel more than they must.

Coefficients that vary with time, e^{xb + g(t) z c}, need no splitting of intervals: sums are kept per distinct
z (a pattern), and e^{g(t) z c} multiplies them at each event time, when the sums are already formed.

Bootstrap replicates share the scans: a row's Poisson(1) weights come from a hash of (row key, replicate,
seed), and the sums carry one more axis, for the replicates of a chunk. Where there are few distinct covariate vectors
(FEW_PATTERNS), all effects are taken as those of patterns, with g = 1: the sums over records are then sums of weights by
pattern, without covariates or exponentials, and the first scan, the same at any coefficients, is made once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from .likelihood import poisson_weights

ROWS_PER_PART = 1 << 17
LEAST_ROWS = 1 << 12   # below that, one more task costs more than it saves
MAX_PATTERNS = 256     # distinct covariate vectors with time-varying effects
CHUNK_NUMBERS = 1 << 21  # numbers per chunk of records inside a task
DRIVER_NUMBERS = 1 << 22  # numbers that all partitions together send to the driver in one scan
EFRON_ROWS = 1 << 15
MAX_REPLICATES = 256   # in one scan
FEW_PATTERNS = 16      # distinct covariate vectors up to which replicates keep sums by pattern


@dataclass
class RiskSets:
    records: DataFrame
    terms: list
    tvc: list
    patterns: np.ndarray   # (patterns, tvc)
    centre: np.ndarray
    parts: int
    n: int
    events: float

    @property
    def names(self) -> list[str]:
        return self.terms + [f"{z}_t" for z in self.tvc]

    def replicates_at_once(self) -> int:
        """So many that the partitions' vectors stay below DRIVER_NUMBERS."""
        return int(max(1, min(MAX_REPLICATES, DRIVER_NUMBERS // (self.parts * len(self.patterns) * _widths(len(self.terms), False)[0]))))


class TooManyPatterns(ValueError):
    pass


def risk_sets(design: DataFrame, terms: Sequence[str], tvc: Sequence[str] = (), texp: Callable[[Column], Column] | None = None,
              key: str | None = None, rows_per_part: int = ROWS_PER_PART, most_patterns: int | None = None) -> RiskSets:
    """design: t0, t, d, w, _stratum, the terms and tvc columns (see cox_design), and a row key for replicates."""
    from .scan import materialize

    terms, tvc = list(terms), list(tvc)
    most_patterns = MAX_PATTERNS if most_patterns is None else most_patterns
    spark = design.sparkSession
    design = materialize(design)  # counted, sampled for the ranges and shuffled from here
    stats = design.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("w") * F.col("d")).alias("D"),
                       *[F.avg(t).alias(f"m{i}") for i, t in enumerate(terms)]).first()
    patterns = np.zeros((1, 0))
    pattern = F.lit(0)
    if tvc:
        found = design.select(*[F.col(z).cast("double").alias(f"z{i}") for i, z in enumerate(tvc)]).distinct().limit(most_patterns + 1).collect()
        if len(found) > most_patterns:
            raise TooManyPatterns(f"more than {most_patterns} distinct vectors of {tvc}")
        patterns = np.array(sorted(tuple(r) for r in found), float).reshape(len(found), len(tvc))
        if len(found):
            known = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in patterns])
            pattern = (F.array_position(known, F.array(*[F.col(z).cast("double") for z in tvc])) - 1).cast("int")
        else:
            patterns = np.zeros((1, len(tvc)))
    ends = F.array(F.struct(F.col("t").alias("_time"), F.lit(1.0).alias("_sign"), (F.col("d") * F.col("w")).alias("_d")),
                   F.struct(F.col("t0").alias("_time"), F.lit(-1.0).alias("_sign"), F.lit(0.0).alias("_d")))
    rows = design.select("_stratum", F.explode(ends).alias("_end"), F.col("w").alias("_w"), *terms, pattern.alias("_pattern"),
                         (F.col(key) if key else F.lit(0)).cast("long").alias("_key"))
    rows = rows.select("_stratum", "_end.*", "_w", *terms, "_pattern", "_key")
    rows = rows.withColumn("_g", (texp(F.col("_time")) if tvc else F.lit(0.0)).cast("double"))
    n = 2 * int(stats["n"])
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, -(-n // rows_per_part), min(cores, n // LEAST_ROWS))
    order = [F.col("_stratum").asc_nulls_first(), F.col("_time").desc()]
    tie = F.xxhash64(*rows.columns)  # a hot time is cut too
    rows = (rows.withColumn("_tie", tie).repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order).drop("_tie"))
    records = materialize(rows.withColumn("_part", F.spark_partition_id()))
    centre = np.array([float(stats[f"m{i}"] or 0.0) for i in range(len(terms))])
    return RiskSets(records, terms, tvc, patterns, centre, parts, int(stats["n"]), float(stats["D"] or 0.0))


def replicate_sets(design: DataFrame, terms: Sequence[str], key: str) -> RiskSets:
    """Risk sets for replicates: by pattern where covariate vectors are few."""
    from .scan import materialize

    design = materialize(design)  # read twice where patterns are many
    try:
        sets = risk_sets(design, [], terms, lambda _: F.lit(1.0), key=key, most_patterns=FEW_PATTERNS)
    except TooManyPatterns:
        return risk_sets(design, terms, key=key)
    return replace(sets, patterns=sets.patterns - sets.patterns.mean(axis=0))  # centred: the same likelihood, no overflow


# ------------------------------------------------------------------ inside a task
def _widths(p: int, efron: bool) -> tuple[int, int]:
    """(numbers of a risk sum, numbers summed per group): the sum, events and their covariates, with Efron the tied events' own sum."""
    q = 1 + p + p * (p + 1) // 2
    return q, q + 1 + p + (q if efron else 0)


def same(a, b) -> bool:
    return (a is None and b is None) or a == b or (a != a and b != b)


@dataclass
class Group:
    """All records of one (stratum, time), or a part of them."""
    stratum: object
    time: float
    g: float
    sums: np.ndarray  # (patterns, replicates, numbers)


class Kernel:
    """Sums over the records of one partition, in their order."""

    def __init__(self, p: int, patterns: np.ndarray, centre: np.ndarray, theta: np.ndarray, terms: list,
                 efron: bool = False, reps: np.ndarray | None = None, seed: int = 0):
        self.p, self.patterns, self.centre, self.theta, self.terms = p, patterns, centre, theta, terms
        self.efron, self.reps, self.seed = efron, reps, seed
        self.q, self.width = _widths(p, efron)
        self.upper = np.triu_indices(p)
        self.shape = (len(patterns), len(theta))

    def rows(self, pdf: pd.DataFrame) -> np.ndarray:
        """(records, replicates, numbers)."""
        x = np.column_stack([pdf[t].to_numpy(float) for t in self.terms] or [np.zeros((len(pdf), 0))]) - self.centre
        w, sign, d = (pdf[c].to_numpy(float)[:, None] for c in ("_w", "_sign", "_d"))
        if self.reps is not None:
            drawn = poisson_weights(pdf["_key"].to_numpy(), self.reps, self.seed)
            w, d = w * drawn, d * drawn
        r = w * (np.exp(x @ self.theta[:, :self.p].T) if self.p else np.ones((1, len(self.theta))))
        covariates = np.column_stack([np.ones(len(x)), x, x[:, self.upper[0]] * x[:, self.upper[1]]])
        out = np.empty((len(x), len(self.theta), self.width))
        out[:, :, :self.q] = (sign * r)[:, :, None] * covariates[:, None, :]
        out[:, :, self.q:self.q + 1 + self.p] = np.broadcast_to(d, r.shape)[:, :, None] * covariates[:, None, :1 + self.p]
        if self.efron:
            out[:, :, self.q + 1 + self.p:] = np.where(d > 0, r, 0.0)[:, :, None] * covariates[:, None, :]
        return out

    def chunks(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(256, CHUNK_NUMBERS // (len(self.theta) * self.width * len(self.patterns)))
        for pdf in batches:
            for a in range(0, len(pdf), step):
                yield pdf.iloc[a:a + step]

    def summed(self, pdf: pd.DataFrame, of: np.ndarray, n: int) -> np.ndarray:
        """(n, patterns, replicates, numbers): sums over the records by ``of``, which never falls."""
        k = len(self.patterns)
        cell = of * k + (pdf["_pattern"].to_numpy(int) if k > 1 else 0)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] > cell[:-1]]))
        pdf = pdf.iloc[order] if k > 1 else pdf
        if self.reps is not None and not self.p and not self.efron:  # weights alone; few records have events
            drawn = poisson_weights(pdf["_key"].to_numpy(), self.reps, self.seed)
            sums = np.zeros((self.width, n * k, len(self.reps)))
            d = pdf["_d"].to_numpy(float)
            at = np.flatnonzero(d)
            if len(at):
                begin = np.flatnonzero(np.concatenate([[True], cell[at][1:] > cell[at][:-1]]))
                sums[1, cell[at][begin]] = np.add.reduceat(d[at, None] * drawn[at], begin, axis=0)
            drawn *= (pdf["_sign"].to_numpy(float) * pdf["_w"].to_numpy(float))[:, None]
            sums[0, cell[first]] = np.add.reduceat(drawn, first, axis=0)
            return np.moveaxis(sums, 0, -1).reshape(n, k, len(self.reps), self.width)
        values = self.rows(pdf)
        sums = np.zeros((n * k, *values.shape[1:]))
        sums[cell[first]] = np.add.reduceat(values, first, axis=0)
        return sums.reshape(n, k, *values.shape[1:])

    def segments(self, pdf: pd.DataFrame) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """(strata, times, g, sums) of the chunk's first and last group, and between them of its groups with events, each
        together with the groups without events that precede it in its stratum (the last of a stratum may have none)."""
        s, t = pdf["_stratum"], pdf["_time"].to_numpy(float)
        changed = self.changes(s)
        new = changed.copy()
        new[0] = True
        new[1:] |= t[1:] != t[:-1]
        begin = np.flatnonzero(new)
        ends = np.logical_or.reduceat(pdf["_d"].to_numpy(float) != 0, begin)
        ends[0] = ends[-1] = ends[-2:][0] = True
        ends[:-1] |= changed[begin[1:]]
        last = np.flatnonzero(ends)
        of = np.searchsorted(last, np.cumsum(new) - 1)
        at = begin[last]
        return s.iloc[at].tolist(), t[at], pdf["_g"].to_numpy(float)[at], self.summed(pdf, of, len(last))

    @staticmethod
    def changes(s: pd.Series) -> np.ndarray:
        before = s.shift()
        return (s.ne(before) & ~(s.isna() & before.isna())).to_numpy(bool)

    def totals(self, batches) -> dict | None:
        """First and last group, and the sum over the last stratum."""
        out, total = None, None
        for pdf in self.chunks(batches):
            s, t = pdf["_stratum"], pdf["_time"]
            first, last = ((s.iloc[i:][:1].tolist()[0], float(t.iloc[i])) for i in (0, len(pdf) - 1))
            if out is None:
                out = {"part": int(pdf["_part"].iloc[0]), "first": first, "last": first, "one_stratum": True}
            inside = np.flatnonzero(self.changes(s)[1:]) + 1
            if len(inside) or not same(first[0], out["last"][0]):
                out["one_stratum"], total = False, None
            out["last"] = last
            rest = pdf.iloc[inside[-1]:] if len(inside) else pdf
            total = self.summed(rest, np.zeros(len(rest), np.int64), 1)[0][..., :self.q] + (0.0 if total is None else total)
        return out and out | {"total": total}

    def scan(self, batches, inherited: np.ndarray, first_shared: bool, last_shared: bool):
        """(log-likelihood, score, information) per replicate, and the groups that other partitions share."""
        acc, shared = None, []
        open_, base = None, inherited  # the last group, and what is at risk above it
        leading = True

        def close(g: np.ndarray, sums: np.ndarray, bases: np.ndarray):
            nonlocal acc
            kept = sums[..., self.q].any(axis=(1, 2))
            if kept.any():
                got = self.contributions(g[kept], sums[kept], bases[kept])
                acc = got if acc is None else [a + b for a, b in zip(acc, got)]

        for pdf in self.chunks(batches):
            strata, times, g, sums = self.segments(pdf)
            if open_ is not None:
                if same(open_.stratum, strata[0]) and open_.time == times[0]:
                    sums[0] += open_.sums
                else:
                    strata, times, g = [open_.stratum, *strata], np.append(open_.time, times), np.append(open_.g, g)
                    sums = np.concatenate([open_.sums[None], sums])
            begin = [0, *(i for i in range(1, len(strata)) if not same(strata[i], strata[i - 1])), len(strata)]
            bases = np.zeros_like(sums[..., :self.q])
            bases[0] = base
            for a, b in zip(begin, begin[1:]):
                bases[a + 1:b] = bases[a] + np.cumsum(sums[a:b - 1, ..., :self.q], axis=0)
            open_, base = Group(strata[-1], float(times[-1]), float(g[-1]), sums[-1].copy()), bases[-1].copy()
            lo, hi = 0, len(strata) - 1
            if leading and hi:
                leading = False
                if first_shared:
                    shared.append((Group(strata[0], float(times[0]), float(g[0]), sums[0].copy()), bases[0].copy()))
                    lo = 1
            close(g[lo:hi], sums[lo:hi], bases[lo:hi])
        if open_ is not None:
            if last_shared or (leading and first_shared):
                shared.append((open_, base))
            else:
                close(np.array([open_.g]), open_.sums[None], base[None])
        return acc, shared

    def contributions(self, g: np.ndarray, sums: np.ndarray, bases: np.ndarray):
        """Sums over groups; sums: theirs, bases: what is at risk above them in time, (groups, patterns, replicates, numbers)."""
        p, q, z, theta = self.p, self.q, self.patterns, self.theta
        at_risk = bases + sums[..., :q]
        effect = theta[:, p:]
        factor = np.exp(g[:, None, None] * (z @ effect.T)[None]) if z.shape[1] else np.ones((len(g), 1, 1))

        def moments(m):
            """(groups, replicates): sum, first and second moments over x and z g."""
            m = m * factor[..., None]
            s0, s1 = m[..., 0].sum(1), m[..., 1:1 + p].sum(1)
            s2 = np.zeros((*s0.shape, p, p))
            s2[..., self.upper[0], self.upper[1]] = m[..., 1 + p:].sum(1)
            s2[..., self.upper[1], self.upper[0]] = s2[..., self.upper[0], self.upper[1]]
            if not z.shape[1]:
                return s0, s1, s2
            gz = g[:, None, None] * z[None]
            z1 = np.einsum("gkr,gkz->grz", m[..., 0], gz)
            xz = np.einsum("gkrx,gkz->grxz", m[..., 1:1 + p], gz)
            zz = np.einsum("gkr,gky,gkz->gryz", m[..., 0], gz, gz)
            top = np.concatenate([s2, xz], -1)
            low = np.concatenate([np.swapaxes(xz, -1, -2), zz], -1)
            return s0, np.concatenate([s1, z1], -1), np.concatenate([top, low], -2)

        events = sums[..., q:q + 1 + p]
        d, dx = events[..., 0].sum(1), events[..., 1:].sum(1)
        if z.shape[1]:
            dx = np.concatenate([dx, np.einsum("gkr,gkz->grz", events[..., 0], g[:, None, None] * z[None])], -1)
        s0, s1, s2 = moments(at_risk)
        ll = np.einsum("grx,rx->r", dx, theta)
        if self.efron:
            less, u, info = self._efron(d[:, 0], s0[:, 0], s1[:, 0], s2[:, 0], *(a[:, 0] for a in moments(sums[..., q + 1 + p:])))
            return [ll - less, dx.sum(0) - u, info]
        some = d > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            ll = ll - np.where(some, d * np.log(s0), 0.0).sum(0)
            mean = np.where(some[..., None], s1 / s0[..., None], 0.0)
            second = np.where(some[..., None, None], s2 / s0[..., None, None], 0.0)
        u = (dx - d[..., None] * mean).sum(0)
        info = (d[..., None, None] * (second - mean[..., :, None] * mean[..., None, :])).sum(0)
        return [ll, u, info]

    @staticmethod
    def _efron(d, s0, s1, s2, a0, a1, a2):
        """Each of d tied events meets the risk set less a growing share of the tied ones."""
        less, u, info = np.zeros(1), np.zeros((1, s1.shape[1])), np.zeros((1, *s2.shape[1:]))
        ends = np.cumsum(d.astype(np.int64))
        for a in range(0, int(ends[-1]), EFRON_ROWS):
            event = np.arange(a, min(a + EFRON_ROWS, int(ends[-1])))
            at = np.searchsorted(ends, event, side="right")
            share = ((event - (ends[at] - d[at])) / d[at])[:, None]
            den = s0[at] - share[:, 0] * a0[at]
            mean = (s1[at] - share * a1[at]) / den[:, None]
            second = (s2[at] - share[:, :, None] * a2[at]) / den[:, None, None]
            less += np.log(den).sum()
            u += mean.sum(0)
            info += (second - mean[:, :, None] * mean[:, None, :]).sum(0)
        return less, u, info


# ------------------------------------------------------------------ a pass
def _kernel(sets: RiskSets, theta: np.ndarray, efron: bool, reps, seed) -> Kernel:
    return Kernel(len(sets.terms), sets.patterns, sets.centre, theta, sets.terms, efron, reps, seed)


def _inherited(totals: list[dict], shape: tuple) -> dict[int, tuple]:
    """part -> (sums at risk above it in its first stratum, first group shared, last group shared)."""
    out, carry, last = {}, np.zeros(shape), None
    totals = sorted(totals, key=lambda x: x["part"])
    for i, x in enumerate(totals):
        goes_on = last is not None and same(last[0], x["first"][0])
        base = carry if goes_on else np.zeros(shape)
        nxt = totals[i + 1]["first"] if i + 1 < len(totals) else None
        first_shared = goes_on and last[1] == x["first"][1]
        last_shared = nxt is not None and same(nxt[0], x["last"][0]) and nxt[1] == x["last"][1]
        out[x["part"]] = (base, first_shared, last_shared)
        carry = (base if x["one_stratum"] else 0.0) + x["total"]
        last = x["last"]
    return out


def pass_frames(sets: RiskSets, theta: np.ndarray, efron: bool = False, reps: np.ndarray | None = None, seed: int = 0):
    """(first scan, second scan as a function of what partitions inherit): both read the records as they lie."""
    from ..session import ship_code

    ship_code(sets.records.sparkSession)
    theta = np.atleast_2d(np.asarray(theta, float))
    kernel = _kernel(sets, theta, efron, reps, seed)
    key = sets.records.schema["_stratum"].dataType
    ends = [StructField(f"{side}_{what}", kind) for side in ("first", "last") for what, kind in (("stratum", key), ("time", DoubleType()))]

    def first(batches):
        got = kernel.totals(x for x in batches if len(x))
        if got:
            yield pd.DataFrame([{"part": got["part"], "first_stratum": got["first"][0], "first_time": got["first"][1],
                                 "last_stratum": got["last"][0], "last_time": got["last"][1],
                                 "one_stratum": got["one_stratum"], "total": got["total"].ravel().tolist()}])

    totals = sets.records.mapInPandas(first, StructType(
        [StructField("part", IntegerType()), *ends, StructField("one_stratum", BooleanType()),
         StructField("total", ArrayType(DoubleType()))]))

    def second_scan(inherited: dict) -> DataFrame:
        sent = sets.records.sparkSession.sparkContext.broadcast(inherited)

        def second(batches):
            batches = (x for x in batches if len(x))
            head = next(batches, None)
            if head is None:
                return
            part = int(head["_part"].iloc[0])

            def all_():
                yield head
                yield from batches

            acc, shared = kernel.scan(all_(), *sent.value[part])
            out = []
            if acc is not None:
                flat = np.concatenate([x.ravel() for x in acc])
                out.append(pd.DataFrame({"part": -1, "k": np.arange(len(flat)), "v": flat, "stratum": None, "time": None, "raw": None}))
            for i, (x, base) in enumerate(shared):
                raw = np.concatenate([[x.g], base.ravel(), x.sums.ravel()])
                out.append(pd.DataFrame([{"part": part, "k": i, "v": 0.0, "stratum": x.stratum, "time": x.time, "raw": raw.tolist()}]))
            for x in out:
                yield x

        parts = sets.records.mapInPandas(second, StructType(
            [StructField("part", IntegerType()), StructField("k", IntegerType()), StructField("v", DoubleType()),
             StructField("stratum", key), StructField("time", DoubleType()), StructField("raw", ArrayType(DoubleType()))]))
        return parts.groupBy("part", "k").agg(F.sum("v").alias("v"), F.first("stratum").alias("stratum"),
                                              F.first("time").alias("time"), F.first("raw").alias("raw"))

    return kernel, totals, second_scan


def risk_stats(sets: RiskSets, theta: np.ndarray, efron: bool = False, reps: np.ndarray | None = None, seed: int = 0,
               kept: dict | None = None):
    """(log-likelihood (r,), score (r, P), information (r, P, P)) at each replicate's coefficients.

    ``kept`` holds the partitions' totals of replicates by pattern between passes: they are the same at any coefficients."""
    kernel, totals, second_scan = pass_frames(sets, theta, efron, reps, seed)
    r, k, size = len(kernel.theta), len(sets.patterns), kernel.theta.shape[1]
    shape = (k, r, kernel.q)
    by_pattern = kept is not None and kernel.p == 0 and reps is not None
    if by_pattern and all(int(x) in kept for x in reps):
        found = [x | {"total": np.stack([kept[int(i)][x["part"]] for i in reps], axis=1)} for x in kept["parts"]]
    else:
        found = [{"part": x["part"], "first": (x["first_stratum"], x["first_time"]), "last": (x["last_stratum"], x["last_time"]),
                  "one_stratum": x["one_stratum"], "total": np.array(x["total"]).reshape(shape)} for x in totals.collect()]
        if by_pattern:
            kept["parts"] = found
            kept |= {int(i): {x["part"]: x["total"][:, j].copy() for x in found} for j, i in enumerate(reps)}
    acc = np.zeros(r * (1 + size + size * size))
    shared = []
    for x in second_scan(_inherited(found, shape)).collect():
        if x["part"] < 0:
            acc[x["k"]] = np.nan if x["v"] is None else x["v"]  # Arrow turns NaN into null
        else:
            shared.append(x)
    ll, u, info = acc[:r].copy(), acc[r:r + r * size].reshape(r, size).copy(), acc[r + r * size:].reshape(r, size, size).copy()
    groups, bases = [], []
    cut = 1 + int(np.prod(shape))
    for x in sorted(shared, key=lambda x: (x["part"], x["k"])):
        raw = np.array(x["raw"])
        sums = raw[cut:].reshape(k, r, kernel.width)
        if groups and same(groups[-1].stratum, x["stratum"]) and groups[-1].time == x["time"]:
            groups[-1].sums = groups[-1].sums + sums
        else:
            groups.append(Group(x["stratum"], x["time"], float(raw[0]), sums))
            bases.append(raw[1:cut].reshape(shape))
    for x, base in zip(groups, bases):
        if x.sums[..., kernel.q].any():
            a, b, c = kernel.contributions(np.array([x.g]), x.sums[None], base[None])
            ll, u, info = ll + a, u + b, info + c
    return ll, u, info
