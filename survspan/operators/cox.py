"""Cox proportional hazards with delayed entry (X1-X9), Breslow or Efron ties.

A Newton iteration reads a design that is range-partitioned by (stratum, time), sorted and
checkpointed once (plans/risksets.py): two scans in place, no shuffle of rows. Coefficients
that vary with time use the same scans, with sums kept per covariate pattern.

Curves (baseline hazard, residuals) at given coefficients build a time table instead:

1. every row gives an entry record at ``start`` and an exit record at
   ``stop`` carrying w e^{x b} (1, x, x x'), plus event sums at ``stop``;
2. ``groupBy(stratum, time)`` sums them (map-side partial aggregation);
3. risk-set moments S0, S1 at t are exclusive prefix sums of
   (entries - exits) over time (blocked scan, start < t <= stop);
4. event times give loglik and score; for Breslow the second-moment part of
   the information, sum_t D_t S2(t)/S0(t), equals sum_t H(t) (exit - entry
   second moments at t) with H the Breslow cumulative hazard, so only p + 2
   running sums are windowed (not p(p+1)/2 more); one aggregate row reaches
   the driver (p + p^2 + 1 numbers).

No range join and no per-time broadcast: cost is linear in rows.  The time
cut list for the blocked scan is computed once per fit.  Efron's correction
uses the tied events' own moments (extra columns of the same time table) and a
higher-order aggregate over l = 0..d-1 at each event time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.likelihood import FitResult, newton
from ..plans.risksets import RiskSets, TooManyPatterns, risk_sets, risk_stats
from ..plans.scan import blocks_from_quantiles, blocks_like, materialize, ordered_scan
from .survival import SurvSpec


def _xb(terms: Sequence[str], beta: np.ndarray) -> Column:
    e = F.lit(0.0)
    for t, b in zip(terms, beta):
        e = e + F.lit(float(b)) * F.col(t)
    return e


def cox_design(df: DataFrame, spec: SurvSpec, terms: Sequence[str], strata: str | None = None,
               weight: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    st = F.coalesce(F.col(spec.start).cast("double"), F.lit(0.0))
    ev = F.col(spec.event)
    cols = [st.alias("t0"), F.col(spec.stop).cast("double").alias("t"),
            F.when(ev.isNotNull() & (ev != 0), 1.0).otherwise(0.0).alias("d"),
            (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
            (F.col(strata) if strata else F.lit(0)).alias("_stratum")]
    cols += [F.col(t).cast("double").alias(t) for t in terms] + [F.col(c) for c in keep]
    d = df.select(*cols).filter(F.col("t").isNotNull() & (F.col("t") > F.col("t0")))
    for t in terms:
        d = d.filter(F.col(t).isNotNull())
    return d


def _pairs(p):
    return [(j, k) for j in range(p) for k in range(j, p)]


def risk_moments(design: DataFrame, terms: Sequence[str], beta: np.ndarray, cuts_ref: DataFrame | None = None,
                 efron: bool = False, second_moments: bool = False):
    """Per (stratum, time) table with risk-set moments S0, S1_j, S2_jk and event sums."""
    p = len(terms)
    r = F.col("w") * F.exp(_xb(terms, beta))
    vals = {"v0": r}
    for j, t in enumerate(terms):
        vals[f"v1_{j}"] = r * F.col(t)
    for j, k in _pairs(p):
        vals[f"v2_{j}_{k}"] = r * F.col(terms[j]) * F.col(terms[k])
    vnames = list(vals)
    ev = {"D": F.col("w") * F.col("d"), "Dxb": F.col("w") * F.col("d") * _xb(terms, beta)}
    for j, t in enumerate(terms):
        ev[f"Dx_{j}"] = F.col("w") * F.col("d") * F.col(t)
    if efron:  # moments of the tied events themselves
        for n, e in vals.items():
            ev[f"A_{n}"] = F.col("d") * e
    zero_ev = {k: F.lit(0.0) for k in ev}
    ent = design.select("_stratum", F.col("t0").alias("time"), *[e.alias(n) for n, e in vals.items()],
                        *[e.alias(n) for n, e in zero_ev.items()])
    ext = design.select("_stratum", F.col("t").alias("time"), *[(-e).alias(n) for n, e in vals.items()],
                        *[e.alias(n) for n, e in ev.items()])
    tt = ent.unionByName(ext).groupBy("_stratum", "time").agg(
        *[F.sum(n).alias(n) for n in vnames], *[F.sum(n).alias(n) for n in ev])
    if cuts_ref is None:
        tt = blocks_from_quantiles(materialize(tt), "time")
    else:
        tt = blocks_like(tt, "time", cuts_ref)
    run = vnames if (efron or second_moments) else [n for n in vnames if not n.startswith("v2_")]
    tt = ordered_scan(tt, ["_stratum"], ["time"], cumsum={f"c_{n}": n for n in run})
    # exclusive prefix: risk set at t = start < t <= stop
    risk = {f"S_{n}": F.col(f"c_{n}") - F.col(n) for n in run}
    return tt.withColumns(risk), vnames


EFRON_CHUNK = 4096  # tied events handled per row; a hot event time becomes several rows


def _efron_sum(fn):
    """Part of sum over l = 0..d-1 of fn(phi_l), phi_l = l / d, at one event time:
    the slice l in [_lo, _hi] of this row (rows come from exploding the tie group
    into chunks, so no array grows with the number of tied events)."""
    d = F.col("D")
    return F.aggregate(F.sequence(F.col("_lo"), F.col("_hi")), F.lit(0.0),
                       lambda acc, l: acc + fn(l.cast("double") / d))


def cox_stats(design: DataFrame, terms: Sequence[str], beta: np.ndarray, cuts_ref: DataFrame | None = None,
              ties: str = "breslow"):
    """(loglik, score, information) at beta: one distributed pass."""
    p = len(terms)
    efron = ties == "efron"
    tt, _ = risk_moments(design, terms, beta, cuts_ref, efron=efron)
    s0 = F.col("S_v0")
    if not efron:
        # Breslow: sum_t D_t S2(t)/S0(t) = sum_t H(t) (exit - entry second moments at t),
        # H the Breslow cumulative hazard, so S2 needs no running sums of its own
        tt = ordered_scan(tt.withColumn("_dh", F.when(F.col("D") > 0, F.col("D") / s0).otherwise(F.lit(0.0))),
                          ["_stratum"], ["time"], cumsum={"_H": "_dh"})
    e = tt.filter(F.col("D") > 0) if efron else tt
    if efron:
        nchunk = F.ceil(F.col("D") / F.lit(EFRON_CHUNK)).cast("long")
        e = e.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), nchunk - 1)))
        e = e.withColumns({"_lo": F.col("_chunk") * EFRON_CHUNK,
                           "_hi": F.least(F.col("D").cast("long"), (F.col("_chunk") + 1) * EFRON_CHUNK) - 1})
        first = F.col("_chunk") == 0  # per-time terms counted once

        def once(c):
            return F.when(first, c).otherwise(F.lit(0.0))

        def den(ph):
            return s0 - ph * F.col("A_v0")

        def s1(j, ph):
            return F.col(f"S_v1_{j}") - ph * F.col(f"A_v1_{j}")

        aggs = [F.sum(once(F.col("Dxb")) - _efron_sum(lambda ph: F.log(den(ph)))).alias("ll")]
        for j in range(p):
            aggs.append(F.sum(once(F.col(f"Dx_{j}")) - _efron_sum(lambda ph, j=j: s1(j, ph) / den(ph))).alias(f"u_{j}"))
        for j, k in _pairs(p):
            aggs.append(F.sum(_efron_sum(lambda ph, j=j, k=k: (F.col(f"S_v2_{j}_{k}") - ph * F.col(f"A_v2_{j}_{k}")) / den(ph)
                                         - s1(j, ph) * s1(k, ph) / (den(ph) * den(ph)))).alias(f"i_{j}_{k}"))
    else:  # one aggregate over all times; event terms only where D > 0
        ev = F.col("D") > 0

        def at_events(c):
            return F.when(ev, c).otherwise(F.lit(0.0))

        aggs = [F.sum(at_events(F.col("Dxb") - F.col("D") * F.log(s0))).alias("ll")]
        for j in range(p):
            aggs.append(F.sum(at_events(F.col(f"Dx_{j}") - F.col("D") * F.col(f"S_v1_{j}") / s0)).alias(f"u_{j}"))
        for j, k in _pairs(p):
            aggs.append(F.sum(at_events(-F.col("D") * F.col(f"S_v1_{j}") * F.col(f"S_v1_{k}") / (s0 * s0))
                              - F.col("_H") * F.col(f"v2_{j}_{k}")).alias(f"i_{j}_{k}"))
    row = e.agg(*aggs).collect()[0]
    ll = float(row["ll"] or 0.0)
    u = np.array([float(row[f"u_{j}"] or 0.0) for j in range(p)])
    info = np.zeros((p, p))
    for j, k in _pairs(p):
        info[j, k] = info[k, j] = float(row[f"i_{j}_{k}"] or 0.0)
    return ll, u, info


def cox(df: DataFrame, spec: SurvSpec, terms: Sequence[str], strata: str | None = None, weight: str | None = None,
        ties: str = "breslow", max_iter: int = 50, name: str = "cox") -> FitResult:
    """Cox PH with delayed entry, ties 'breslow' (Stata's default) or 'efron'
    (R's default; unit weights); Newton on the driver, every pass on Spark."""
    if ties not in ("breslow", "efron"):
        raise ValueError("ties: 'breslow' or 'efron'")
    if ties == "efron" and weight:
        raise ValueError("efron ties are implemented for unit weights")
    terms = list(terms)
    sets = risk_sets(cox_design(df, spec, terms, strata, weight), terms)
    theta, ll, vcov, conv, it, ll0 = _maximum(sets, ties == "efron", max_iter)
    return FitResult(name, [("xb", terms)], theta, vcov, ll, sets.n, sets.events, conv, it,
                     extra={"dist": "cox", "ll0": ll0, "risk_sets": sets, "strata": strata, "ties": ties,
                            "source": (df, spec, weight)})


def _maximum(sets: RiskSets, efron: bool = False, max_iter: int = 50):
    """Newton on the driver, every pass on Spark; the first pass, at 0, gives the null log-likelihood."""
    seen: list = []

    def evalf(b):
        ll, u, info = risk_stats(sets, b, efron)
        if not seen:
            seen.append(float(ll[0]))
        return float(ll[0]), u[0], -info[0]

    theta, ll, _g, _h, vcov, conv, it = newton(evalf, np.zeros(len(sets.names)), max_iter=max_iter)
    return theta, ll, vcov, conv, it, seen[0]


def _time_blocks(fit: FitResult) -> tuple[DataFrame, DataFrame]:
    """The fit's design and the cuts of its time blocks, made when a curve is asked for."""
    if "design" not in fit.extra:
        if "source" not in fit.extra:
            raise ValueError(f"{fit.model}: a fit with coefficients that vary with time has no baseline curve here")
        df, spec, weight = fit.extra["source"]
        design = materialize(cox_design(df, spec, fit.equations[0][1], fit.extra["strata"], weight), spread=True)
        fit.extra["design"], fit.extra["cuts"] = design, blocks_from_quantiles(design.select(F.col("t").alias("time")), "time")
    return fit.extra["design"], fit.extra["cuts"]


# ---------------------------------------------------------------- X6 episodes
def split_episodes(df: DataFrame, spec: SurvSpec, cuts: Sequence[float], keep: Sequence[str] = ()) -> DataFrame:
    """Split every interval (start, stop] at the cut times strictly inside it.

    The cut list is a driver-side sorted array with a size bound checked by the
    caller (event times); each row finds its cuts with two Bucketizer lookups
    and explodes only those, so the cost is rows + episodes, never rows x cuts."""
    from pyspark.ml.feature import Bucketizer

    cuts = sorted(set(float(c) for c in cuts))
    if not cuts:
        return df.select(*keep, F.col(spec.start).alias("e_start"), F.col(spec.stop).alias("e_stop"),
                         F.col(spec.event).alias("e_event"))
    splits = [float("-inf")] + cuts + [float("inf")]
    b1 = Bucketizer(splits=splits, inputCol="_s", outputCol="_is", handleInvalid="keep")
    b2 = Bucketizer(splits=splits, inputCol="_e", outputCol="_ie", handleInvalid="keep")
    d = df.withColumns({"_s": F.col(spec.start).cast("double"), "_e": F.col(spec.stop).cast("double")})
    d = b2.transform(b1.transform(d))
    arr = F.array(*[F.lit(c) for c in cuts])
    # bucket i covers [cuts[i-1], cuts[i]); cuts strictly inside (s, e): indices is+1 .. ie (1-based),
    # excluding a cut equal to e (an interval is not split at its own end)
    lo = F.col("_is").cast("int") + 1
    hi = F.col("_ie").cast("int")
    inner = F.filter(F.slice(arr, lo, F.greatest(hi - lo + 1, F.lit(0))),
                     lambda c: (c > F.col("_s")) & (c < F.col("_e")))
    bounds = F.concat(F.array(F.col("_s")), inner, F.array(F.col("_e")))
    d = d.withColumn("_b", bounds)
    d = d.select(*keep, F.col(spec.event).alias("_ev"), "_b",
                 F.posexplode(F.sequence(F.lit(1), F.size("_b") - 1)).alias("_k", "_i"))
    last = F.col("_i") == F.size("_b") - 1
    return d.select(*keep, F.element_at("_b", F.col("_i")).alias("e_start"),
                    F.element_at("_b", F.col("_i") + 1).alias("e_stop"),
                    F.when(last, F.col("_ev")).otherwise(F.lit(0)).cast("int").alias("e_event"))


MAX_CUTS = 10_000  # above this, cuts stay a DataFrame and are matched by a binned equi-join
CUTS_PER_CHUNK = 1024
BIN_WIDTH = 2         # a bin is as wide as so many intervals of mean width, so an interval meets about 1.5 bins
CHUNKS_PER_BIN = 64   # but no wider: a task holds a bin's cells in memory (2 MB)
SALTS = 32            # a bin's intervals go to so many groups at least
GROUP_ROWS = 1 << 17  # and to more if there are more than so many a group, which a task holds in memory


def split_episodes_join(df: DataFrame, spec: SurvSpec, cuts: DataFrame, keep: Sequence[str] = (),
                        n_bins: int | None = None, prepared: bool = False) -> DataFrame:
    """X6 for any number of cut times: cuts (column ``c``) and intervals meet in time bins (equi-join on the bin).

    A chunk (``n_bins`` in all) holds the cells (cut, next cut] of its cuts as one sorted array, and a bin is as many
    chunks as two intervals of mean width cross: an interval meets every bin from its start's to its stop's and there the
    chunks that it overlaps; an episode is the common part of the interval and a cell. Episodes, whose number grows with
    intervals x cuts, are made where they leave the query; only intervals, once per bin, and chunks are shuffled, so that
    what is shuffled grows with intervals + cuts until a mean interval crosses CHUNKS_PER_BIN chunks.
    ``prepared``: df is checkpointed already. Exact; no broadcast, no range join, no cap."""
    from pyspark.ml.feature import Bucketizer

    spark = df.sparkSession
    rows = df.select(*keep, F.col(spec.start).cast("double").alias("_s"), F.col(spec.stop).cast("double").alias("_e"),
                     F.col(spec.event).alias("_ev"))
    rows = rows if prepared else materialize(rows)
    c = F.col("c")
    cuts = materialize(cuts.select(c.cast("double").alias("c")).where((c > float("-inf")) & (c < float("inf"))).distinct())
    n_bins = n_bins or max(1, -(-cuts.count() // CUTS_PER_CHUNK))
    edges = sorted(set(cuts.approxQuantile("c", [i / n_bins for i in range(1, n_bins)], 0.25 / n_bins))) if n_bins > 1 else []

    def binned(d: DataFrame, i: str, o: str) -> DataFrame:
        if not edges:
            return d.withColumn(o, F.lit(0))
        bz = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol=i, outputCol=o, handleInvalid="keep")
        return bz.transform(d).withColumn(o, F.col(o).cast("int"))

    spans = binned(binned(rows.where(F.col("_s") < F.col("_e")), "_s", "_bs"), "_e", "_be")
    crossed = spans.agg(F.avg(F.col("_be") - F.col("_bs"))).first()[0] or 0.0
    width = min(CHUNKS_PER_BIN, max(1, int(np.ceil(BIN_WIDTH * crossed))))
    spans = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_bs") / width).cast("int"),
                                                          F.floor(F.col("_be") / width).cast("int")))).drop("_bs", "_be")
    cores = spark.sparkContext.defaultParallelism
    bins = len(edges) // width + 1
    most = spans.groupBy("_bin").count().agg(F.max("count")).first()[0] or 0
    salts = max(SALTS, -(-4 * cores // bins), -(-most // GROUP_ROWS))
    # rows are read from a checkpoint, so the salt of a row is the same in every attempt
    spans = spans.withColumn("_salt", (F.monotonically_increasing_id() % salts).cast("int"))

    # edges are cuts, so the cell that an interval starts in lies in the chunk of its start
    first = spark.createDataFrame([(float("-inf"),)], "c double")
    chunks = binned(cuts.unionByName(first), "c", "_chunk").groupBy("_chunk").agg(F.sort_array(F.collect_list("c")).alias("_from"))
    ends = F.array(*[F.lit(x) for x in [*edges, float("nan")]])  # NaN is above all
    chunks = chunks.select("_chunk", F.floor(F.col("_chunk") / width).cast("int").alias("_bin"), "_from", F.element_at("_from", 1).alias("_lo"),
                           F.element_at(ends, F.col("_chunk") + 1).alias("_hi"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(bins * salts, 16 * cores))
    # First the intervals of each chunk, chunk by chunk (neighbouring episodes share their times, which files compress well),
    # then its cells: Spark holds what one row of the left side gives, which is one episode a cell of one chunk.
    met = chunks.select("_bin", "_salt", "_chunk", "_lo", "_hi").join(spans.repartition(parts, "_bin", "_salt").hint("merge"), ["_bin", "_salt"]) \
        .where((F.col("_lo") < F.col("_e")) & (F.col("_hi") > F.col("_s"))).drop("_lo", "_hi")
    # the chunk is not a join key, or the meetings, which grow with intervals x chunks, would be shuffled by it
    to = F.concat(F.slice("_from", F.lit(2), F.size("_from") - 1), F.array("_hi"))
    cells = chunks.repartition(parts, "_bin", "_salt").select("_bin", "_salt", F.col("_chunk").alias("_at"), F.arrays_zip("_from", to.alias("_to")).alias("_cells"))
    met = met.join(cells.hint("merge"), ["_bin", "_salt"]).where(F.col("_at").between(F.col("_chunk"), F.col("_chunk")))
    ep = met.select(*keep, "_s", "_e", "_ev", F.inline("_cells")).where((F.col("_from") < F.col("_e")) & (F.col("_to") > F.col("_s"))) \
        .select(*keep, F.greatest("_s", "_from").alias("e_start"), F.least("_to", "_e").alias("e_stop"), "_e", "_ev")
    # without a start, a stop or a length there is nothing to split
    known = F.col("_s").isNotNull() & F.col("_e").isNotNull()
    whole = rows.where(~F.coalesce(F.col("_s") < F.col("_e"), F.lit(False)) & F.coalesce("_s", "_e").isNotNull()) \
        .select(*keep, F.when(known, F.least("_s", "_e")).alias("e_start"), F.greatest("_s", "_e").alias("e_stop"), "_e", "_ev")
    return ep.unionByName(whole).select(*keep, "e_start", "e_stop", F.when(F.col("e_stop") == F.col("_e"), F.col("_ev"))
                                        .otherwise(F.lit(0)).cast("int").alias("e_event"))


def cox_tvc(df: DataFrame, spec: SurvSpec, terms: Sequence[str], tvc: Sequence[str],
            texp: Callable[[Column], Column], strata: str | None = None, ties: str = "breslow", max_iter: int = 50,
            name: str = "cox_tvc") -> FitResult:
    """Coefficients varying with time: extra covariates tvc_j * texp(t).

    Exact, and no interval is split: risk-set sums are kept per distinct vector of the tvc
    columns, and exp(c texp(t) z) multiplies them at each event time. Rows where a term or tvc column is null are
    left out. tvc columns with more than 256 distinct vectors take the other exact
    way: intervals split at the event times (binned equi-join), then an ordinary fit."""
    terms, tvc = list(terms), list(tvc)
    columns = list(dict.fromkeys(terms + tvc))
    try:
        sets = risk_sets(cox_design(df, spec, columns, strata), terms, tvc, texp)
    except TooManyPatterns:
        return _cox_tvc_split(df, spec, terms, tvc, texp, strata, ties, max_iter, name)
    theta, ll, vcov, conv, it, ll0 = _maximum(sets, ties == "efron", max_iter)
    return FitResult(name, [("xb", sets.names)], theta, vcov, ll, sets.n, sets.events, conv, it,
                     extra={"dist": "cox", "ll0": ll0, "risk_sets": sets, "strata": strata, "ties": ties})


def _cox_tvc_split(df, spec, terms, tvc, texp, strata, ties, max_iter, name) -> FitResult:
    ev = F.col(spec.event)
    cuts = df.filter(ev.isNotNull() & (ev != 0)).select(F.col(spec.stop).cast("double").alias("c")).distinct()
    keep = list(dict.fromkeys(terms + tvc + ([strata] if strata else [])))
    start = F.coalesce(F.col(spec.start).cast("double"), F.lit(0.0)).alias(spec.start)
    ep = split_episodes_join(df.select(*keep, start, spec.stop, spec.event), spec, cuts, keep=keep)
    ep = ep.withColumns({f"{z}_t": F.col(z).cast("double") * texp(F.col("e_stop")) for z in tvc})
    return cox(ep, SurvSpec("e_start", "e_stop", "e_event"), terms + [f"{z}_t" for z in tvc], strata, ties=ties,
               max_iter=max_iter, name=name)


# ---------------------------------------------------------------- X7-X9
def base_hazard(fit: FitResult) -> DataFrame:
    """Breslow baseline cumulative hazard H0(t) = sum over event times s <= t of D_s / S0(s)."""
    design, ref = _time_blocks(fit)
    terms = fit.equations[0][1]
    tt, _ = risk_moments(design, terms, fit.params, ref)
    h = tt.withColumn("_dh", F.when(F.col("D") > 0, F.col("D") / F.col("S_v0")).otherwise(F.lit(0.0)))
    h = ordered_scan(h, ["_stratum"], ["time"], cumsum={"H0": "_dh"})
    return h.select("_stratum", "time", "H0", "D", "S_v0", *[c for c in h.columns if c.startswith("S_v1_")], "_blk")


def _valid(df: DataFrame, spec: SurvSpec, terms: Sequence[str]) -> DataFrame:
    """The rows that a fit uses (see cox_design); a term that df lacks is an error."""
    lacking = [t for t in terms if t not in df.columns]
    if lacking:
        raise ValueError(f"terms of the fit are not columns of the data: {lacking}")
    start = F.coalesce(F.col(spec.start).cast("double"), F.lit(0.0))
    d = df.filter(F.col(spec.stop).isNotNull() & (F.col(spec.stop).cast("double") > start))
    for t in terms:
        d = d.filter(F.col(t).isNotNull())
    return d


def schoenfeld(fit: FitResult, df: DataFrame, spec: SurvSpec, keep: Sequence[str] = ()) -> DataFrame:
    """X - xbar(t) at each event row, xbar = S1/S0 at its time (equi-join on time)."""
    terms = fit.equations[0][1]
    bh = base_hazard(fit)
    strata = fit.extra.get("strata")
    xbar = bh.filter(F.col("D") > 0).select(
        F.col("_stratum").alias("_xs"), F.col("time").alias("_time"), *[(F.col(f"S_v1_{j}") / F.col("S_v0")).alias(f"_xbar_{j}") for j in range(len(terms))])
    ev = F.col(spec.event)
    rows = _valid(df, spec, terms).filter(ev.isNotNull() & (ev != 0)).select(
        *keep, (F.col(strata) if strata else F.lit(0)).alias("_rs"), F.col(spec.stop).cast("double").alias("time"),
        *[F.col(t).cast("double").alias(t) for t in terms])
    j = rows.join(xbar, (rows["time"] == xbar["_time"]) & rows["_rs"].eqNullSafe(xbar["_xs"]), "inner")
    return j.select(*keep, "time", *[(F.col(t) - F.col(f"_xbar_{i}")).alias(f"r_{t}") for i, t in enumerate(terms)])


def cox_snell(fit: FitResult, df: DataFrame, spec: SurvSpec, keep: Sequence[str] = ()) -> DataFrame:
    """r = e^{x b} (H0(stop) - H0(start)) per row; H0 looked up as-of (union +
    carried scan, no range join)."""
    terms = fit.equations[0][1]
    strata = fit.extra.get("strata")
    bh = base_hazard(fit).select("_stratum", "time", "H0", "_blk")
    ev = F.col(spec.event)
    start = F.coalesce(F.col(spec.start).cast("double"), F.lit(0.0))
    base = _valid(df, spec, terms).select(*keep, (F.col(strata) if strata else F.lit(0)).alias("_stratum"), start.alias("_t0"), F.col(spec.stop).cast("double").alias("_t1"),
                     F.when(ev.isNotNull() & (ev != 0), 1).otherwise(0).alias("event"),
                     F.exp(_xb(terms, fit.params)).alias("_r"),
                     F.monotonically_increasing_id().alias("_rid"))
    base = materialize(base)  # stable row ids for the two lookups
    curve = bh.select("_stratum", F.lit(0).alias("_rid"), "time", F.lit(0).alias("_kind"), F.col("H0").alias("_h"))
    out = base
    for side, col in (("_h1", "_t1"), ("_h0", "_t0")):
        probes = base.select("_stratum", "_rid", F.col(col).alias("time"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_h"))
        u = blocks_like(curve.unionByName(probes), "time", bh)
        u = ordered_scan(u, ["_stratum"], ["time", "_kind", "_rid"], fill_down={"_hcarry": "_h"})
        look = u.filter(F.col("_kind") == 1).select("_rid", F.coalesce(F.col("_hcarry"), F.lit(0.0)).alias(side))
        out = out.join(look, "_rid")
    return out.select(*keep, "event", (F.col("_r") * (F.col("_h1") - F.col("_h0"))).alias("cs_resid"))


def fixed_fit(df: DataFrame, spec: SurvSpec, terms: Sequence[str], beta: Sequence[float], strata: str | None = None,
              name: str = "cox_fixed") -> FitResult:
    """A Cox 'fit' at a given beta (no Newton): design checkpointed, time cuts made,
    so base_hazard / schoenfeld / cox_snell can be evaluated at any coefficients."""
    terms = list(terms)
    design = materialize(cox_design(df, spec, terms, strata), spread=True)
    ref = blocks_from_quantiles(design.select(F.col("t").alias("time")), "time")
    b = np.array(beta, dtype=float)
    ll, u, info = cox_stats(design, terms, b, ref)
    return FitResult(name, [("xb", terms)], b, np.full((len(b), len(b)), np.nan), ll, 0, 0.0, False, 0,
                     extra={"dist": "cox", "design": design, "cuts": ref, "strata": strata, "ties": "breslow"})
