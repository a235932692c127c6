"""Person-period surgery.

Every operator takes a ``SubjectSpec`` naming the subject key and a unique
order within the subject.  All per-subject work goes through
``plans.scan.ordered_scan``: local windows over (subject, block), carries over
a small block table, so a subject with a third of all rows is still split
across tasks.  Subject-level flags (prevalent, first event, last known status)
are scan aggregates, not joins against a collected list.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scan import BLOCK, blocks_for_hot_groups, ordered_scan
from ..sources.person_period import SUBJECT_BLOCK_ROWS


@dataclass(frozen=True)
class SubjectSpec:
    id: str = "id"
    order: tuple = ("visit",)
    block: str = BLOCK
    block_rows: int = SUBJECT_BLOCK_ROWS


PP = SubjectSpec()


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def with_blocks(df: DataFrame, spec: SubjectSpec = PP) -> DataFrame:
    """Make sure rows carry a block number monotone in the subject order."""
    if spec.block in df.columns:
        return df
    return blocks_for_hot_groups(df, [spec.id], spec.order[0], spec.block_rows, block=spec.block)


def scan(df: DataFrame, spec: SubjectSpec = PP, **ops) -> DataFrame:
    df = with_blocks(df, spec)
    # chained per-subject steps on a hot (blocked) frame are checkpointed one by one
    return ordered_scan(df, [spec.id], list(spec.order), spec.block, checkpoint=True, **ops)


def _order_struct(spec: SubjectSpec) -> Column:
    return F.struct(*[_c(o) for o in spec.order])


# ---------------------------------------------------------------- P1, P2
def number_visits(df: DataFrame, spec: SubjectSpec = PP, out: str = "visit") -> DataFrame:
    """1..n in subject order (renumbers after filtering)."""
    return scan(df, spec, row_number=out)


def first_value(df: DataFrame, col: str, spec: SubjectSpec = PP, out: str | None = None) -> DataFrame:
    """Value on the subject's first row, null kept (``x[1]``)."""
    return scan(df, spec, first={out or f"{col}_first": col})


# ---------------------------------------------------------------- P3
def composite_outcome(df: DataFrame, spec: SubjectSpec = PP, status: str = "status", measure: str = "measure",
                      floor: float = 15.0, drop: float = 0.5, out: str = "outcome") -> DataFrame:
    """First matching rule wins; null tests fall through.

    status 1 or 2 -> 1; measure < floor -> 1; measure < drop * first measure -> 1;
    status 0 and measure missing -> null; else 0.  'first' is the subject's first
    row before any filter.
    """
    d = first_value(df, measure, spec, out="_m1")
    s, m = F.col(status), F.col(measure)
    expr = (F.when(s.isin(1, 2), 1)
            .when(m < F.lit(floor), 1)
            .when(m < F.lit(drop) * F.col("_m1"), 1)
            .when((s == 0) & m.isNull(), F.lit(None))
            .otherwise(0))
    return d.withColumn(out, expr.cast("int")).drop("_m1")


# ---------------------------------------------------------------- P4, J1
def drop_prevalent(df: DataFrame, spec: SubjectSpec = PP, time_col: str = "b_start",
                   event: str = "outcome", origin: float = 0.0) -> DataFrame:
    """Remove every subject with an event at the time origin."""
    flag = F.when((F.col(time_col) == F.lit(origin)) & (F.col(event) == 1), 1).otherwise(0)
    d = scan(df, spec, maximum={"_prev": flag})
    return d.filter(F.col("_prev") == 0).drop("_prev")


def exclude_ids(df: DataFrame, bad: DataFrame, id_col: str = "id") -> DataFrame:
    """J1 in join form: anti join on id (null ids kept, never NOT IN)."""
    return df.join(bad.select(id_col).distinct(), on=id_col, how="left_anti")


# ---------------------------------------------------------------- P5, J2
def repair_intervals(df: DataFrame, spec: SubjectSpec = PP,
                     clocks: Sequence[tuple[str, str]] = (("t_start", "t_stop"), ("b_start", "b_stop"))) -> DataFrame:
    """P5: where the next interval ends before it starts, the shared bound of the
    two intervals becomes the midpoint of the outer bounds (prev.start, next.stop),
    written as prev.stop and next.start; each clock separately."""
    lead, lag = {}, {}
    for a, b in clocks:
        lead[f"_n_{a}"], lead[f"_n_{b}"] = a, b
        lag[f"_p_{a}"] = a
    d = scan(df, spec, lead=lead, lag=lag)
    upd = {}
    for a, b in clocks:
        nxt_bad = F.col(f"_n_{a}") > F.col(f"_n_{b}")
        mid_next = (F.col(a) + F.col(f"_n_{b}")) / 2
        me_bad = F.col(a) > F.col(b)
        mid_prev = (F.col(f"_p_{a}") + F.col(b)) / 2
        upd[b] = F.when(nxt_bad, mid_next).otherwise(F.col(b))
        upd[a] = F.when(me_bad & F.col(f"_p_{a}").isNotNull(), mid_prev).otherwise(F.col(a))
    d = d.withColumns(upd)
    return d.drop(*lead.keys(), *lag.keys())


def apply_corrections(df: DataFrame, corrections: DataFrame, keys: Sequence[str] = ("id", "visit"),
                      columns: Sequence[str] | None = None) -> DataFrame:
    """Keyed corrections table (keys..., column, value) replaces hard-coded edits."""
    keys = list(keys)
    columns = list(columns) if columns is not None else [
        r[0] for r in corrections.select("column").distinct().limit(len(df.columns) + 1).collect()]
    unknown = sorted(set(columns) - set(df.columns))
    if unknown:
        raise ValueError(f"corrections of unknown columns: {unknown}")
    wide = corrections.groupBy(*keys).pivot("column", columns).agg(F.first("value"))
    wide = wide.select(*keys, *[F.col(c).alias(f"_fix_{c}") for c in columns])
    j = df.join(wide, on=keys, how="left")
    return j.withColumns({c: F.coalesce(F.col(f"_fix_{c}").cast(df.schema[c].dataType), F.col(c))
                          for c in columns}).drop(*[f"_fix_{c}" for c in columns])


# ---------------------------------------------------------------- P6-P9
def truncate_at_first(df: DataFrame, spec: SubjectSpec = PP, event: str = "outcome") -> DataFrame:
    """Keep rows up to the first row with event == 1 (all rows if none)."""
    first_ev = F.when(F.col(event) == 1, _order_struct(spec))
    d = scan(df, spec, minimum={"_fe": first_ev})
    keep = F.col("_fe").isNull() | (_order_struct(spec) <= F.col("_fe"))
    return d.filter(keep).drop("_fe")


def trim_unknown_tail(df: DataFrame, spec: SubjectSpec = PP, event: str = "outcome", fill_zero: bool = True) -> DataFrame:
    """Drop rows after the last row with known status (reverse cumulative
    count of known rows > 0), then unknown status inside follow-up -> 0."""
    last_known = F.when(F.col(event).isNotNull(), _order_struct(spec))
    d = scan(df, spec, maximum={"_lk": last_known})
    d = d.filter(_order_struct(spec) <= F.col("_lk")).drop("_lk")
    if fill_zero:
        d = d.withColumn(event, F.coalesce(F.col(event), F.lit(0)).cast(df.schema[event].dataType))
    return d


def fill(df: DataFrame, cols: Sequence[str], spec: SubjectSpec = PP, direction: str = "downup",
         max_gap: int | None = None) -> DataFrame:
    """Carry values within a subject: down, up, downup or updown.

    No limit by default (what the reference's code does).  ``max_gap=k`` carries a
    value at most k steps of the first order column (visits) away, which is what
    the reference's comment ('one cycle') describes."""
    o = F.col(spec.order[0])

    def tagged(c):
        return F.when(F.col(c).isNotNull(), F.struct(o.alias("o"), F.col(c).alias("v"))) if max_gap is not None else c

    fd = {f"_d_{c}": tagged(c) for c in cols} if "down" in direction else {}
    fu = {f"_u_{c}": tagged(c) for c in cols} if "up" in direction else {}
    d = scan(df, spec, fill_down=fd, fill_up=fu)
    if max_gap is not None:
        lim = F.lit(int(max_gap))
        d = d.withColumns({**{k: F.when(o - F.col(k).getField("o") <= lim, F.col(k).getField("v")) for k in fd},
                           **{k: F.when(F.col(k).getField("o") - o <= lim, F.col(k).getField("v")) for k in fu}})
    upd = {}
    for c in cols:
        dt = df.schema[c].dataType
        if direction == "down":
            e = F.col(f"_d_{c}")
        elif direction == "up":
            e = F.col(f"_u_{c}")
        elif direction == "downup":
            e = F.coalesce(F.col(f"_d_{c}"), F.col(f"_u_{c}"))
        elif direction == "updown":
            e = F.coalesce(F.col(f"_u_{c}"), F.col(f"_d_{c}"))
        else:
            raise ValueError(direction)
        upd[c] = e.cast(dt)
    return d.withColumns(upd).drop(*fd.keys(), *fu.keys())


# ---------------------------------------------------------------- P10-P14
def visit_gaps(df: DataFrame, spec: SubjectSpec = PP, visit: str = "visit") -> DataFrame:
    """P10: frequency table of visit - previous visit (first rows left out)."""
    d = scan(df, spec, lag={"_pv": visit})
    gap = (F.col(visit) - F.col("_pv")).cast("int")
    return d.select(gap.alias("visit_gap")).filter(F.col("visit_gap").isNotNull()) \
        .groupBy("visit_gap").agg(F.count(F.lit(1)).alias("n"))


def last_row(df: DataFrame, spec: SubjectSpec = PP) -> DataFrame:
    """Last row of every subject."""
    d = scan(df, spec, maximum={"_lo": _order_struct(spec)})
    return d.filter(_order_struct(spec) == F.col("_lo")).drop("_lo")


def first_row(df: DataFrame, spec: SubjectSpec = PP) -> DataFrame:
    """First row of every subject, all columns (deterministic)."""
    d = scan(df, spec, minimum={"_fo": _order_struct(spec)})
    return d.filter(_order_struct(spec) == F.col("_fo")).drop("_fo")


def followup(df: DataFrame, spec: SubjectSpec = PP, start: str = "b_start", stop: str = "b_stop",
             out: str = "followup") -> DataFrame:
    """Per-subject follow-up sum(stop - start); a plain aggregate (map-side combine)."""
    return df.groupBy(spec.id).agg(F.sum(F.col(stop) - F.col(start)).alias(out),
                                   F.count(F.lit(1)).alias("n_periods"))


def joint_group(df: DataFrame, a: str, b: str, spec: SubjectSpec = PP, scope: str = "subject",
                out: str = "joint_group") -> DataFrame:
    """Max of two columns; 'subject' scope = one max over all rows of the
    subject (null if any value is null, as a grouped max would be); 'row' = per row."""
    anynull = F.col(a).isNull() | F.col(b).isNull()
    rowmax = F.when(anynull, F.lit(None)).otherwise(F.greatest(F.col(a), F.col(b)))
    if scope == "row":
        return df.withColumn(out, rowmax)
    d = scan(df, spec, maximum={"_jn": anynull.cast("int"), "_jm": F.greatest(F.col(a), F.col(b))})
    return d.withColumn(out, F.when(F.col("_jn") == 1, F.lit(None)).otherwise(F.col("_jm"))
                        .cast(df.schema[a].dataType)).drop("_jn", "_jm")
