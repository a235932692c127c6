"""The reference's data-preparation chain as composable steps.

pp -> composite outcome (P3) -> drop prevalent (P4) -> repair intervals (P5)
   -> truncate at first event (P6) -> then either
      complete case: drop rows with missing exposure/covariates (F3), cut (B1),
                     joint group (P14), renumber (P1)
      LOCF:          trim unknown tail + zero (P7/P8), fill downup (P9), cut (B1),
                     joint group (P14), renumber (P1), drop missing (F3)

All per-subject steps share one (id, block) partitioning; Spark keeps the big
side's exchange across the chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clean, periods
from .periods import PP, SubjectSpec

# Fixed values of the reference, scaled to the person-period data of the driver
# tables (FIXTURES.md section 2): absolute floor and relative drop of the measure.
OUTCOME_FLOOR = 0.5
OUTCOME_DROP = 0.005
FILL_COLUMNS = ("sbp", "dbp", "income", "race", "lbw")
COVARIATES = ("income", "race", "lbw")


def outcome_periods(pp: DataFrame, spec: SubjectSpec = PP) -> DataFrame:
    d = periods.composite_outcome(pp, spec, floor=OUTCOME_FLOOR, drop=OUTCOME_DROP)
    d = periods.drop_prevalent(d, spec, time_col="b_start", event="outcome")
    d = periods.repair_intervals(d, spec)
    return periods.truncate_at_first(d, spec, event="outcome")


def _groups(d: DataFrame, spec: SubjectSpec) -> DataFrame:
    d = clean.cut(d, "sbp", clean.BP_BREAKS, out="sbp_group")
    d = clean.cut(d, "dbp", clean.BP_BREAKS, out="dbp_group")
    return periods.joint_group(d, "sbp_group", "dbp_group", spec, scope="subject", out="bp_group")


def complete_case(pp: DataFrame, spec: SubjectSpec = PP) -> DataFrame:
    d = outcome_periods(pp, spec)
    d = clean.drop_missing(d, ["outcome", "sbp", "dbp", *COVARIATES])
    d = _groups(d, spec)
    return periods.number_visits(d, spec, out="visit")


def locf(pp: DataFrame, spec: SubjectSpec = PP) -> DataFrame:
    d = outcome_periods(pp, spec)
    d = periods.trim_unknown_tail(d, spec, event="outcome")
    d = periods.fill(d, list(FILL_COLUMNS), spec, direction="downup")
    d = _groups(d, spec)
    d = periods.number_visits(d, spec, out="visit")
    return clean.drop_missing(d, ["bp_group", *COVARIATES])


def survival_design(d: DataFrame) -> DataFrame:
    """Stata-side recodes of the analysis set: group dummies, income/race classes."""
    d = clean.dummies(d, "sbp_group", [1, 2, 3, 4], prefix="sbp_group")
    # fixed recodes of the reference: income 3-6 -> 2, 7 -> 3, 8 -> 4, rest (missing too) -> 1;
    # race 1 -> 1, 2 -> 2, any other value including missing -> 3
    d = clean.recode(d, "income", {3: 2, 4: 2, 5: 2, 6: 2, 7: 3, 8: 4}, default=1, out="income_recode")
    d = clean.recode(d, "race", {1: 1, 2: 2}, default=3, out="race_recode")
    d = d.withColumn("income_recode", F.col("income_recode").cast("int"))
    return d.withColumn("race_recode", F.col("race_recode").cast("int"))
