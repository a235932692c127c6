"""Registered queries: cleaning, recodes, person-period surgery (C*, B1, P*, J*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, cohort, periods
from ..sources.person_period import PP_COLUMNS, person_periods
from .registry import r6, register, sql_r6
from .sql import with_ctes

S = periods.PP


def _pp(spark, sf):
    return person_periods(spark, sf)


@register("pp", with_ctes("SELECT * FROM pp", "pp"))
def q_pp(spark, sf):
    """Person-periods built from events (numbering and lead by blocked scan)."""
    return _pp(spark, sf).select(*PP_COLUMNS)


@register("null_token", with_ctes(
    "SELECT id, visit, CAST(measure AS DOUBLE) AS measure, CAST(sbp AS DOUBLE) AS sbp, "
    "CAST(dbp AS DOUBLE) AS dbp, CAST(income AS DOUBLE) AS income FROM pp", "pp"))
def q_null_token(spark, sf):
    """Person-periods rendered as text with '.' for missing, then '.' -> null,
    text -> number (try_cast), id -> canonical string."""
    pp = _pp(spark, sf)
    txt = pp.select(
        F.concat(F.lit("00"), F.col("id")).alias("id"), "visit",
        *[F.coalesce(F.col(c).cast("string"), F.lit(".")).alias(c) for c in ("measure", "sbp", "dbp", "income")])
    d = clean.null_token(txt, ".")
    d = clean.to_numeric(d, ["measure", "sbp", "dbp", "income"])
    return clean.id_as_string(d, "id")


@register("recode_income", with_ctes(
    "SELECT id, visit, income, CAST(CASE WHEN income IN (3, 4, 5, 6) THEN 2 WHEN income = 7 THEN 3 "
    "WHEN income = 8 THEN 4 ELSE 1 END AS INT) AS income_recode FROM pp", "pp"))
def q_recode_income(spark, sf):
    """Income 3-6 -> 2, 7 -> 3, 8 -> 4, anything else incl. missing -> 1."""
    d = clean.recode(_pp(spark, sf), "income", {3: 2, 4: 2, 5: 2, 6: 2, 7: 3, 8: 4}, default=1, out="income_recode")
    return d.select("id", "visit", "income", F.col("income_recode").cast("int"))


@register("recode_race", with_ctes(
    "SELECT id, visit, race, CAST(CASE WHEN race = 1 THEN 1 WHEN race = 2 THEN 2 ELSE 3 END AS INT) AS race_recode "
    "FROM pp", "pp"))
def q_recode_race(spark, sf):
    """Race 1 -> 1, 2 -> 2, anything else incl. missing -> 3."""
    d = clean.recode(_pp(spark, sf), "race", {1: 1, 2: 2}, default=3, out="race_recode")
    return d.select("id", "visit", "race", F.col("race_recode").cast("int"))


_CUT_SQL = ("CAST(CASE WHEN {c} >= 0 AND {c} < 50 THEN 1 WHEN {c} >= 50 AND {c} < 90 THEN 2 "
            "WHEN {c} >= 90 AND {c} < 95 THEN 3 WHEN {c} >= 95 AND {c} < 101 THEN 4 END AS INT)")


@register("cut_groups", with_ctes(
    f"SELECT id, visit, sbp, dbp, {_CUT_SQL.format(c='sbp')} AS sbp_group, {_CUT_SQL.format(c='dbp')} AS dbp_group "
    "FROM pp", "pp"))
def q_cut_groups(spark, sf):
    """B1: left-closed cut at 0, 50, 90, 95, 101; outside -> null."""
    d = clean.cut(_pp(spark, sf), "sbp", clean.BP_BREAKS, out="sbp_group")
    d = clean.cut(d, "dbp", clean.BP_BREAKS, out="dbp_group")
    return d.select("id", "visit", "sbp", "dbp", "sbp_group", "dbp_group")


@register("dummies", with_ctes(
    "SELECT id, visit, g AS sbp_group, "
    + ", ".join(f"CAST(CASE WHEN g = {k} THEN 1 ELSE 0 END AS INT) AS sbp_group{k}" for k in (1, 2, 3, 4))
    + f" FROM (SELECT *, {_CUT_SQL.format(c='sbp')} AS g FROM pp)", "pp"))
def q_dummies(spark, sf):
    """Indicator columns per group; missing group -> 0 in every indicator."""
    d = clean.cut(_pp(spark, sf), "sbp", clean.BP_BREAKS, out="sbp_group")
    d = clean.dummies(d, "sbp_group", [1, 2, 3, 4], prefix="sbp_group")
    return d.select("id", "visit", "sbp_group", *[f"sbp_group{k}" for k in (1, 2, 3, 4)])


@register("visit_number", with_ctes(
    "SELECT id, visit, CAST(row_number() OVER (PARTITION BY id ORDER BY visit) AS INT) AS seq "
    "FROM pp WHERE measure IS NOT NULL", "pp"))
def q_visit_number(spark, sf):
    """Renumber visits 1..n after a row filter."""
    d = _pp(spark, sf).filter(F.col("measure").isNotNull())
    return periods.number_visits(d, S, out="seq").select("id", "visit", "seq")


@register("first_value", with_ctes(
    "SELECT id, visit, measure, first_value(measure) OVER (PARTITION BY id ORDER BY visit "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS measure_first FROM pp", "pp"))
def q_first_value(spark, sf):
    """The subject's first-row value, null kept."""
    return periods.first_value(_pp(spark, sf), "measure", S, out="measure_first") \
        .select("id", "visit", "measure", "measure_first")


@register("composite_outcome", with_ctes("SELECT id, visit, status, measure, outcome FROM o1", "o1"))
def q_composite_outcome(spark, sf):
    """Composite outcome, first matching rule wins."""
    d = periods.composite_outcome(_pp(spark, sf), S, floor=cohort.OUTCOME_FLOOR, drop=cohort.OUTCOME_DROP)
    return d.select("id", "visit", "status", "measure", "outcome")


@register("drop_prevalent", with_ctes("SELECT id, visit, b_start, outcome FROM o2", "o2"))
def q_drop_prevalent(spark, sf):
    """P3 then P4: subjects with an event at time 0 removed."""
    d = periods.composite_outcome(_pp(spark, sf), S, floor=cohort.OUTCOME_FLOOR, drop=cohort.OUTCOME_DROP)
    return periods.drop_prevalent(d, S, "b_start", "outcome").select("id", "visit", "b_start", "outcome")


@register("repair_intervals", with_ctes(
    "SELECT id, visit, t_start, t_stop, b_start, b_stop FROM o3", "o3"))
def q_repair_intervals(spark, sf):
    """P5 after P3/P4: inverted intervals repaired at the shared bound."""
    d = periods.composite_outcome(_pp(spark, sf), S, floor=cohort.OUTCOME_FLOOR, drop=cohort.OUTCOME_DROP)
    d = periods.drop_prevalent(d, S, "b_start", "outcome")
    return periods.repair_intervals(d, S).select("id", "visit", "t_start", "t_stop", "b_start", "b_stop")


@register("truncate_first", with_ctes(
    "SELECT id, visit, outcome FROM (SELECT *, min(CASE WHEN outcome = 1 THEN visit END) OVER (PARTITION BY id) AS fe "
    "FROM o1) WHERE fe IS NULL OR visit <= fe", "o1"))
def q_truncate_first(spark, sf):
    """P6 on the outcome table: keep rows up to the first event."""
    d = periods.composite_outcome(_pp(spark, sf), S, floor=cohort.OUTCOME_FLOOR, drop=cohort.OUTCOME_DROP)
    return periods.truncate_at_first(d, S, "outcome").select("id", "visit", "outcome")


@register("outcome_periods", with_ctes(
    "SELECT id, visit, t_start, t_stop, b_start, b_stop, status, measure, outcome FROM o4", "o4"))
def q_outcome_periods(spark, sf):
    """P3 -> P4 -> P5 -> P6 chain."""
    return cohort.outcome_periods(_pp(spark, sf), S).select(
        "id", "visit", "t_start", "t_stop", "b_start", "b_stop", "status", "measure", "outcome")


@register("trim_tail", with_ctes("SELECT id, visit, outcome FROM l1", "l1"))
def q_trim_tail(spark, sf):
    """Rows after the last known status dropped, unknown inside -> 0."""
    d = cohort.outcome_periods(_pp(spark, sf), S)
    return periods.trim_unknown_tail(d, S, "outcome").select("id", "visit", "outcome")


@register("fill_downup", with_ctes("SELECT id, visit, sbp, dbp, income, race, lbw FROM l2", "l2"))
def q_fill_downup(spark, sf):
    """Last value carried forward then next value carried back, per subject."""
    d = cohort.outcome_periods(_pp(spark, sf), S)
    d = periods.trim_unknown_tail(d, S, "outcome")
    d = periods.fill(d, list(cohort.FILL_COLUMNS), S, "downup")
    return d.select("id", "visit", "sbp", "dbp", "income", "race", "lbw")


@register("joint_group_subject", with_ctes(
    f"SELECT id, visit, sbp_group, dbp_group, CASE WHEN max(CASE WHEN sbp_group IS NULL OR dbp_group IS NULL THEN 1 ELSE 0 END) "
    "OVER (PARTITION BY id) = 1 THEN NULL ELSE max(greatest(sbp_group, dbp_group)) OVER (PARTITION BY id) END AS bp_group "
    f"FROM (SELECT *, {_CUT_SQL.format(c='sbp')} AS sbp_group, {_CUT_SQL.format(c='dbp')} AS dbp_group FROM pp)", "pp"))
def q_joint_group_subject(spark, sf):
    """P14 subject scope: one max over all rows of the subject, null if any null."""
    d = clean.cut(_pp(spark, sf), "sbp", clean.BP_BREAKS, out="sbp_group")
    d = clean.cut(d, "dbp", clean.BP_BREAKS, out="dbp_group")
    d = periods.joint_group(d, "sbp_group", "dbp_group", S, scope="subject", out="bp_group")
    return d.select("id", "visit", "sbp_group", "dbp_group", "bp_group")


@register("joint_group_row", with_ctes(
    "SELECT id, visit, sbp_group, dbp_group, CASE WHEN sbp_group IS NULL OR dbp_group IS NULL THEN NULL "
    f"ELSE greatest(sbp_group, dbp_group) END AS bp_group FROM (SELECT *, {_CUT_SQL.format(c='sbp')} AS sbp_group, "
    f"{_CUT_SQL.format(c='dbp')} AS dbp_group FROM pp)", "pp"))
def q_joint_group_row(spark, sf):
    """P14 row scope."""
    d = clean.cut(_pp(spark, sf), "sbp", clean.BP_BREAKS, out="sbp_group")
    d = clean.cut(d, "dbp", clean.BP_BREAKS, out="dbp_group")
    d = periods.joint_group(d, "sbp_group", "dbp_group", S, scope="row", out="bp_group")
    return d.select("id", "visit", "sbp_group", "dbp_group", "bp_group")


@register("visit_gaps", with_ctes(
    "SELECT CAST(g AS INT) AS visit_gap, count(*) AS n FROM (SELECT visit - lag(visit) OVER (PARTITION BY id ORDER BY visit) AS g "
    "FROM c1) WHERE g IS NOT NULL GROUP BY g", "c1"))
def q_visit_gaps(spark, sf):
    """P10 on the complete-case rows: frequency of visit gaps."""
    d = cohort.outcome_periods(_pp(spark, sf), S)
    d = clean.drop_missing(d, ["outcome", "sbp", "dbp", *cohort.COVARIATES])
    return periods.visit_gaps(d, S, "visit")


@register("last_row", with_ctes(
    "SELECT id, visit, t_stop, status FROM (SELECT *, max(visit) OVER (PARTITION BY id) AS lv FROM pp) WHERE visit = lv", "pp"))
def q_last_row(spark, sf):
    """Last row per subject."""
    return periods.last_row(_pp(spark, sf), S).select("id", "visit", "t_stop", "status")


@register("first_row", with_ctes(
    "SELECT id, visit, t_start, t_stop, b_start, b_stop, status, measure, sbp, dbp, income, race, lbw "
    "FROM (SELECT *, min(visit) OVER (PARTITION BY id) AS fv FROM pp) WHERE visit = fv", "pp"))
def q_first_row(spark, sf):
    """First row per subject, all columns."""
    return periods.first_row(_pp(spark, sf), S).select(*PP_COLUMNS)


@register("followup", with_ctes(
    f"SELECT id, {sql_r6('sum(b_stop - b_start)', 'followup')}, count(*) AS n_periods FROM pp GROUP BY id", "pp"))
def q_followup(spark, sf):
    """Per-subject follow-up time (sum of interval lengths)."""
    d = periods.followup(_pp(spark, sf), S, "b_start", "b_stop")
    return d.select("id", r6("followup"), "n_periods")


@register("analysis_complete", with_ctes(
    "SELECT id, visit, t_start, t_stop, outcome, sbp_group, dbp_group, bp_group, income, race, lbw FROM cc", "cc"))
def q_analysis_complete(spark, sf):
    """Complete-case analysis set (full chain)."""
    return cohort.complete_case(_pp(spark, sf), S).select(
        "id", "visit", "t_start", "t_stop", "outcome", "sbp_group", "dbp_group", "bp_group", "income", "race", "lbw")


@register("analysis_locf", with_ctes(
    "SELECT id, visit, t_start, t_stop, outcome, sbp, dbp, sbp_group, dbp_group, bp_group, income, race, lbw FROM locf",
    "locf"))
def q_analysis_locf(spark, sf):
    """LOCF analysis set (full chain)."""
    return cohort.locf(_pp(spark, sf), S).select(
        "id", "visit", "t_start", "t_stop", "outcome", "sbp", "dbp", "sbp_group", "dbp_group", "bp_group",
        "income", "race", "lbw")


@register("survival_design", with_ctes(
    "SELECT id, visit, sbp_group, sbp_group1, sbp_group2, sbp_group3, sbp_group4, income, income_recode, race, "
    "race_recode FROM sd", "sd"))
def q_survival_design(spark, sf):
    """C8-C10 on the LOCF set: group dummies and recoded covariates."""
    d = cohort.survival_design(cohort.locf(_pp(spark, sf), S))
    return d.select("id", "visit", "sbp_group", "sbp_group1", "sbp_group2", "sbp_group3", "sbp_group4",
                    "income", "income_recode", "race", "race_recode")


@register("select_cols", with_ctes("SELECT id, visit, t_start, t_stop, b_stop, measure, sbp, dbp FROM pp", "pp"))
def q_select_cols(spark, sf):
    """Projection by names, 'contains', positional range and minus."""
    return clean.cols(_pp(spark, sf).select(*PP_COLUMNS), "id", "visit", "contains:_ST", "measure:dbp", "-b_start")


@register("assign_if", with_ctes(
    "SELECT id, visit, race, CASE WHEN race = 4 THEN 0 ELSE income END AS income FROM pp", "pp"))
def q_assign_if(spark, sf):
    """Conditional replace (null condition keeps the old value)."""
    d = clean.assign_if(_pp(spark, sf), "income", 0, F.col("race") == 4)
    return d.select("id", "visit", "race", "income")


@register("interact", with_ctes(
    f"SELECT id, visit, lbw, g2, lbw * g2 AS lbw_x_g2 FROM (SELECT *, CAST(CASE WHEN {_CUT_SQL.format(c='sbp')} = 2 "
    "THEN 1 ELSE 0 END AS INT) AS g2 FROM pp)", "pp"))
def q_interact(spark, sf):
    """Interaction product of two columns."""
    d = clean.cut(_pp(spark, sf), "sbp", clean.BP_BREAKS, out="g")
    d = clean.dummies(d, "g", [2])
    return clean.interact(d, "lbw", "g2", "lbw_x_g2").select("id", "visit", "lbw", "g2", "lbw_x_g2")


_LABELS = {1: "[0, 50)", 2: "[50, 90)", 3: "[90, 95)", 4: "[95, 100]"}  # fixed display labels of the reference


@register("relabel", with_ctes(
    "SELECT id, visit, g AS sbp_group, CASE g " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _LABELS.items())
    + " END AS sbp_label, CASE g " + " ".join(f"WHEN {k} THEN {i + 1}" for i, k in enumerate(_LABELS))
    + f" END AS display_order FROM (SELECT *, {_CUT_SQL.format(c='sbp')} AS g FROM pp)", "pp"))
def q_relabel(spark, sf):
    """C14: display labels and display order for category codes."""
    d = clean.cut(_pp(spark, sf), "sbp", clean.BP_BREAKS, out="sbp_group")
    d = clean.relabel(d, "sbp_group", _LABELS, out="sbp_label", order_col="display_order")
    return d.select("id", "visit", "sbp_group", "sbp_label", F.col("display_order").cast("int"))


@register("apply_corrections", with_ctes(
    "SELECT id, visit, COALESCE(sbp, 50.0) AS sbp, COALESCE(dbp, 50) AS dbp FROM pp", "pp"))
def q_apply_corrections(spark, sf):
    """Keyed corrections table (id, visit, column, value) joined and applied;
    the table is derived by Spark from the rows with missing blood pressure."""
    pp = _pp(spark, sf)
    corr = (pp.filter(F.col("sbp").isNull()).select("id", "visit", F.lit("sbp").alias("column"), F.lit(50.0).alias("value"))
            .unionByName(pp.filter(F.col("dbp").isNull())
                         .select("id", "visit", F.lit("dbp").alias("column"), F.lit(50.0).alias("value"))))
    d = periods.apply_corrections(pp, corr, ["id", "visit"], ["sbp", "dbp"])
    return d.select("id", "visit", "sbp", "dbp")


@register("factor_levels", with_ctes(
    "SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY level) AS INT) AS position, CAST(level AS VARCHAR) AS level "
    "FROM (SELECT DISTINCT 'income' AS name, income AS level FROM pp WHERE income IS NOT NULL UNION ALL "
    "SELECT DISTINCT 'race', race FROM pp UNION ALL SELECT DISTINCT 'lbw', lbw FROM pp)", "pp"))
def q_factor_levels(spark, sf):
    """Categorical declaration: sorted levels stored in column metadata, read back as rows."""
    d = clean.label(clean.as_factor(_pp(spark, sf), ["income", "race", "lbw"]), {"income": "income class"})
    rows = [(c, i + 1, lv) for c in ("income", "race", "lbw") for i, lv in enumerate(d.schema[c].metadata["levels"])]
    return spark.createDataFrame(rows, "name string, position int, level string")


@register("fill_one_cycle", with_ctes("SELECT id, visit, COALESCE(CASE WHEN visit - last_value(CASE WHEN sbp IS NOT NULL THEN visit END IGNORE NULLS) OVER (PARTITION BY id ORDER BY visit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 1 THEN last_value(sbp IGNORE NULLS) OVER (PARTITION BY id ORDER BY visit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END, CASE WHEN first_value(CASE WHEN sbp IS NOT NULL THEN visit END IGNORE NULLS) OVER (PARTITION BY id ORDER BY visit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - visit <= 1 THEN first_value(sbp IGNORE NULLS) OVER (PARTITION BY id ORDER BY visit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END) AS sbp, COALESCE(CASE WHEN visit - last_value(CASE WHEN dbp IS NOT NULL THEN visit END IGNORE NULLS) OVER (PARTITION BY id ORDER BY visit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 1 THEN last_value(dbp IGNORE NULLS) OVER (PARTITION BY id ORDER BY visit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END, CASE WHEN first_value(CASE WHEN dbp IS NOT NULL THEN visit END IGNORE NULLS) OVER (PARTITION BY id ORDER BY visit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - visit <= 1 THEN first_value(dbp IGNORE NULLS) OVER (PARTITION BY id ORDER BY visit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END) AS dbp, COALESCE(CASE WHEN visit - last_value(CASE WHEN income IS NOT NULL THEN visit END IGNORE NULLS) OVER (PARTITION BY id ORDER BY visit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 1 THEN last_value(income IGNORE NULLS) OVER (PARTITION BY id ORDER BY visit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END, CASE WHEN first_value(CASE WHEN income IS NOT NULL THEN visit END IGNORE NULLS) OVER (PARTITION BY id ORDER BY visit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - visit <= 1 THEN first_value(income IGNORE NULLS) OVER (PARTITION BY id ORDER BY visit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END) AS income FROM l1", "l1"))
def q_fill_one_cycle(spark, sf):
    """P9 with max_gap = 1: carry a value at most one visit forward, else one back."""
    d = cohort.outcome_periods(_pp(spark, sf), S)
    d = periods.trim_unknown_tail(d, S, "outcome")
    d = periods.fill(d, ["sbp", "dbp", "income"], S, "downup", max_gap=1)
    return d.select("id", "visit", "sbp", "dbp", "income")
