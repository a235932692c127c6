"""DuckDB oracle text for the preparation chain (plain window SQL).

The oracle is written independently of the Spark plan: ordinary
``PARTITION BY id`` windows, no blocks, so it cross-checks the skew-safe scans.
"""

from __future__ import annotations

from ..sources.person_period import orders_pp_oracle_cte, pp_oracle_cte

W_ID = "PARTITION BY id ORDER BY visit"


def _fill(c: str) -> str:
    return (f"COALESCE(last_value({c} IGNORE NULLS) OVER ({W_ID} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"first_value({c} IGNORE NULLS) OVER ({W_ID} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}")


def _cut(c: str, out: str) -> str:
    return (f"CAST(CASE WHEN {c} >= 0 AND {c} < 50 THEN 1 WHEN {c} >= 50 AND {c} < 90 THEN 2 "
            f"WHEN {c} >= 90 AND {c} < 95 THEN 3 WHEN {c} >= 95 AND {c} < 101 THEN 4 END AS INT) AS {out}")


CTE = {
    "pp": pp_oracle_cte(),
    "ppo": orders_pp_oracle_cte(),
    "o1": f"""o1 AS (SELECT *, CAST(CASE WHEN status IN (1, 2) THEN 1 WHEN measure < 0.5 THEN 1
        WHEN measure < 0.005 * first_value(measure) OVER ({W_ID} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) THEN 1
        WHEN status = 0 AND measure IS NULL THEN NULL ELSE 0 END AS INT) AS outcome FROM pp)""",
    "o2": """o2 AS (SELECT * EXCLUDE (_p) FROM (SELECT *, max(CASE WHEN b_start = 0 AND outcome = 1 THEN 1 ELSE 0 END)
        OVER (PARTITION BY id) AS _p FROM o1) WHERE _p = 0)""",
    "o3": f"""o3 AS (SELECT * REPLACE (
        CASE WHEN t_start > t_stop AND lag(t_start) OVER w IS NOT NULL THEN (lag(t_start) OVER w + t_stop) / 2 ELSE t_start END AS t_start,
        CASE WHEN lead(t_start) OVER w > lead(t_stop) OVER w THEN (t_start + lead(t_stop) OVER w) / 2 ELSE t_stop END AS t_stop,
        CASE WHEN b_start > b_stop AND lag(b_start) OVER w IS NOT NULL THEN (lag(b_start) OVER w + b_stop) / 2 ELSE b_start END AS b_start,
        CASE WHEN lead(b_start) OVER w > lead(b_stop) OVER w THEN (b_start + lead(b_stop) OVER w) / 2 ELSE b_stop END AS b_stop)
        FROM o2 WINDOW w AS ({W_ID}))""",
    "o4": """o4 AS (SELECT * EXCLUDE (_fe) FROM (SELECT *, min(CASE WHEN outcome = 1 THEN visit END) OVER (PARTITION BY id) AS _fe
        FROM o3) WHERE _fe IS NULL OR visit <= _fe)""",
    "l1": """l1 AS (SELECT * EXCLUDE (_lk) REPLACE (CAST(COALESCE(outcome, 0) AS INT) AS outcome) FROM (
        SELECT *, max(CASE WHEN outcome IS NOT NULL THEN visit END) OVER (PARTITION BY id) AS _lk FROM o4) WHERE visit <= _lk)""",
    "l2": f"""l2 AS (SELECT * REPLACE ({_fill('sbp')}, {_fill('dbp')}, {_fill('income')}, {_fill('race')}, {_fill('lbw')}) FROM l1)""",
    "l3": f"""l3 AS (SELECT *, {_cut('sbp', 'sbp_group')}, {_cut('dbp', 'dbp_group')} FROM l2)""",
    "l4": """l4 AS (SELECT *, CASE WHEN max(CASE WHEN sbp_group IS NULL OR dbp_group IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY id) = 1
        THEN NULL ELSE max(greatest(sbp_group, dbp_group)) OVER (PARTITION BY id) END AS bp_group FROM l3)""",
    "l5": f"""l5 AS (SELECT * REPLACE (CAST(row_number() OVER ({W_ID}) AS INT) AS visit) FROM l4)""",
    "locf": """locf AS (SELECT * FROM l5 WHERE bp_group IS NOT NULL AND income IS NOT NULL AND race IS NOT NULL
        AND lbw IS NOT NULL)""",
    "c1": """c1 AS (SELECT * FROM o4 WHERE outcome IS NOT NULL AND sbp IS NOT NULL AND dbp IS NOT NULL
        AND income IS NOT NULL AND race IS NOT NULL AND lbw IS NOT NULL)""",
    "c2": f"""c2 AS (SELECT *, {_cut('sbp', 'sbp_group')}, {_cut('dbp', 'dbp_group')} FROM c1)""",
    "c3": """c3 AS (SELECT *, CASE WHEN max(CASE WHEN sbp_group IS NULL OR dbp_group IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY id) = 1
        THEN NULL ELSE max(greatest(sbp_group, dbp_group)) OVER (PARTITION BY id) END AS bp_group FROM c2)""",
    "cc": f"""cc AS (SELECT * REPLACE (CAST(row_number() OVER ({W_ID}) AS INT) AS visit) FROM c3)""",
    "sd": """sd AS (SELECT *,
        CAST(CASE WHEN sbp_group = 1 THEN 1 ELSE 0 END AS INT) AS sbp_group1,
        CAST(CASE WHEN sbp_group = 2 THEN 1 ELSE 0 END AS INT) AS sbp_group2,
        CAST(CASE WHEN sbp_group = 3 THEN 1 ELSE 0 END AS INT) AS sbp_group3,
        CAST(CASE WHEN sbp_group = 4 THEN 1 ELSE 0 END AS INT) AS sbp_group4,
        CAST(CASE WHEN income IN (3, 4, 5, 6) THEN 2 WHEN income = 7 THEN 3 WHEN income = 8 THEN 4 ELSE 1 END AS INT) AS income_recode,
        CAST(CASE WHEN race = 1 THEN 1 WHEN race = 2 THEN 2 ELSE 3 END AS INT) AS race_recode FROM locf)""",
}

DEPS = {
    "pp": [], "ppo": [], "o1": ["pp"], "o2": ["o1"], "o3": ["o2"], "o4": ["o3"],
    "l1": ["o4"], "l2": ["l1"], "l3": ["l2"], "l4": ["l3"], "l5": ["l4"], "locf": ["l5"],
    "c1": ["o4"], "c2": ["c1"], "c3": ["c2"], "cc": ["c3"], "sd": ["locf"],
}


def with_ctes(body: str, *needed: str, extra: list[str] | None = None) -> str:
    """Prefix ``body`` with the CTE chain that defines the named relations."""
    order: list[str] = []

    def visit(n: str):
        for d in DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in needed:
        visit(n)
    parts = [CTE[n] for n in order] + list(extra or [])
    return "WITH " + ",\n".join(parts) + "\n" + body
