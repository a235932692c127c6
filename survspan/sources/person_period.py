"""Person-period tables built from event streams.

One row per pair of consecutive events of a subject: the interval
(start, stop] on two clocks (calendar days since 2024-01-01 and days since
the subject's first event), the status carried by the closing event, and
measures taken at the opening event.  This is the interval data model the
reference analyses (visits of a cohort); the driver tables give it from
``events`` (and ``orders`` for a second, larger source).

Numbering and lead are done with the skew-safe ordered scan: a subject with
a third of all events is cut into time blocks, never one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scan import BLOCK, blocks_for_hot_groups, blocks_from_rank, ordered_scan

EPOCH_2024_US = 1704067200000000  # 2024-01-01T00:00:00 in microseconds
DAY_US = 86400000000.0
SUBJECT_BLOCK_ROWS = 1 << 16

PP_COLUMNS = ["id", "visit", "t_start", "t_stop", "b_start", "b_stop", "status",
              "measure", "sbp", "dbp", "income", "race", "lbw"]


def epoch_micros(col: str, dtype: str) -> Column:
    """Microseconds since 1970 for TIMESTAMP_NTZ or TIMESTAMP, independent of session time zone."""
    if dtype.startswith("timestamp_ntz"):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    return F.unix_micros(F.col(col))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_person_periods(events: DataFrame, block_rows: int = SUBJECT_BLOCK_ROWS,
                          keep_block: bool = True) -> DataFrame:
    """Person-periods from ``events(user_id, event_id, ts, event_type, value, props)``.

    Status at the closing event: purchase over 100 -> 1, error over 100 -> 2,
    else 0.  Measures at the opening event carry the test tables' gaps
    (fixed masks on event_id give missing values, as the fixture defines).
    """
    ts_type = dict(events.dtypes)["ts"]
    status = (F.when((F.col("value") > 100) & (F.col("event_type") == "purchase"), 1)
              .when((F.col("value") > 100) & (F.col("event_type") == "error"), 2)
              .otherwise(0))
    # partition on the string subject id from the start, so every later
    # per-subject step (keyed on `id`) reuses this one shuffle; it carries the
    # event's status, not its type, and no second copy of the subject id
    e = events.select(
        F.col("user_id").cast("string").alias("id"), "event_id", "value", status.alias("status"),
        epoch_micros("ts", ts_type).alias("us"),
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
    )
    e = blocks_for_hot_groups(e, ["id"], "us", block_rows)
    w = ordered_scan(
        e, ["id"], ["us", "event_id"],
        row_number="visit",
        lead={"next_us": "us", "next_status": "status"},
        minimum={"us0": "us"},
    )
    w = w.filter(F.col("next_us").isNotNull())
    eid = F.col("event_id")
    user = F.col("id").cast(dict(events.dtypes)["user_id"])
    cols = [
        F.col("id"),
        F.col("visit").cast("int").alias("visit"),
        ((F.col("us") - F.lit(EPOCH_2024_US)) / F.lit(DAY_US)).alias("t_start"),
        ((F.col("next_us") - F.lit(EPOCH_2024_US)) / F.lit(DAY_US)).alias("t_stop"),
        ((F.col("us") - F.col("us0")) / F.lit(DAY_US)).alias("b_start"),
        ((F.col("next_us") - F.col("us0")) / F.lit(DAY_US)).alias("b_stop"),
        F.col("next_status").cast("int").alias("status"),
        F.when(eid % 10 == 3, F.lit(None)).otherwise(F.col("value")).cast("double").alias("measure"),
        F.when(eid % 13 == 5, F.lit(None)).otherwise(F.col("value") % F.lit(101.0)).cast("double").alias("sbp"),
        F.when(eid % 17 == 2, F.lit(None)).otherwise(F.col("k")).cast("int").alias("dbp"),
        F.when(eid % 11 == 0, F.lit(None)).otherwise((eid % 8).cast("int") + 1).cast("int").alias("income"),
        ((user % 4).cast("int") + 1).cast("int").alias("race"),
        (user % 2).cast("int").alias("lbw"),
    ]
    out = w.select(*cols, F.col(BLOCK))
    # re-block on the dense visit number so later per-subject scans split hot
    # subjects by visit ranges (hot flag carried over)
    out = blocks_from_rank(out, "visit", block_rows)
    return out if keep_block else out.drop(BLOCK)


def orders_person_periods(orders: DataFrame, block_rows: int = SUBJECT_BLOCK_ROWS) -> DataFrame:
    """Second source: consecutive orders per customer (same-day ties broken by order key).

    Status at the closing order: 'F' -> 1 (fulfilled), else 0; measure is the
    opening order's total price.  Clocks in days since 1992-01-01 and since
    the customer's first order.
    """
    ts_type = dict(orders.dtypes)["o_orderdate"]
    o = orders.select(F.col("o_custkey").cast("string").alias("id"), "o_orderkey", "o_orderstatus", "o_totalprice",
                      epoch_micros("o_orderdate", ts_type).alias("us"))
    o = blocks_for_hot_groups(o, ["id"], "us", block_rows)
    w = ordered_scan(o, ["id"], ["us", "o_orderkey"], row_number="visit",
                     lead={"next_us": "us", "next_status": "o_orderstatus"},
                     minimum={"us0": "us"})
    w = w.filter(F.col("next_us").isNotNull())
    base = 694224000000000  # 1992-01-01
    out = w.select(
        F.col("id"),
        F.col("visit").cast("int").alias("visit"),
        ((F.col("us") - F.lit(base)) / F.lit(DAY_US)).alias("t_start"),
        ((F.col("next_us") - F.lit(base)) / F.lit(DAY_US)).alias("t_stop"),
        ((F.col("us") - F.col("us0")) / F.lit(DAY_US)).alias("b_start"),
        ((F.col("next_us") - F.col("us0")) / F.lit(DAY_US)).alias("b_stop"),
        F.when(F.col("next_status") == "F", 1).otherwise(0).cast("int").alias("status"),
        F.col("o_totalprice").cast("double").alias("measure"),
        F.col(BLOCK),
    )
    return blocks_from_rank(out.withColumn(BLOCK, F.col(BLOCK)), "visit", block_rows)


def person_periods(spark: SparkSession, sf_dir: str, block_rows: int = SUBJECT_BLOCK_ROWS) -> DataFrame:
    return events_person_periods(read_table(spark, sf_dir, "events"), block_rows=block_rows)


def pp_oracle_cte() -> str:
    """The same person-period table in DuckDB SQL (for the oracle queries)."""
    return """pp AS (
  WITH e AS (
    SELECT user_id, event_id, event_type, value, epoch_us(ts) AS us,
           TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
  w AS (
    SELECT *, row_number()  OVER (PARTITION BY user_id ORDER BY us, event_id) AS visit,
           lead(us)         OVER (PARTITION BY user_id ORDER BY us, event_id) AS next_us,
           lead(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS next_type,
           lead(value)      OVER (PARTITION BY user_id ORDER BY us, event_id) AS next_value,
           min(us)          OVER (PARTITION BY user_id) AS us0 FROM e)
  SELECT CAST(user_id AS VARCHAR) AS id, CAST(visit AS INT) AS visit,
         (us      - 1704067200000000) / 86400000000e0 AS t_start,
         (next_us - 1704067200000000) / 86400000000e0 AS t_stop,
         (us      - us0) / 86400000000e0 AS b_start,
         (next_us - us0) / 86400000000e0 AS b_stop,
         CAST(CASE WHEN next_value > 100 AND next_type = 'purchase' THEN 1
              WHEN next_value > 100 AND next_type = 'error' THEN 2 ELSE 0 END AS INT) AS status,
         CASE WHEN event_id % 10 = 3 THEN NULL ELSE value END AS measure,
         CASE WHEN event_id % 13 = 5 THEN NULL ELSE value % 101e0 END AS sbp,
         CASE WHEN event_id % 17 = 2 THEN NULL ELSE k END AS dbp,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 8 AS INT) + 1 END AS income,
         CAST(user_id % 4 AS INT) + 1 AS race, CAST(user_id % 2 AS INT) AS lbw
  FROM w WHERE next_us IS NOT NULL)"""


def orders_pp_oracle_cte() -> str:
    """The orders person-periods in DuckDB SQL."""
    return """ppo AS (
  WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) AS us FROM orders),
  w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY us, o_orderkey) AS visit,
        lead(us) OVER (PARTITION BY o_custkey ORDER BY us, o_orderkey) AS next_us,
        lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY us, o_orderkey) AS next_status,
        min(us) OVER (PARTITION BY o_custkey) AS us0 FROM o)
  SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(visit AS INT) AS visit,
         (us - 694224000000000) / 86400000000e0 AS t_start, (next_us - 694224000000000) / 86400000000e0 AS t_stop,
         (us - us0) / 86400000000e0 AS b_start, (next_us - us0) / 86400000000e0 AS b_stop,
         CAST(CASE WHEN next_status = 'F' THEN 1 ELSE 0 END AS INT) AS status, o_totalprice AS measure
  FROM w WHERE next_us IS NOT NULL)"""
