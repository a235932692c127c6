"""survspan: cohort and time-to-event analytics on Spark DataFrames.

Subpackages
-----------
sources    readers/writers and person-period builders
plans      skew-safe building blocks (blocked per-subject scans, prefix sums,
           distributed Newton fits, checkpointing)
operators  the user-facing operators (cleaning, person-period surgery,
           description, Kaplan-Meier, Cox, AFT, inference, bootstrap, contrasts)
functions  vectorised special functions (incomplete gamma, generalized gamma)
           and their pandas-UDF wrappers
catalog    registered queries and their DuckDB oracle SQL
"""

__version__ = "0.1.0"
