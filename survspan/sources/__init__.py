"""Sources and sinks."""

from .person_period import (PP_COLUMNS, events_person_periods, orders_person_periods,
                            person_periods, pp_oracle_cte, read_table)
from .text import read_table as read_text_table
from .text import write_labels, write_table

__all__ = ["PP_COLUMNS", "events_person_periods", "orders_person_periods", "person_periods",
           "pp_oracle_cte", "read_table", "read_text_table", "write_table", "write_labels"]
