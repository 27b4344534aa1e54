from cadence.sources.files import (load_facts, load_intervals, optional_source, read_csv,
                                   write_table)
from cadence.sources.indicators import melt_indicators, pivot_indicators

__all__ = ["load_facts", "load_intervals", "melt_indicators", "optional_source",
           "pivot_indicators", "read_csv", "write_table"]
