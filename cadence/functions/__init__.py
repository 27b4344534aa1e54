from cadence.functions.exprs import (
    combine_text, default_text, finite, guarded_corr, log10_pos, nonblank, safe_div, to_number,
)

__all__ = ["combine_text", "default_text", "finite", "guarded_corr", "log10_pos", "nonblank",
           "safe_div", "to_number"]
