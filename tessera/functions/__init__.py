from .labels import (count_label, growth_label, labelled, metric_label, money_label,
                     or_dash, pct_label)
from .numbers import (clean_number, exact_sum, exact_sum0, growth_pct, is_suppressed,
                      safe_ratio)
from .text import (clean_key, marked_segment, naic_sort_keys, norm_header, period_end,
                   period_key, period_of, period_text, segment_family, segment_line,
                   segment_wind_only, short_name, short_segment)

__all__ = [
    "clean_key", "clean_number", "count_label", "exact_sum", "exact_sum0", "growth_label",
    "growth_pct", "is_suppressed", "labelled", "marked_segment", "metric_label",
    "money_label", "naic_sort_keys", "norm_header", "or_dash", "pct_label", "period_end",
    "period_key", "period_of", "period_text", "safe_ratio", "segment_family",
    "segment_line", "segment_wind_only", "short_name", "short_segment",
]
