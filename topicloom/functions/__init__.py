from .bins import bin_left, bin_right_closed, bin_right_closed_edge, border, borders
from .clock import comparable_time, epoch_millis, epoch_seconds, epoch_seconds_of, instant, parse_epoch_seconds, timestamp_literal
from .numbers import error_interval, link_width, nan_to_zero, safe_divide, to_number
from .text import (
    ancestors,
    fmt_date,
    fmt_number,
    fmt_percent,
    label,
    percent_text,
    slice_label,
    split_line,
    strip_cast,
    value_or_na,
)

__all__ = [
    "ancestors", "bin_left", "bin_right_closed", "bin_right_closed_edge", "border", "borders", "comparable_time",
    "epoch_millis", "epoch_seconds", "epoch_seconds_of", "error_interval", "fmt_date",
    "fmt_number", "fmt_percent", "instant", "label", "link_width", "nan_to_zero", "parse_epoch_seconds",
    "percent_text", "safe_divide", "slice_label", "split_line", "strip_cast", "timestamp_literal",
    "to_number", "value_or_na",
]
