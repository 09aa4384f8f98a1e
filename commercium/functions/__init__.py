from commercium.functions.scalars import (
    amount_label,
    clip,
    count_if,
    exact_mean,
    exact_sum,
    mean_of_parts,
    month_start,
    null_safe_equal,
    percent_label,
    quarter_label,
    quarter_start,
    ratio,
    round_half_even,
    round_half_up,
    sum_of_parts,
    sum_parts,
)

__all__ = [
    "amount_label",
    "clip",
    "count_if",
    "exact_mean",
    "exact_sum",
    "mean_of_parts",
    "month_start",
    "null_safe_equal",
    "percent_label",
    "quarter_label",
    "quarter_start",
    "ratio",
    "round_half_even",
    "round_half_up",
    "sum_of_parts",
    "sum_parts",
]
