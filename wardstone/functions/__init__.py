from wardstone.functions.flags import (
    any_of, burden, combined_label, either_label, level_band, threshold_flags,
)
from wardstone.functions.numbers import round_columns, round_half_away, safe_ratio
from wardstone.functions.text import class_column, encode
from wardstone.functions.timeops import (
    age_at, days_between, died_between, died_within, hours_between, in_window, micros_between, night_flag, shift,
)

__all__ = [
    "age_at", "any_of", "burden", "class_column", "combined_label", "days_between", "died_between",
    "died_within", "either_label", "encode", "hours_between", "in_window", "level_band", "micros_between", "night_flag", "round_columns", "round_half_away", "safe_ratio", "shift", "threshold_flags",
]
