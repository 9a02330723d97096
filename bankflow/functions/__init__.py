from bankflow.functions.dates import (
    in_day,
    iso_text,
    micros,
    month_of,
    month_range,
    next_month,
    parse_day,
    parse_month,
)
from bankflow.functions.money import (
    change_ratio,
    decimal_ratio,
    delta,
    money,
    null_to_zero,
    risk_flag,
    rounded_ratio,
    safe_ratio,
    try_money,
    utilisation,
    wide_money,
)
from bankflow.functions.text import hash_number, mask_all, mask_but_last, not_blank, sorted_set

__all__ = [
    "change_ratio", "decimal_ratio", "delta", "hash_number", "in_day", "iso_text", "mask_all",
    "mask_but_last", "micros", "money", "month_of", "month_range", "next_month", "not_blank",
    "null_to_zero", "parse_day", "parse_month", "risk_flag", "rounded_ratio", "safe_ratio", "sorted_set",
    "try_money", "utilisation", "wide_money",
]
