from .dates import parse_date, parse_hhmm
from .numbers import finite_number, hhmm_number, round_half_even
from .severity import severity

__all__ = [
    "finite_number",
    "hhmm_number",
    "parse_date",
    "parse_hhmm",
    "round_half_even",
    "severity",
]
