"""Checks of numbers, as Python functions and as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and signs of the two national standards for personal and company numbers.
ID18_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID18_CHECKS = "10X98765432"
USCC_WEIGHTS = (1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28)
USCC_SIGNS = "0123456789ABCDEFGHJKLMNPQRTUWXY"


def valid_id18(s: str) -> bool:
    return ID18_CHECKS[sum(int(c) * w for c, w in zip(s, ID18_WEIGHTS)) % 11] == s[17].upper()


def looks_like_id18(s: str) -> bool:
    """A plausible date of birth in the middle."""
    return s[6:14].isdigit() and 1900 <= int(s[6:10]) <= 2100 and 1 <= int(s[10:12]) <= 12 and 1 <= int(s[12:14]) <= 31


def valid_luhn(s: str) -> bool:
    digits = [int(c) for c in reversed(s)]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def valid_uscc(s: str) -> bool:
    if len(s) != 18 or any(c not in USCC_SIGNS for c in s):
        return False
    return USCC_SIGNS.index(s[17]) == -sum(USCC_SIGNS.index(c) * w for c, w in zip(s, USCC_WEIGHTS)) % 31


def _weighed(s: Column, weights: tuple[int, ...], value) -> Column:
    return sum((value(F.substring(s, i + 1, 1)) * w for i, w in enumerate(weights)), F.lit(0))


def id18_column(s: Column) -> Column:
    total = _weighed(s, ID18_WEIGHTS, lambda c: c.cast("int"))
    return s.rlike("^[0-9]{17}[0-9Xx]$") & (F.substring(F.lit(ID18_CHECKS), (total % 11 + 1).cast("int"), F.lit(1)) == F.upper(F.substring(s, 18, 1)))


def id18_date_column(s: Column) -> Column:
    part = lambda at, n: F.substring(s, at, n).cast("int")
    return s.rlike("^[0-9]{17}[0-9Xx]$") & part(7, 4).between(1900, 2100) & part(11, 2).between(1, 12) & part(13, 2).between(1, 31)


def luhn_column(s: Column) -> Column:
    return F.call_function("luhn_check", s)


def uscc_column(s: Column) -> Column:
    at = lambda c: F.call_function("locate", c, F.lit(USCC_SIGNS)) - 1
    return s.rlike("^[0-9A-HJ-NPQRTUWXY]{18}$") & (at(F.substring(s, 18, 1)) == F.pmod(-_weighed(s, USCC_WEIGHTS, at), F.lit(31)))
