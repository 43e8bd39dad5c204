"""Whole-number money: half-even division, translation between currencies, credits and token estimates.

Amounts are minor units (bigint).  Products are taken in decimal(38,0); a result outside bigint raises, as ANSI
casts do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000
#: Decimal places of currencies whose minor unit is not a hundredth.
ZERO_PLACES = ("BIF", "CLP", "DJF", "GNF", "ISK", "JPY", "KMF", "KRW", "PYG", "RWF", "UGX", "UYI", "VND", "VUV", "XAF", "XOF", "XPF")
THREE_PLACES = ("BHD", "IQD", "JOD", "KWD", "LYD", "OMR", "TND")


def _wide(c: Column | int) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("decimal(38,0)")


def half_even(n: Column, d: Column | int) -> Column:
    """n / d to the nearest whole number, ties to the even one, for d > 0.

    Worked out from the floored quotient and its remainder; a division rounded afterwards would round twice.
    """
    n, d = _wide(n), _wide(d)
    rest = F.pmod(n, d).cast("decimal(38,0)")
    q = ((n - rest) / d).cast("decimal(38,0)")
    up = (rest * 2 > d) | ((rest * 2 == d) & (F.pmod(q, F.lit(2).cast("decimal(38,0)")) == 1))
    return (q + F.when(up, 1).otherwise(0)).cast("bigint")


def product(a: Column, b: Column | int) -> Column:
    """An exact product of two bigints."""
    return (a.cast("decimal(19,0)") * (b if isinstance(b, Column) else F.lit(b)).cast("decimal(19,0)")).cast("decimal(38,0)")


def translate(amount: Column, rate_micro: Column) -> Column:
    """Amount times a rate in millionths, half even; null where the rate is not positive."""
    return F.when(rate_micro > 0, half_even(product(amount, rate_micro), MICRO))


def ceil_div(n: Column, d: Column | int) -> Column:
    """n / d rounded up, for n >= 0 and d > 0."""
    n, d = _wide(n), _wide(d)
    rest = F.pmod(n, d).cast("decimal(38,0)")
    return (((n - rest) / d).cast("decimal(38,0)") + F.when(rest > 0, 1).otherwise(0)).cast("bigint")


def credits(tokens_in: Column, tokens_out: Column, in_micro: Column, out_micro: Column) -> Column:
    """Credits for a turn: each side's tokens times its multiplier in millionths, rounded up on its own."""
    return ceil_div(product(tokens_in, in_micro), MICRO) + ceil_div(product(tokens_out, out_micro), MICRO)


def token_estimate(n_bytes: Column, bytes_per_token: int, overhead: int = 0, margin_percent: int = 0) -> Column:
    """Tokens that text of so many bytes may take: rounded up, with an overhead and then a margin, rounded up again."""
    plain = ceil_div(n_bytes, bytes_per_token) + overhead
    return ceil_div(product(plain, 100 + margin_percent), 100)


def currency_scale(code: Column) -> Column:
    return F.when(code.isin(*ZERO_PLACES), 0).when(code.isin(*THREE_PLACES), 3).otherwise(2)


def signed(side: Column, amount: Column) -> Column:
    """Debits positive, credits negative."""
    return F.when(side == "DR", amount).otherwise(-amount)


def immaterial(amount: Column, invoice: Column, cap: int = 10_000) -> Column:
    """At most one percent of the invoice, and at most a cap."""
    return (amount * 100 <= invoice) & (amount <= cap)


def releasable(total: Column, recognized: Column, status: Column) -> Column:
    return F.when(status == "ACTIVE", F.greatest(total - recognized, F.lit(0))).otherwise(0)
