"""Base-38 name tokens as Column expressions.

A token reads a name as digits, least significant first; unknown characters are digit 0. Names of up to twelve
characters fit a BIGINT; longer ones wrap modulo 2**64 and are computed in DECIMAL(38, 0), as ANSI arithmetic raises on
overflow. Tokens are stored as signed BIGINT, which keeps equality.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits in order; the first stands for itself and for every unknown character (fixed values).
DIGITS = "\0" + "0123456789" + "abcdefghijklmnopqrstuvwxyz" + "_"
BASE = len(DIGITS)
_WRAP = 1 << 64


def token_of(name: str) -> int:
    """The token of a name that is known beforehand, so that no row computes it."""
    total = sum(max(DIGITS.find(c), 0) * BASE**i for i, c in enumerate(name.lower())) % _WRAP
    return total - _WRAP if total >> 63 else total


def token(name: Column) -> Column:
    """The token of a name as signed BIGINT; names of any length."""
    chars = F.filter(F.split(F.lower(name), ""), lambda c: c != "")
    wide = lambda c: F.pmod(c, F.lit(Decimal(_WRAP)).cast("decimal(38,0)")).cast("decimal(38,0)")
    digits = F.transform(chars, lambda c: F.call_function("locate", c, F.lit(DIGITS[1:])))
    state = lambda total, power: F.struct(total.alias("total"), power.alias("power"))
    total = F.aggregate(
        digits,
        state(F.lit(Decimal(0)).cast("decimal(38,0)"), F.lit(Decimal(1)).cast("decimal(38,0)")),
        lambda acc, d: state(wide(acc["total"] + acc["power"] * d), wide(acc["power"] * BASE)),
        lambda acc: acc["total"],
    )
    long_ = F.when(total >= F.lit(Decimal(1 << 63)).cast("decimal(38,0)"), total - F.lit(Decimal(_WRAP)).cast("decimal(38,0)")).otherwise(total).cast("long")
    return F.when(F.length(name) <= 12, short_token(name)).otherwise(long_)


def short_token(name: Column) -> Column:
    """The token of a name of at most twelve characters, in BIGINT throughout."""
    at = F.sequence(F.lit(1), F.least(F.length(name), F.lit(12)))
    digit = lambda i: F.call_function("locate", F.substr(F.lower(name), i, F.lit(1)), F.lit(DIGITS[1:])).cast("long")
    power = F.array(*(F.lit(BASE**i).cast("long") for i in range(12)))
    return F.when(F.length(name) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(at, F.lit(0).cast("long"), lambda acc, i: acc + F.element_at(power, i) * digit(i)))


def name_of(value: Column) -> Column:
    """The name of a token; the inverse of :func:`token` for names of up to twelve known characters."""
    unsigned = F.when(value < 0, value.cast("decimal(38,0)") + F.lit(Decimal(_WRAP)).cast("decimal(38,0)")).otherwise(value.cast("decimal(38,0)"))
    start = F.struct(unsigned.cast("decimal(38,0)").alias("rest"), F.lit("").alias("name"))
    step = lambda acc, i: F.struct(
        F.floor(acc["rest"] / BASE).cast("decimal(38,0)").alias("rest"),
        F.when(acc["rest"] > 0, F.concat(acc["name"], F.substr(F.lit(DIGITS), F.pmod(acc["rest"], F.lit(BASE)).cast("int") + 1, F.lit(1)))).otherwise(acc["name"]).alias("name"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(13)), start, step, lambda acc: acc["name"])
