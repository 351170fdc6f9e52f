"""Column helpers built from JVM-side functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's ``str.strip`` treats as white space beyond Java's ``\s``.
WHITESPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def hash24(*parts) -> Column:
    """The first 24 bits of the md5 of the joined parts, as a bigint."""
    joined = F.concat(*[_text(p) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 6), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Reproducible uniform number in [0, 1] from the md5 of the joined parts."""
    return hash24(*parts).cast("double") / F.lit(16777215.0)


def seed_order(seed, ident: Column) -> Column:
    """Sort key that shuffles rows the same way on every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), ident.cast("string")))


def strip_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def words(text: Column) -> Column:
    """Split on every single space; empty words are kept."""
    return F.split(text, " ")


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)),
        F.lit(0.0).cast("double"),
        lambda acc, x: acc + x,
    )


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(doubles(a), doubles(b), lambda x, y: x * y),
        F.lit(0.0).cast("double"),
        lambda acc, x: acc + x,
    )


def log_add_exp(a: Column, b: Column) -> Column:
    """ln(exp(a) + exp(b)), NULL standing for minus infinity on either side."""
    high, low = F.greatest(a, b), F.least(a, b)
    return (
        F.when(a.isNull(), b)
        .when(b.isNull(), a)
        .otherwise(high + F.log1p(F.exp(low - high)))
    )


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def whole_div(a: Column, b: int) -> Column:
    """Integer division; exact for large ids, unlike a floored quotient of doubles."""
    return F.call_function("div", a, F.lit(b)).cast("bigint")
