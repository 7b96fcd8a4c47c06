"""Number formatting rules expressed with Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineseek.session import let

# Size units, 1024 steps, the last one is not exceeded.
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]

SURE_DIGITS = 15  # two decimals of so few digits are never the same normal double
LEAST_NORMAL = 2.0**-1022


def number_text_length(value: Column) -> Column:
    """Length of a double written in ECMAScript's shortest form.

    With ``k`` significant digits and the decimal point after digit ``n``:
    plain digits up to 21 places, a leading ``0.`` down to 1e-6, otherwise an
    exponent with an explicit sign and no trailing ``.0``.
    """

    def spelt(size: Column, text: Column, plain: Column) -> Column:
        short = F.length(text) <= SURE_DIGITS + 1  # the point is one of the places
        return F.when(plain & short, F.length(text)).otherwise(_laid_out_length(size, text))

    def length(x: Column) -> Column:
        size = F.abs(x)
        integral = (size < 2.0**53) & (size == F.floor(size))
        plain = (size >= 1e-3) & (size < 1e7)  # Spark prints these without an exponent
        unsigned = (
            F.when(integral, F.length(F.floor(size).cast("string")))
            .when(size == float("inf"), 8)
            .otherwise(let(size.cast("string"), lambda text: spelt(size, text, plain)))
        )
        return unsigned + F.when(x < 0, 1).otherwise(0)

    return let(value, length).cast("bigint")


def _laid_out_length(size: Column, text: Column) -> Column:
    """ECMAScript length of the positive double ``size`` that Spark prints as ``text``."""
    mantissa = F.substring_index(text, "E", 1)
    unpointed = F.regexp_replace(mantissa, r"\.", "")
    power = F.when(text.contains("E"), F.substring_index(text, "E", -1).cast("int")).otherwise(0)
    leading = F.length(F.regexp_extract(unpointed, "^0*", 0))
    whole = F.length(F.substring_index(mantissa, ".", 1))
    printed = F.struct(
        F.regexp_replace(unpointed, "^0+|0+$", "").alias("figures"), (whole + power - leading).alias("point")
    )

    def laid_out(part: Column) -> Column:
        digits, point = F.length(part["figures"]), part["point"]
        exponent = F.length(F.abs(point - 1).cast("string"))
        return (
            F.when((point >= digits) & (point <= 21), point)
            .when((point > 0) & (point <= 21), digits + 1)
            .when((point > -6) & (point <= 0), 2 - point + digits)
            .when(digits == 1, 3 + exponent)
            .otherwise(digits + 3 + exponent)
        )

    return let(let(printed, lambda part: _shortest(size, part)), laid_out)


def _shortest(size: Column, printed: Column) -> Column:
    """``figures, point`` of the fewest digits that read back as ``size``.

    Spark's own digits name the double but may be more than it needs. If fewer do, the
    decimal of that many digits just below or just above them does, so both are
    cast back, for every number of digits that leaves a doubt: all for a subnormal
    number, from 15 on for another.
    """
    figures, point = printed["figures"], printed["point"]
    held = F.length(figures)

    def decimal(units: Column, places: Column) -> Column:
        digits = units.cast("string")
        return F.struct(
            F.regexp_replace(digits, "0+$", "").alias("figures"),
            (point + F.length(digits) - places).alias("point"),  # one more place if all digits were nines
        )

    def around(places: Column) -> Column:
        below = figures.substr(F.lit(1), places).cast("bigint")
        return F.array(decimal(below, places), decimal(below + 1, places))

    def reads_back(found: Column) -> Column:
        return F.concat(F.lit("0."), found["figures"], F.lit("E"), found["point"].cast("string")).cast("double") == size

    fewest = F.when(size < LEAST_NORMAL, 1).otherwise(SURE_DIGITS)
    tried = F.flatten(F.transform(F.sequence(fewest, held), around))
    return F.when(held <= fewest, printed).otherwise(F.element_at(F.filter(tried, reads_back), 1))


def to_fixed(value: Column, places: int) -> Column:
    """Decimal text with a fixed number of places, rounding the exact binary value.

    Built-in formatting rounds the shortest decimal form instead, which moves
    the last digit of values such as 1.005. The product with the power of ten
    is therefore taken with its rounding error (Dekker's splitting), so that a
    fraction that only looks like one half is told apart from a true half.
    """
    scale = 10**places
    split = 134217729.0
    x = F.abs(value)
    high = x * split - (x * split - x)
    low = x - high
    product = x * float(scale)
    error = (high * float(scale) - product) + low * float(scale)
    whole = F.floor(product)
    fraction = product - whole
    up = (fraction > 0.5) | ((fraction == 0.5) & (error >= 0))
    units = whole + F.when(up, 1).otherwise(0)
    sign = F.when(value < 0, "-").otherwise("")
    digits = F.lpad((units % scale).cast("string"), places, "0")
    return F.concat(sign, F.floor(units / scale).cast("string"), F.lit("."), digits)


def format_size(size: Column) -> Column:
    """Human-readable byte count with two decimals, in exact decimal arithmetic."""
    exact = size.cast("decimal(20,0)")
    result = None
    for step, name in enumerate(SIZE_UNITS):
        unit = F.lit(1024**step).cast("decimal(13,0)")
        text = F.concat(F.round(exact / unit, 2).cast("decimal(22,2)").cast("string"), F.lit(f" {name}"))
        inside = exact < 1024 ** (step + 1)
        if step == 0:
            result = F.when(inside, text)
        elif step < len(SIZE_UNITS) - 1:
            result = result.when(inside, text)
        else:
            result = result.otherwise(text)
    return result
