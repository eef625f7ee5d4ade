"""Text helpers whose results follow Python string semantics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's Unicode \s lacks the four ASCII separators that Python counts as space.
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"

_REPLACEMENT = "\ufffd"
_PARKED = "\ufdd0"  # a Unicode noncharacter, stands in for a genuine U+FFFD


def strip(text: Column) -> Column:
    """Drop leading and trailing white space of any kind."""
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"(?U){NOT_SPACE}")


def decode_utf8(raw: Column) -> Column:
    """Bytes to text: invalid sequences are dropped, line ends become ``\\n``."""
    text = F.replace(raw.cast("string"), F.lit(_REPLACEMENT), F.lit(_PARKED))
    text = F.replace(F.make_valid_utf8(text), F.lit(_REPLACEMENT), F.lit(""))
    text = F.replace(text, F.lit(_PARKED), F.lit(_REPLACEMENT))
    return universal_newlines(text)


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def title(text: Column) -> Column:
    """Capitalise every run of letters, as ``str.title`` does."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda run: F.concat(F.upper(F.left(run, F.lit(1))), F.lower(F.substring(run, 2, 2147483647)))),
        "",
    )


def type_title(vulnerability_type: Column) -> Column:
    return title(F.replace(vulnerability_type, F.lit("_"), F.lit(" ")))


def _round_exact(value: Column, scale: float) -> Column:
    """Round a double to ``1 / scale`` by its exact binary value, ties to even.

    ``value * scale`` may land on a tie only because the product was rounded, so the
    error of the product (Dekker's split) decides in that case.
    """
    factor = F.lit(scale)
    product = value * factor
    head = value * F.lit(134217729.0)
    high = head - (head - value)
    low = value - high
    # The scale fits in half a mantissa, so both partial products are exact.
    error = (high * factor - product) + low * factor
    below = F.floor(product).cast("double")
    nearest = (
        F.when(product - below != F.lit(0.5), F.rint(product))
        .when(error > 0, below + F.lit(1.0))
        .when(error < 0, below)
        .otherwise(F.rint(product))
    )
    # Larger values have at most nine binary digits after the point, which decimals hold
    # exactly where it matters; from 2^53 on there are none.
    large = F.bround(value.cast("decimal(38,10)"), len(str(int(scale))) - 1).cast("double")
    return F.when(F.abs(value) < F.lit(1e13), nearest / factor).when(F.abs(value) < F.lit(2.0**53), large).otherwise(value)


def round2(value: Column) -> Column:
    return _round_exact(value, 100.0)


def stable_round2(value: Column) -> Column:
    """``round2`` after removing the last digits, which depend on summation order."""
    return round2(F.round(value, 10))


def one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", _round_exact(value, 10.0))


def two_decimals(value: Column) -> Column:
    rounded = round2(value)
    # A decimal prints faster, but knows no sign of zero.
    plain = (value >= 0) & (value < F.lit(1e12))
    return F.when(plain, F.abs(rounded).cast("decimal(15,2)").cast("string")).otherwise(F.format_string("%.2f", rounded))


def seldom(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build(value)`` as a function of its own, for a long expression that few rows need.

    Within a branch it would make the generated method so large that Java never compiles it.
    """
    return F.transform(F.array(value), build)[0]


def double_text(value: Column) -> Column:
    """A double as Python prints it: plain between 0.0001 and 10^16, with a signed exponent of two digits or more beyond.

    The digits are Spark's, which a few numbers have more of than needed (1.25e22).
    """
    text = value.cast("string")
    return F.when(~F.contains(text, F.lit("E")), text).otherwise(seldom(value, _with_exponent))


def _with_exponent(value: Column) -> Column:
    text = value.cast("string")
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    mantissa, power = F.substring_index(F.ltrim(text, F.lit("-")), "E", 1), F.substring_index(text, "E", -1).cast("int")
    digits = F.rtrim(F.replace(mantissa, F.lit("."), F.lit("")), F.lit("0"))
    whole = F.rpad(F.left(digits, power + 1), power + 1, "0")
    rest = F.substring(digits, power + 2, F.lit(20))
    size = F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0"))
    short = F.concat(F.left(digits, F.lit(1)), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.lit(20)))).otherwise(""))
    return (
        F.when(power == -4, F.concat(sign, F.lit("0.000"), digits))
        .when(power.between(0, 15), F.concat(sign, whole, F.lit("."), F.when(rest == "", "0").otherwise(rest)))
        .otherwise(F.concat(sign, short, F.when(power < 0, "e-").otherwise("e+"), size))
    )


def html_escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text
