"""Column helpers.  Every function takes and returns a ``Column``."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Text forms a cell may use for a moment in time.
# Left: pattern for Spark; the order is the order in which they are tried.
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd-MM-yyyy",
    "MMM d yyyy",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
    "yyyy-MM-dd HH:mm:ss.SSSSSS[XXX]",
    "yyyy-MM-dd HH:mm",
    "yyyy/MM/dd HH:mm:ss",
    "M/d/yyyy",
    "M/d/yyyy H:mm[:ss]",
    "d-M-yyyy",
    "yyyy-M-d",
    "MMM d, yyyy",
    "d MMM yyyy",
)
# A form's letters as a mask has them: digits as 9, a run of letters as a, a fraction as one 9.
MASKS = {
    "yyyy": ("9999",), "MMM": ("a",), "MM": ("99",), "M": ("9", "99"), "dd": ("99",), "d": ("9", "99"), "HH": ("99",),
    "H": ("9", "99"), "mm": ("99",), "ss": ("99",), "SSSSSS": ("9",), "XXX": ("a", "+99:99", "-99:99"), "'T'": ("a",),
}
# What every one of these forms looks like; other cells are not parsed at all.
TIME_SHAPE = r"^[A-Za-z0-9][A-Za-z0-9 :,./+-]{5,34}$"


def col(name: str) -> Column:
    """Reference a column whose name may hold dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def slug(c: Column, limit: int = 80, empty: str = "run") -> Column:
    """File-name-safe form of a text."""
    body = F.regexp_replace(c, "[^a-zA-Z0-9_-]+", "_")
    body = F.substring(F.regexp_replace(body, "^_+|_+$", ""), 1, limit)
    return F.when(body == "", F.lit(empty)).otherwise(body)


def table_cell(c: Column) -> Column:
    """Text that cannot break a markdown table row."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", "•")
    marked = F.substring(text, 1, 1).isin("#", "-", "*", ">")
    return F.when(marked, F.concat(F.lit(" "), text)).otherwise(text)


def strip_controls(c: Column) -> Column:
    """Drop control and invisible characters, keep tab and newline."""
    text = F.regexp_replace(c, "\r\n", "\n")
    text = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.regexp_replace(text, r"[‮‭​‌‍]", "")


def token(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def detail_text(c: Column) -> Column:
    """Check details in a form that is safe to print."""
    swapped = F.translate(F.coalesce(c, F.lit("")), "\\|[]'", "/•()")
    return F.trim(swapped)


def blank_to_null(c: Column) -> Column:
    """NULL for NULL and for text made of white space only."""
    text = c.cast("string")
    return F.when(F.regexp_replace(text, r"\s+", "") != "", text)


def finite(c: Column) -> Column:
    """A double with NaN and both infinities turned into NULL."""
    value = c.cast("double")
    usable = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(usable, value)


def to_number(c: Column) -> Column:
    """Number held by a text, NULL when it does not hold exactly one."""
    return finite(c.try_cast("double"))


def leading_number(c: Column) -> Column:
    """Number at the start of a text, whatever follows it."""
    head = F.regexp_extract(
        c.cast("string"), r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1
    )
    return finite(head.try_cast("double"))


def to_boolean(c: Column) -> Column:
    """true/false in any letter case; all else is NULL."""
    text = F.lower(c.cast("string"))
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


def to_time(c: Column, pattern: str) -> Column:
    """Moment held by a text of one form, else NULL."""
    return F.when(c.rlike(TIME_SHAPE) & c.rlike("[0-9]{4}"), F.try_to_timestamp(c, F.lit(pattern)))


def masks_of(pattern: str) -> set[str]:
    """All masks that texts of a form can have; a part in brackets may be missing."""
    optional = re.search(r"\[([^\[\]]*)\]", pattern)
    if optional:
        before, after = pattern[: optional.start()], pattern[optional.end():]
        return masks_of(before + optional[1] + after) | masks_of(before + after)
    found = {""}
    for part in re.findall("|".join(MASKS) + "|.", pattern):
        found = {f + m for f in found for m in MASKS.get(part, (part,))}
    return found


def mask(c: Column) -> Column:
    """The shape of a text that may hold a moment, NULL for any other text."""
    digits = F.translate(c, "012345678", "999999999")
    shape = F.regexp_replace(F.regexp_replace(digits, "[A-Za-z]+", "a"), "[.]9+", ".9")
    return F.when(c.rlike(TIME_SHAPE) & c.rlike("[0-9]{4}"), shape)


def loosely(pattern: str) -> str:
    """The form with one or two digits wherever it asks for two: what masks tell apart, one parse can read."""
    return re.sub("MM(?!M)(?<!MMM)", "M", pattern.replace("dd", "d").replace("HH", "H"))


def families(formats=TIMESTAMP_FORMATS) -> dict[str, dict[str, int]]:
    """Per form of one parse its masks, each with the forms that it fits as bits.

    Forms whose masks differ only in the number of digits share one parse.
    """
    found: dict[str, dict[str, int]] = {}
    for j, pattern in enumerate(formats):
        fitting = found.setdefault(loosely(pattern), {})
        for m in masks_of(pattern):
            fitting[m] = fitting.get(m, 0) | 1 << j
    return found


def _table(pairs: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(pairs.items()) for x in pair]), key)


def mask_code(shape: Column, formats=TIMESTAMP_FORMATS) -> Column:
    """Which parses can read a text of this mask, as bits; NULL if none can."""
    bits: dict[str, int] = {}
    for k, fitting in enumerate(families(formats).values()):
        for m in fitting:
            bits[m] = bits.get(m, 0) | 1 << k
    return _table(bits, shape)


def moment_and_fits(c: Column, shape: Column, code: Column, formats=TIMESTAMP_FORMATS) -> tuple[Column, Column]:
    """The moment that a text of this mask and code holds, and the forms that fit it as bits."""
    moments, bits = [], F.lit(0)
    for k, (pattern, fitting) in enumerate(families(formats).items()):
        at = F.when(code.bitwiseAND(F.lit(1 << k)) != 0, F.try_to_timestamp(c, F.lit(pattern)))
        moments.append((min(v & -v for v in fitting.values()), at))
        bits = bits.bitwiseOR(F.when(at.isNotNull(), _table(fitting, shape)).otherwise(0))
    return F.coalesce(*[m for _, m in sorted(moments, key=lambda pair: pair[0])]), bits


def parse_timestamp(c: Column, formats=TIMESTAMP_FORMATS) -> Column:
    """First format that fits the cell, which its mask tells."""
    # Transforms of one-item arrays, so that mask and code are made once.
    shaped = F.transform(F.array(mask(c)), lambda shape: F.transform(
        F.array(mask_code(shape, formats)), lambda code: moment_and_fits(c, shape, code, formats)[0])[0])
    return shaped[0]


def signed_text(c: Column, digits: int = 3) -> Column:
    """Number with an explicit sign and a fixed number of decimals."""
    return F.format_string(f"%+.{digits}f", c)


def grouped_text(c: Column, digits: int = 2) -> Column:
    """Number with thousands separators, ``N/A`` for NULL."""
    return F.coalesce(F.format_string(f"%,.{digits}f", c), F.lit("N/A"))


def hours_between(start: Column, end: Column) -> Column:
    seconds = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    return seconds / F.lit(3600.0)


def adjusted_skew(n: Column, g1: Column) -> Column:
    """Sample skewness from the population one; 0 for a constant column."""
    count = n.cast("double")
    factor = F.try_divide(F.sqrt(count * (count - 1)), count - 2)
    return F.when(n >= 3, F.coalesce(finite(g1) * factor, F.lit(0.0)))


def adjusted_kurtosis(n: Column, g2: Column) -> Column:
    """Sample excess kurtosis from the population one; 0 for a constant column."""
    count = n.cast("double")
    factor = F.try_divide(count - 1, (count - 2) * (count - 3))
    return F.when(n >= 4, F.coalesce(factor * ((count + 1) * finite(g2) + 6), F.lit(0.0)))


def rounded(c: Column, digits: int = 6) -> Column:
    """Round and turn a negative zero into a plain one."""
    return F.round(c, digits) + F.lit(0.0)
