"""Text, hash and formatting expressions (plain columns, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of generated temporary objects and their neutral forms.
TEMP_NAME_MARK = "pg_temp.tt"
TEMP_NAME_PATTERNS = (
    (r"_Q_[0-9][0-9][0-9]_F_", "_Q_000_F_"),
    (r"pg_temp\.tt[0-9]+", "pg_temp.tt"),
)
# Unit names and the size at which the next unit starts.
SIZE_UNITS = ("bytes", "kB", "MB", "GB", "TB", "PB")
UNIT_SWITCH = 10 * 1024


def normalise_text(text: Column, rename_temp_tables: bool = False) -> Column:
    """Collapse every run of white space to one space; optionally neutralise temp names."""
    collapsed = F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " ")
    if not rename_temp_tables:
        return collapsed
    renamed = collapsed
    for pattern, neutral in TEMP_NAME_PATTERNS:
        renamed = F.regexp_replace(renamed, pattern, neutral)
    return F.when(collapsed.contains(TEMP_NAME_MARK), renamed).otherwise(collapsed)


def text_id(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def short_hash(md5: Column) -> Column:
    """First 16 hex digits of an md5 as a signed 64-bit integer."""
    return F.conv(F.substring(md5, 1, 16), 16, -10).cast("bigint")


def hex_id(number: Column) -> Column:
    return F.lower(F.hex(number))


def size_pretty(size: Column) -> Column:
    """Bytes as text; a unit is used until the value reaches 10,240 of it, halves round up."""
    amount = size.cast("bigint")
    magnitude = F.abs(amount)
    result = None
    for power in reversed(range(1, len(SIZE_UNITS))):
        unit = 1 << (10 * power)
        rounded = F.floor((magnitude + (unit >> 1)) / F.lit(unit)).cast("bigint")
        # the switch is decided on the rounded value of the next smaller unit
        smaller = 1 << (10 * (power - 1))
        reached = (F.floor((magnitude + (smaller >> 1)) / F.lit(smaller)) >= UNIT_SWITCH)
        label = F.concat(F.when(amount < 0, "-").otherwise(""), rounded.cast("string"),
                         F.lit(f" {SIZE_UNITS[power]}"))
        result = F.when(reached, label) if result is None else result.when(reached, label)
    return F.when(amount.isNotNull(),
                  result.otherwise(F.concat(amount.cast("string"), F.lit(" bytes"))))
