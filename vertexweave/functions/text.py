"""Column helpers for the line formats read and written by the library."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The formats' definition of blank space and of an integer.
TOKEN_SEPARATORS = " \t\n\r\f"
TRIMMED_CHARACTERS = "".join(chr(code) for code in range(0x21))
INTEGER_PATTERN = "[+-]?[0-9]+"
SEPARATOR_PATTERN = "[ \\t\\n\\r\\f]+"


def trim_control(text: Column) -> Column:
    """Strip every character up to and including the blank from both ends."""
    return F.btrim(text, F.lit(TRIMMED_CHARACTERS))


def tokens(text: Column) -> Column:
    """Split on runs of blanks; leading and trailing blanks give no token."""
    return F.split(F.btrim(text, F.lit(TOKEN_SEPARATORS)), SEPARATOR_PATTERN, -1)


def is_integer(text: Column) -> Column:
    return text.rlike(f"\\A{INTEGER_PATTERN}\\z")


def strict_int(text: Column) -> Column:
    """Read a 32-bit integer, failing the query when the text is not one.

    A plain cast would also take blanks and control characters around the
    digits; the pattern keeps those out.
    """
    return F.when(is_integer(text), text.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("not a 32-bit integer: "), F.coalesce(text, F.lit("null")))).cast("int")
    )
