"""Text and time formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of the reference's pattern language, wider than that of Java and without U+0085;
# characters that may not appear in a file name on common systems; the name of last resort.
WHITE_SPACE_CHARACTERS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
UNSAFE_NAME_CHARACTERS = r'[\\/:*?"<>|]'
NAME_OF_LAST_RESORT = "app"

ASCII_WHITE_SPACE = "[\\t-\\r ]+"
# The same white space as a character class. It needs the flag (?U) and is several times faster than a list.
WHITE_SPACE = r"[\s\uFEFF&&[^\x85]]"

ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def unicode_trim(col: Column) -> Column:
    """Trim every kind of white space; the plain ``trim`` leaves a no-break space in place."""
    return F.trim(col, F.lit(WHITE_SPACE_CHARACTERS))


def sanitize_name(col: Column, legacy: bool = False) -> Column:
    """A name safe to use in an output path. The legacy order trims last, when blanks are already '_'.

    Names of ASCII characters, told by their length in bytes, are searched for ASCII blanks only.
    """
    source = col if legacy else unicode_trim(col)
    safe = F.regexp_replace(source, f"{UNSAFE_NAME_CHARACTERS}+", "")
    ascii_only = F.octet_length(col) == F.length(col)
    joined = F.when(ascii_only, F.regexp_replace(safe, ASCII_WHITE_SPACE, "_")).otherwise(
        F.regexp_replace(safe, f"(?U){WHITE_SPACE}+", "_")
    )
    return F.regexp_replace(joined, "^$", NAME_OF_LAST_RESORT)


def iso_millis(ts: Column) -> Column:
    """ISO-8601 text in UTC with milliseconds; the session time zone must be UTC."""
    return F.date_format(ts, ISO_MILLIS)
