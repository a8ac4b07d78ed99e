"""String Column helpers (all JVM-side, codegen-friendly; no Python UDF).

Java regex `\\s` and Spark `trim` are ASCII-only while Python's are Unicode.
Whitespace patterns therefore use an explicit class equal to Python's
str.isspace set (also valid RE2 syntax, so SQL engines agree).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python str.isspace(): ASCII whitespace incl. \v, the separators \x1c-\x1f,
# NEL, and every Unicode separator (Zs, Zl, Zp).
WS = r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\p{Z}]"

# The same characters one by one, for `btrim`, which looks at the ends only.
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# FIXED VALUES: chapter-title line patterns (case-insensitive) - an optional
# section keyword CAPITOLO / PARTE / CAP / CAP. followed by only a Roman
# numeral (letters IVXLCDM) or only Arabic digits, optional final period.
CHAPTER_TITLE_RE = r"(?i)^" + WS + r"*(CAPITOLO|PARTE|CAP\.?)?" + WS + r"*([IVXLCDM]+|\p{Nd}+)\.?" + WS + r"*$"
# Year in a file name: separator, four digits, `.txt` at the end.
YEAR_IN_FILENAME_RE = r"[-_](\d{4})\.txt$"


def utrim(c: Column) -> Column:
    """Unicode-aware strip (Python str.strip semantics)."""
    return F.btrim(c, F.lit(WS_CHARS))


def collapse_ws(c: Column) -> Column:
    """Collapse any run of Unicode whitespace to one space, then strip."""
    return utrim(F.regexp_replace(c, f"{WS}+", " "))


def is_chapter_title(line: Column) -> Column:
    """True for a numeral-only chapter heading; blank lines are False."""
    return (utrim(line) != "") & line.rlike(CHAPTER_TITLE_RE)


def year_from_filename(name: Column) -> Column:
    """Integer year from `..._1881.txt` / `...-1881.txt`; NULL when absent."""
    return F.nullif(F.regexp_extract(name, YEAR_IN_FILENAME_RE, 1), F.lit("")).try_cast("int")


def preview(c: Column, n: int, always_ellipsis: bool = False) -> Column:
    """First n characters, with '...' appended (only when longer, unless always)."""
    if always_ellipsis:
        return F.concat(F.substring(c, 1, n), F.lit("..."))
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def safe_name(c: Column) -> Column:
    """Model name usable in a column name: '-' and '.' -> '_'."""
    return F.translate(c, "-.", "__")
