"""Regular expressions and string helpers with Python's semantics, as Spark columns.

Java's ``\\s``, ``\\w``, ``\\d``, ``\\b`` and case folding are ASCII unless ``(?U)`` is set, ``.`` and ``$`` know more line ends than a
line feed unless ``(?d)`` is set, and ``trim`` strips blanks only; the helpers here allow for that. Four control characters
(U+001C to U+001F) are white space to Python alone, so ``SPACE`` names them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Before a Java pattern: its classes, boundaries, case folding and line ends are those of a Python pattern for text.
UNICODE = "(?Ud)"
SPACE = r"[\s\x1C-\x1F]"
#: All white space that Python knows.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def any_of(*phrases: str) -> str:
    """Alternation of literal phrases, longest first."""
    return "|".join(sorted({re.escape(p).replace("\\ ", " ") for p in phrases}, key=lambda p: (-len(p), p)))


def strip(c: Column) -> Column:
    """White space off both ends, Unicode included."""
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Runs of two or more white-space characters become one blank; ends are stripped."""
    return strip(F.regexp_replace(c, rf"(?U){SPACE}{{2,}}", " "))


def one_line(c: Column) -> Column:
    """Every run of white space becomes one blank; ends are stripped."""
    return strip(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def sms_text(c: Column) -> Column:
    """Carriage returns become blanks, ends are stripped, runs of blanks and tabs become one; line feeds stay."""
    return F.regexp_replace(strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\r"), F.lit(" "))), r"[ \t]{2,}|\t", " ")


def kept(df: DataFrame, column: str, value: Column, test) -> DataFrame:
    """The rows whose ``value`` passes ``test``, with it as ``column`` (in its place, or last). A filter above a projection is pushed below it
    with a copy of the expression for every use; generated rows are not, so the value is computed once."""
    one = F.explode(F.filter(F.array(value), test)).alias(column)
    return df.select(*[one if c == column else F.col(f"`{c}`") for c in df.columns], *([] if column in df.columns else [one]))


def has(c: Column, pattern: str) -> Column:
    """Whether a Python pattern occurs; null counts as the empty string."""
    return F.coalesce(c, F.lit("")).rlike(UNICODE + pattern)


def sentence_count(c: Column) -> Column:
    """Parts between sentence marks followed by white space."""
    return F.regexp_count(strip(c), F.lit(rf"(?U)[.!?]{SPACE}+")) + 1


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\w+"))


def first_word(c: Column) -> Column:
    """First word, lower case, without marks around it."""
    return F.regexp_replace(F.lower(F.regexp_extract(c, rf"(?U)\A{SPACE}*([^\s\x1C-\x1F]+)", 1)), r"\A[.,!?]+|[.,!?]+\z", "")


def quoted(c: Column) -> Column:
    """A column's text as a literal pattern."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def hash_pick(values: list[str], *key: Column) -> Column:
    """One of the values, chosen by the md5 of the key parts: the same on every run and partitioning."""
    n = F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def hash_unit(*key: Column) -> Column:
    """A number from 0 to below 1 from the md5 of the key parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hash_pick_sql(values: list[str], key: str) -> str:
    """The same choice in DuckDB SQL."""
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[(('0x' || md5({key})[1:8])::BIGINT % {len(values)} + 1)::INTEGER]"
